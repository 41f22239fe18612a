import random
import re

from manyfold.llm import op10_licenses as op
from manyfold.llm.license_rules import BASE, RULES

SCHEMA = "doc_id long, text string, row string, words string, label string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, text):
    words = words_of(text)
    line = " " + " ".join(words) + " "
    base = []
    for phrase, label in BASE.items():
        want = phrase.split(" ")
        base += [(i, label) for i in range(len(words)) if words[i:i + len(want)] == want]
    found = []
    for rank, (label, priority, keyword, expression) in enumerate(RULES):
        if f" {keyword} " in line:
            for m in re.finditer(f"(?<= )(?:{expression})(?= )", line):
                found.append((line[:m.start()].count(" ") - 1, line[:m.end()].count(" "), priority, rank, label))
    kept = []
    for s in found:
        def beats(e, s=s):
            inside = e[0] <= s[0] and s[1] <= e[1]
            return inside and (e[2], -(e[1] - e[0]), e[3]) < (s[2], -(s[1] - s[0]), s[3])

        if not any(beats(e) for e in found):
            kept.append(s)
    base_labels = {label for _, label in base}
    score = 1.0 if base else max([op.CONFIDENCE[s[2]] for s in kept], default=0.0)
    places = [i for i, _ in base]
    return doc, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {s[4] for s in kept})), score


def test_rules_are_sound():
    assert len(RULES) >= 200
    for label, priority, keyword, expression in RULES:
        assert label and priority in op.CONFIDENCE and re.compile(expression)
    assert {k for _, _, k, _ in RULES} <= {k for k in (w for _, _, k, _ in RULES for w in [k]) if WORD.fullmatch(k)}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    lines = [
        "Licensed under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc", "Licensed under the Apache License, Version 2.0.", "Apache License",
        "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License v3 or later", "GNU Lesser General Public License version 2.1", "Copyright (c) 2019-2020 by X", "All rights reserved",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "under the terms of the MIT license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International license",
        "mit der Lizenz", "undermit license", "mit license mit license", "CC0 1.0 Universal", "Neither the name of ACME nor the names of its contributors may be used to endorse or promote products", "the unlicense",
    ]
    docs = [(i, "\n".join(rng.choice(["filler text é", "x"]) + " " + rng.choice(lines) for _ in range(rng.randint(0, 8))), "r", "w", "l") for i in range(150)]
    docs += [(900, None, "", "", ""), (901, "", "", "", ""), (902, " .,- ", "", "", ""), (None, lines[0], "", "", ""), (0, lines[1], None, None, None), (903, ("word " * 50 + lines[0] + " ") * 2000, "", "", "")]
    got = [tuple(r) for r in op.scan(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(str(brute(d[0], d[1])) for d in docs)


def test_empty(spark):
    assert op.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def shortest(parsed):
    """Texts that an expression matches when what is optional stays away, one for each choice of the rest."""
    out = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts = [chr(value)]
        elif name in ("ANY", "NOT_LITERAL"):
            parts = ["x"]
        elif name == "IN":
            parts = [chr(v if str(k) == "LITERAL" else v[0]) if str(k) in ("LITERAL", "RANGE") else "0" for k, v in value]
        elif name == "SUBPATTERN":
            parts = shortest(value[-1])
        elif name == "BRANCH":
            parts = [t for branch in value[1] for t in shortest(branch)]
        else:
            assert name.endswith("REPEAT"), name
            parts = [t * value[0] for t in shortest(value[2])] if value[0] else [""]
        out = [a + b for a in out for b in dict.fromkeys(parts)]
    return out


def test_every_match_holds_its_keyword():
    bad = [(label, k, t) for label, _, k, e in RULES for t in shortest(re._parser.parse(e)) if f" {k} " not in f" {t} "]
    assert not bad


def test_rules_whose_keyword_was_optional(spark):
    docs = spark.createDataFrame([(1, "CreativeML Open RAIL-M License", "", "", ""), (2, "Public Domain Dedication and License", "", "", "")], SCHEMA)
    got = {r[0]: r[6] for r in op.scan(docs).collect()}
    assert "rail" in got[1].split(",") and "pddl" in got[2].split(",")

"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates come from the base patterns (also where their value check fails) and from wider ones (credentials after a
key word, spelled-out e-mail addresses).  Six labelers vote 1, 0 or -1 on each: the value check, a gazetteer, key words in the context
on the left, the borders, the shape, and repetition.  Votes are counted over all documents by pattern, a table whose size is
fixed by the labelers; expectation-maximisation on it estimates each labeler's reliability and each pattern's posterior, and
a logistic classifier over kinds and votes is trained on the posteriors.  It accepts spans beyond the base ones, which
always stay; a candidate whose value check fails is never accepted.

Texts are only touched by DataFrame expressions.  The driver sees the table of vote patterns, nothing else.

Defined cases: a null text counts as empty; very long texts are scanned whole (all patterns are linear, with possessive
repeats); repeated rows are judged one by one; without candidates, or for an empty table, only base spans count (there
are none); other columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyfold.operators.storage import materialise

#: Kinds in the order of the results; the last is the method's own.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Java patterns.  Look-behinds and possessive repeats only keep them linear: they match what the plain patterns match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]++)++"
SECRET = r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key)[\x20\x22]{0,3}[=:][\x20\x22]{0,3}[A-Za-z0-9+/_.-]{16,}+"
#: (kind, pattern, gate: a text without it is not searched, whether matches are base spans)
SOURCES = (("email", EMAIL, "contains({t}, '@')", True), ("ip", IP, "true", True), ("card", CARD, "true", True), ("phone", PHONE, "contains({t}, '+')", True), ("email", SPELLED, "contains({t}, '(') or contains({t}, '[')", False), ("secret", SECRET, "contains({t}, '=') or contains({t}, ':')", False))
LABELERS = ("value", "gazetteer", "context", "border", "shape", "repeat")
TOP_LEVEL = "com org net edu gov mil int info biz io de fr es it uk eu us ca au jp cn in ch at nl be se no dk fi pl ru br mx".split()
CUES = {"email": "mail contact write reach send kontakt courriel correo schreib", "ip": "ip host server address client login adresse from", "card": "card visa master amex credit pay iban account karte carte tarjeta", "phone": "phone call tel fax mobile reach contact ruf telefon appel", "secret": "token secret password passwd key"}
ACCEPT = 0.5
#: Code points on the left of a candidate in which the context labeler looks for its cues.
CONTEXT = 40


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and binds it; a projection's columns may be inlined into lambdas, a variable not."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _stops(body: str) -> str:
    """SQL that binds ``s`` for body: where the matches m stop, given the pieces p of text between them.

    Match k stops after pieces 0..k and matches 0..k.  Running sums are made in runs of about the root of their number,
    as appending to an array copies it.
    """
    none = "cast(array() as array<bigint>)"
    widths = "transform(m, (f, k) -> length(p[k]) + length(f))"
    run = "cast(ceil(sqrt(size(m))) as int)"
    runs = f"transform(sequence(0, (size(m) - 1) div {run}), b -> slice(u, cast(b * {run} + 1 as int), {run}))"
    before = f"aggregate(transform(w, r -> aggregate(r, 0L, (a, x) -> a + x)), named_struct('at', 0L, 'all', {none}), (a, x) -> named_struct('at', a.at + x, 'all', concat(a.all, array(a.at))), a -> a.all)"
    inner = f"flatten(zip_with(w, {before}, (r, o) -> aggregate(r, named_struct('at', o, 'all', {none}), (a, x) -> named_struct('at', a.at + x, 'all', concat(a.all, array(a.at + x))), a -> a.all)))"
    return _let("u", widths, _let("w", runs, _let("s", inner, body)))


def _candidates(text: str) -> str:
    """SQL for an array of candidate structs in a text column; offsets are code points, ends exclusive."""
    empty = "cast(array() as array<struct<kind:string,base:boolean,start:bigint,stop:bigint,body:string,l:string,r:string,whole:string>>)"
    parts = []
    for kind, pattern, gate, base in SOURCES:
        value = "regexp_extract(f, '[A-Za-z0-9+/_.-]{16,}+$', 0)" if kind == "secret" else "f"
        each = f"""transform(m, (f, k) -> named_struct('kind', '{kind}', 'base', {str(base).lower()}, 'start', s[k] - length({value}), 'stop', s[k],
            'body', {value}, 'l', lower(right(p[k], {CONTEXT})), 'r', left(p[k + 1], 1), 'whole', f))"""
        located = _let("p", f"split({text}, r'{pattern}', -1)", _stops(each))
        matches = f"case when {gate.format(t=text)} then regexp_extract_all({text}, r'{pattern}', 0) else cast(array() as array<string>) end"
        parts.append(_let("m", matches, f"case when size(m) > 0 then {located} else {empty} end"))
    return f"concat({', '.join(parts)})"


def _votes(x: str) -> str:
    """SQL for the labelers' votes on a candidate struct, an array of tinyint in the order of LABELERS."""
    digits = f"regexp_replace({x}.body, '[^0-9]', '')"
    luhn = f"""pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) -> case when i % 2 = 0 then cast(c as int) when cast(c as int) >= 5 then cast(c as int) * 2 - 9 else cast(c as int) * 2 end), 0, (a, v) -> a + v), 10) = 0"""
    octets = f"forall(split({x}.body, '[.]'), o -> length(regexp_replace(o, '^0+', '')) <= 3 and cast(right(o, 3) as int) <= 255)"
    value = f"""case {x}.kind when 'email' then true when 'ip' then {octets} when 'card' then {luhn}
        when 'phone' then length({digits}) between 9 and 15 else {x}.body rlike '[0-9]' and {x}.body rlike '[A-Za-z]' end"""
    tops = ", ".join(f"'{t}'" for t in TOP_LEVEL)
    gazetteer = f"""case {x}.kind when 'email' then case when lower(regexp_extract({x}.body, '[A-Za-z]+$', 0)) in ({tops}) then 1 else -1 end
        when 'ip' then case when {x}.body rlike '^(0|127|255)[.]' then -1 else 1 end
        when 'card' then case when left({digits}, 1) in ('3', '4', '5', '6') then 1 else 0 end
        when 'phone' then case when {x}.body rlike '^[+](1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])' then 1 else -1 end
        else case when lower({x}.whole) rlike '^(token|secret|passw|api)' then 1 else 0 end end"""
    cues = " ".join(f"when '{k}' then '{'|'.join(c.split())}'" for k, c in CUES.items())
    context = f"case when concat({x}.l, case when {x}.kind = 'secret' then lower({x}.whole) else '' end) rlike (case {x}.kind {cues} end) then 1 else 0 end"
    border = f"case when {x}.l rlike '[a-z0-9]$' or {x}.r rlike '^[A-Za-z0-9]' then -1 else 1 end"
    shape = f"""case {x}.kind when 'email' then case when length({x}.body) between 6 and 254 then 1 else -1 end when 'ip' then case when length({x}.body) <= 15 then 1 else -1 end
        when 'card' then case when length({digits}) in (15, 16) then 1 else 0 end when 'phone' then case when length({digits}) between 10 and 13 then 1 else 0 end
        else case when length({x}.body) >= 20 then 1 else 0 end end"""
    repeat = f"case when {x}.kind in ('card', 'phone', 'secret') and size(array_distinct(split({x}.body, ''))) <= 3 then -1 else 0 end"
    return f"transform(array(case when {value} then 1 else -1 end, {gazetteer}, {context}, {border}, {shape}, {repeat}), v -> cast(v as tinyint))"


def _voted(text: str) -> str:
    """SQL for the candidates ``(kind, base, start, stop, votes)`` of a text column."""
    return f"transform({_candidates(text)}, x -> named_struct('kind', x.kind, 'base', x.base, 'start', x.start, 'stop', x.stop, 'votes', {_votes('x')}))"


def voted(docs: DataFrame, text_col: str = "text", into: str = "candidates") -> DataFrame:
    """``docs`` with an array column of candidates ``(kind, base, start, stop, votes)``."""
    return docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))).withColumn(into, F.expr(_voted("__text"))).drop("__text")


@dataclass
class Model:
    """Reliabilities of the labelers, and the span classifier's weights: bias, one per kind, one per labeler."""

    reliability: list[dict[str, float]]
    bias: float
    kinds: dict[str, float]
    votes: list[float]

    def chance(self, x: str) -> str:
        kinds = " ".join(f"when '{k}' then {w!r}D" for k, w in self.kinds.items())
        votes = " + ".join(f"{w!r}D * {x}.votes[{i}]" for i, w in enumerate(self.votes))
        return f"1 / (1 + exp(-({self.bias!r}D + case {x}.kind {kinds} else 0D end + {votes})))"

    def accepted(self, column: str) -> str:
        """SQL: base spans, and other candidates that the classifier takes, sorted by kind and start."""
        order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
        taken = f"filter({column}, x -> x.votes[0] > 0 and (x.base or {self.chance('x')} >= {ACCEPT}))"
        keyed = f"transform({taken}, x -> named_struct('o', case x.kind {order} end, 'start', x.start, 'stop', x.stop, 'base', x.base, 'kind', x.kind))"
        return f"array_sort({keyed})"


def fit(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> Model:
    """EM over counted vote patterns, then a logistic fit of kind and votes to the posteriors.

    patterns: (kind, votes, number of candidates).  Posteriors start from the labelers' majority.
    """
    m = len(LABELERS)
    post = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in patterns]
    tables: list[list[dict[int, float]]] = []
    for _ in range(rounds if patterns else 0):
        tables, prior = [], {}
        for k in KINDS:
            n = sum(c for kind, _, c in patterns if kind == k)
            prior[k] = (1 + sum(c * p for (kind, _, c), p in zip(patterns, post, strict=True) if kind == k)) / (n + 2)
        for side in (1, 0):
            weight = [c * (p if side else 1 - p) for (_, _, c), p in zip(patterns, post, strict=True)]
            # one pseudo-count a vote, leaning to labelers that are right
            start = {s: 2.0 if s == (1 if side else -1) else 1.0 for s in (-1, 0, 1)}
            tables.append([{s: (start[s] + sum(w for (_, v, _), w in zip(patterns, weight, strict=True) if v[j] == s)) / (4 + sum(weight)) for s in (-1, 0, 1)} for j in range(m)])
        post = []
        for kind, v, _ in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(tables[0][j][v[j]] / tables[1][j][v[j]]) for j in range(m))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    reliability = [{"true_when_personal": tables[0][j][1], "false_when_not": tables[1][j][-1]} for j in range(m)] if tables else []
    weights = [0.0] * (1 + len(KINDS) + m)
    rows = [([1.0, *(float(kind == k) for k in KINDS), *map(float, v)], p, c) for (kind, v, c), p in zip(patterns, post, strict=True)]
    total = sum(c for *_, c in rows) or 1
    for _ in range(400):
        grad = [1e-3 * w for w in weights]
        for x, p, c in rows:
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * f for w, f in zip(weights, x, strict=True))))))
            for j, f in enumerate(x):
                grad[j] += c / total * (guess - p) * f
        weights = [w - 0.8 * g for w, g in zip(weights, grad, strict=True)]
    return Model(reliability, weights[0], dict(zip(KINDS, weights[1:1 + len(KINDS)], strict=True)), weights[1 + len(KINDS):])


def train(candidates: DataFrame, column: str = "candidates") -> Model:
    """Count vote patterns over all documents and fit; the collected table has at most kinds x 3 ** labelers rows."""
    each = candidates.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes").agg(F.count(F.lit(1)).alias("n"))
    return fit(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in each.collect()))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(<id_col>, spans)``: spans is an array of ``(o, start, stop, base, kind)`` sorted by kind, then start."""
    kept = materialise(voted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "candidates"))
    return kept.select(F.col("id").alias(id_col), F.expr(train(kept).accepted("candidates")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each accepted span replaced by its kind in brackets; overlapping spans become one, named by the first.

    ``n_chars``, where there is one, follows the new text.  The patterns run once to train and once to replace.
    """
    model = train(voted(docs.select(F.col(text_col).alias("text"))))
    # sorted spans overlap somewhere only if neighbours do
    overlap = "exists(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v) - 1), (x, y) -> y.start < x.stop), o -> o)"
    merged = """aggregate(v, cast(array() as array<struct<start:bigint,stop:bigint,kind:string>>), (a, x) -> case
        when size(a) > 0 and x.start < element_at(a, -1).stop then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop), 'kind', element_at(a, -1).kind)))
        else concat(a, array(x)) end)"""
    pieces = """concat(concat_ws('', transform(c, (x, i) -> concat(
        substring(__text, cast(case when i = 0 then 1 else c[i - 1].stop + 1 end as int), cast(x.start - case when i = 0 then 0 else c[i - 1].stop end as int)), '[', upper(x.kind), ']'))),
        substring(__text, cast(element_at(c, -1).stop + 1 as int), length(__text)))"""
    spans = f"array_sort(transform({model.accepted('q')}, x -> named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind)))"
    new = _let("q", _voted("__text"), _let("v", spans, f"case when size(v) = 0 then null else {_let('c', f'case when {overlap} then {merged} else v end', pieces)} end"))
    # the row travels as one struct, so that no column of its can clash
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.coalesce(docs[text_col], F.lit("")).alias("__text")).withColumn("__new", F.expr(new))
    changed = F.col("__new").isNotNull()
    told = {text_col: F.coalesce(F.col("__new"), F.col("__row")[text_col])}
    if "n_chars" in docs.columns:
        told["n_chars"] = F.when(changed, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return held.select(*[told.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result columns of the query from ``find``'s rows."""
    named = "transform({}, x -> concat(x.kind, ':', x.start, ':', x.stop))"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(
        id_col, *counts, F.expr(f"sha2(array_join({named.format('filter(spans, x -> x.base)')}, ','), 256)").alias("base_sha256"), F.expr(f"array_join({named.format('spans')}, ',')").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )

"""License scans: ordered signature rules gated by a keyword prefilter, resolved by priority and containment.

A text becomes its words, joined by single blanks.  Keywords that stand in it select rules (an equi-join with the rule
table, whose size is fixed), the rules' regular expressions run over texts that passed their gate only, and of overlapping
detections one is suppressed when another of a better priority, or of the same priority but longer or earlier in the
list, covers its interval.  Everything is DataFrame expressions; texts without keyword never meet a regular expression of
the list.

Defined cases: a null text counts as empty and has no words, no labels and score zero; very long texts are scanned whole;
repeated rows and ids are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.llm.license_rules import BASE, RULES
from manyfold.operators.storage import materialise

#: Score of a text by the best priority among its detections.
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}
#: Marks put around detections; both are separators, so no normalised text holds them.
OPEN, CLOSE = "\x01", "\x02"


def normalised(text: Column) -> Column:
    """The words of a text, ASCII letters in lower case, with one blank before, between and after."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.translate(F.concat(F.lit(" "), F.trim(words), F.lit(" ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, phrase: str) -> Column:
    """The texts between the places of a phrase, without the blanks that enclose it."""
    return F.split(words, f"(?<= ){phrase}(?= )", -1)


def held_keywords(words: Column) -> Column:
    """The gate: keywords of the rules that stand in normalised words."""
    keywords = F.array(*map(F.lit, sorted({keyword for _, _, keyword, _ in RULES})))
    return F.filter(keywords, lambda k: F.contains(words, F.concat(F.lit(" "), k, F.lit(" "))))


def spans(texts: DataFrame, key: str = "row", words: str = "words") -> DataFrame:
    """Resolved detections ``(<key>, label, priority, start, stop)`` in words, stop exclusive.

    texts: ``(key, words, held)`` with normalised words and the keywords they hold; key must be unique.
    """
    rules = texts.sparkSession.createDataFrame([(i, *rule) for i, rule in enumerate(RULES)], "rank int, label string, priority int, keyword string, expression string")
    gated = texts.select(key, words, F.explode("held").alias("keyword")).join(F.broadcast(rules), "keyword")
    whole = F.concat(F.lit("(?<= )(?:"), "expression", F.lit(")(?= )"))
    matched = gated.where(F.regexp_like(words, whole)).withColumn("marked", F.regexp_replace(words, whole, F.lit(OPEN + "$0" + CLOSE)))
    split = F.split(F.trim("marked"), " ")
    starts = F.filter(F.transform(split, lambda w, i: F.when(F.startswith(w, F.lit(OPEN)), i)), lambda i: i.isNotNull())
    stops = F.filter(F.transform(split, lambda w, i: F.when(F.endswith(w, F.lit(CLOSE)), i + 1)), lambda i: i.isNotNull())
    found = matched.select(key, "rank", "label", "priority", F.explode(F.arrays_zip(starts.alias("start"), stops.alias("stop"))).alias("s")).select(key, "rank", "label", "priority", "s.start", "s.stop")
    # whatever covers an interval stands before it in this order
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"), "priority", "rank").rowsBetween(Window.unboundedPreceding, -1)
    covers = [F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(order) for p in CONFIDENCE]
    covered = F.lit(False)
    for p, most in zip(CONFIDENCE, covers, strict=True):
        covered = covered | ((F.col("priority") == p) & F.coalesce(most >= F.col("stop"), F.lit(False)))
    return found.withColumn("covered", covered).where("not covered").select(key, "label", "priority", "start", "stop")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``(<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row of ``docs``.

    Base phrases always count; the method's labels are those of its resolved detections.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("words"))
    pieces = {phrase: _places(F.col("words"), phrase) for phrase in BASE}
    found = F.array(*[F.when(F.contains("words", F.lit(f" {phrase} ")), F.struct(
        (F.size(p) - 1).cast("long").alias("n"),
        (_blanks(F.element_at(p, 1)) - 1).cast("long").alias("first"),
        (_blanks(F.col("words")) - 1 - (_blanks(F.element_at(p, -1)) - 1) - len(phrase.split(" "))).cast("long").alias("last"),
        F.lit(label).alias("label"),
    )) for (phrase, label), p in zip(BASE.items(), pieces.values(), strict=True)])
    base = rows.select(
        "row", "id", F.when(F.trim("words") == "", 0).otherwise(_blanks(F.col("words")) - 1).cast("long").alias("n_words"), F.filter(found, lambda f: f.isNotNull()).alias("f"), held_keywords(F.col("words")).alias("held"), "words"
    )
    # one pass over the texts; words are kept where a keyword stands in them
    base = materialise(base.withColumn("words", F.when(F.size("held") > 0, F.col("words"))))
    detected = spans(base.select("row", "words", "held")).groupBy("row").agg(F.collect_set("label").alias("m"), F.min("priority").alias("p"))
    joined = base.join(detected, "row", "left")
    base_set = F.array_sort(F.array_distinct(F.col("f.label")))
    confidence = F.lit(0.0)
    for p in reversed(CONFIDENCE):
        confidence = F.when(F.col("p") == p, CONFIDENCE[p]).otherwise(confidence)
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.aggregate("f.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_base"),
        F.array_min("f.first").alias("first_word"), F.array_max("f.last").alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, F.coalesce("m", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("f") > 0, 1.0).otherwise(confidence).alias("score"),
    )

"""Operators on keyed tables: one row per line of an entry, ``(key, pos, ...)``, where ``pos`` is the line's place.

Order within an entry is part of the data, so every operator that reorders or drops lines says what becomes of ``pos``: it
is kept as it was unless ``renumber`` is applied.  All operators are lazy and keep the other columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyfold.functions.expressions import compile_expression
from manyfold.operators.storage import materialise

COMPARISONS = ("ge", "le", "e")


def lines(key: str = "key", order: Sequence[str | Column] = ("pos",)) -> Window:
    """The lines of an entry in order."""
    return Window.partitionBy(key).orderBy(*order)


def renumber(table: DataFrame, order: Sequence[str | Column] = ("pos",), key: str = "key") -> DataFrame:
    """``pos`` counted anew from 1 in the given order."""
    return table.withColumn("pos", F.row_number().over(lines(key, order)).cast("long"))


# --- filtering and ordering lines


def sort_entries(table: DataFrame, column: str, how: str = "increasing", weights: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Sort each entry's lines stably by a column.

    how: ``increasing``, ``decreasing``, ``shuffle`` (by a hash of the line and ``seed``, repeatable), or ``priority``: by the
    weight that ``weights`` ``(item, weight)`` gives the column's value, largest first, 0 where it has none.
    """
    if how == "increasing":
        return renumber(table, [F.col(column).asc_nulls_last(), F.col("pos")])
    if how == "decreasing":
        return renumber(table, [F.col(column).desc_nulls_last(), F.col("pos")])
    if how == "shuffle":
        return renumber(table, [F.xxhash64("key", "pos", F.lit(seed)), F.col("pos")])
    if how != "priority" or weights is None:
        raise ValueError("how is increasing, decreasing, shuffle or, with weights, priority")
    named = weights.select(F.col("item").alias("__item"), F.col("weight").alias("__weight"))
    joined = table.join(named, table[column] == named["__item"], "left")
    ordered = renumber(joined, [F.coalesce("__weight", F.lit(0.0)).desc(), F.col("pos")])
    return ordered.drop("__item", "__weight")


def filter_by_list(table: DataFrame, column: str, listed: DataFrame, keep: bool = True) -> DataFrame:
    """Keep, or drop, the lines whose column is in the only column of ``listed``."""
    names = listed.select(F.col(listed.columns[0]).alias("__listed")).distinct()
    return table.join(names, table[column] == names["__listed"], "left_semi" if keep else "left_anti")


def map_column(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace a column by what ``mapping`` ``(old, new)`` gives for it: one line for each mapped value, none without one."""
    named = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = table.join(named, table[column] == named["__old"])
    return joined.select(*[F.col("__new").alias(column) if c == column else F.col(c) for c in table.columns])


def first_lines(table: DataFrame, n: int, order: Sequence[str | Column] = ("pos",)) -> DataFrame:
    """The first ``n`` lines of each entry; Spark limits groups before the shuffle."""
    return table.withColumn("__rank", F.row_number().over(lines(order=order))).where(F.col("__rank") <= n).drop("__rank")


def join_entries(table: DataFrame, column: str, other: DataFrame, columns: Sequence[str], other_key: str = "key") -> DataFrame:
    """Add columns of the entry of ``other`` (unique keys) that a column names; lines without one go."""
    named = other.select(F.col(other_key).alias("__key"), *columns)
    return table.join(named, table[column] == named["__key"]).drop("__key")


def _compared(left: Column, how: str, right: Column) -> Column:
    return {"ge": left >= right, "le": left <= right, "e": left == right}[how]


def beats_first(table: DataFrame, column: str, how: str, factor: float = 1.0) -> DataFrame:
    """Lines that compare to their entry's first line; the first line always stays.

    how: ``ge``, ``le``, ``e``, or ``ip``, ``op``, ``ep``, which compare with ``factor`` times the first value.
    """
    plain = {"ip": "ge", "op": "le", "ep": "e"}.get(how, how)
    if plain not in COMPARISONS:
        raise ValueError(f"no comparison {how}")
    window = lines()
    first = F.first(column).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = table.withColumn("__first", first * (factor if plain != how else 1.0)).withColumn("__rank", F.row_number().over(window))
    return marked.where((F.col("__rank") == 1) | _compared(F.col(column), plain, F.col("__first"))).drop("__first", "__rank")


def compare(table: DataFrame, column: str, how: str, value: float) -> DataFrame:
    """Lines whose column is ``ge``, ``le`` or ``e`` the value; other comparisons keep every line."""
    return table.where(_compared(F.col(column), how, F.lit(value))) if how in COMPARISONS else table


def filter_expression(table: DataFrame, expression: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Lines for which an expression over ``$1``, ``$2``, ... (the table's columns, or those given) isn't zero."""
    return table.where(compile_expression(expression, columns or table.columns) != 0)


def filter_pattern(table: DataFrame, column: str, pattern: str = "^.*$") -> DataFrame:
    """Lines whose column, as text, holds a match of the pattern."""
    return table.where(F.col(column).cast("string").rlike(pattern))


def with_identity(kept: DataFrame, table: DataFrame, target: str = "target") -> DataFrame:
    """``kept`` and those lines of ``table`` that name their own entry, none twice (``(key, pos)`` tells lines apart)."""
    own = table.where(F.col("key") == F.col(target))
    return kept.unionByName(own.join(kept.select("key", "pos"), ["key", "pos"], "left_anti"))


def trim_to(table: DataFrame, column: str) -> DataFrame:
    """Only one column of each line."""
    return table.select("key", "pos", column)


# --- sets of entries


def subset(table: DataFrame, wanted: DataFrame, column: str = "key") -> DataFrame:
    """Entries whose key (or accession) is in the only column of ``wanted``; wanted ones that are missing are ignored."""
    return filter_by_list(table, column, wanted)


def concat(first: DataFrame, second: DataFrame, preserve: bool = False, column: str = "key") -> DataFrame:
    """Both tables; keys of the second are counted on from the largest of the first, in their order, unless preserved.

    The new keys come from per-partition counts of a range-partitioned sort, so no task sees the whole table.
    """
    if preserve:
        return first.unionByName(second)
    ranked = dense_ranks(second.select(column).distinct(), column, "__rank")
    top = first.agg(F.coalesce(F.max(column), F.lit(-1)).alias("__top"))
    moved = second.join(ranked, column).join(F.broadcast(top)).withColumn(column, F.col("__top") + F.col("__rank")).drop("__top", "__rank")
    return first.unionByName(moved.select(*first.columns))


def dense_ranks(distinct: DataFrame, column: str, into: str) -> DataFrame:
    """Distinct values with their rank from 1, without a window over the whole table.

    Values are cut into ranges; counts of the ranges (one number each) give every range its offset.  The ranges come from a
    sample, which another run would draw anew, so they are written down before they are counted.
    """
    spark = distinct.sparkSession
    ranged = distinct.select(column).repartitionByRange(F.col(column)).sortWithinPartitions(column)
    kept = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = {r["__part"]: r["n"] for r in kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    starts = spark.createDataFrame(offsets, "__part int, __start long")
    return kept.join(F.broadcast(starts), "__part").select(column, (F.col("__start") + F.col("__local") + 1).alias(into))


def concat_larger(first: DataFrame, second: DataFrame, payload: str, column: str = "key") -> DataFrame:
    """Both tables; of entries with the same key the one with the longer payload stays, the first's among equals."""
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(column).orderBy(F.length(payload).desc(), "__from"))
    return both.withColumn("__rank", best).where("__rank = 1").drop("__from", "__rank")


def split(table: DataFrame, parts: int, weight: str | None = None, column: str = "key") -> DataFrame:
    """Add ``part`` (0 .. parts - 1): contiguous ranges of keys with equal numbers of entries, or equal sums of ``weight``.

    Sums run over ranges: each range sums its own weights, and the few range totals give the offsets.  The ranges come from
    a sample, so they are written down before they are summed.
    """
    spark = table.sparkSession
    amount = F.lit(1).cast("double") if weight is None else F.col(weight).cast("double")
    ranged = materialise(table.select(column, amount.alias("__w")).repartitionByRange(F.col(column)).withColumn("__range", F.spark_partition_id()))
    local = ranged.withColumn("__sum", F.sum("__w").over(Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = {r["__range"]: r["s"] for r in local.groupBy("__range").agg(F.sum("__w").alias("s")).collect()}
    offsets, total = [], 0.0
    for part in sorted(sums):
        offsets.append((part, total))
        total += sums[part]
    starts = spark.createDataFrame(offsets, "__range int, __start double")
    before = F.col("__start") + F.col("__sum") - F.col("__w")
    placed = local.join(F.broadcast(starts), "__range").select(F.col(column).alias("__key"), F.least(F.floor(before * parts / F.lit(max(total, 1e-300))), F.lit(parts - 1)).cast("long").alias("part"))
    return table.join(placed, table[column] == placed["__key"]).drop("__key")


def merge(tables: Sequence[DataFrame], prefixes: Sequence[str] | None = None, allowed: DataFrame | None = None, target: str = "target") -> DataFrame:
    """Entries of the first table with the lines of the others appended, in the tables' order.

    prefixes: a text for each table, added as column ``prefix``.  allowed: keep targets in its only column, and of a target
    within an entry only the first line.
    """
    keys = tables[0].select("key").distinct()
    tagged = [t.withColumn("__from", F.lit(i)).withColumn("prefix", F.lit(prefixes[i] if prefixes else None).cast("string")) for i, t in enumerate(tables)]
    both = reduce(DataFrame.unionByName, tagged).join(keys, "key", "left_semi")
    if allowed is not None:
        both = filter_by_list(both, target, allowed)
        both = both.withColumn("__rank", F.row_number().over(Window.partitionBy("key", target).orderBy("__from", "pos"))).where("__rank = 1").drop("__rank")
    merged = renumber(both, ["__from", "pos"]).drop("__from")
    return merged if prefixes else merged.drop("prefix")


def subtract(left: DataFrame, right: DataFrame, most: float = float("inf"), target: str = "target", evalue: str = "evalue") -> DataFrame:
    """Left lines whose (key, target) isn't in the right table; lines with an e-value above ``most`` go from both sides.

    A target with any left line within ``most`` is looked up with all its lines, so its lines above ``most`` stay as well.
    """
    near = left.where(F.col(evalue) <= most).select("key", target).distinct()
    taken = right.where(F.col(evalue) <= most).select("key", target).distinct()
    return left.join(near, ["key", target], "left_semi").join(taken, ["key", target], "left_anti").select(*left.columns)


def transpose(table: DataFrame, target: str = "target", order: Sequence[str | Column] | None = None) -> DataFrame:
    """Swap key and target; lines are numbered by the old key and place, or in the order given (over the new columns)."""
    swapped = table.withColumnsRenamed({"key": "__old", target: "__new"})
    renamed = swapped.withColumnsRenamed({"__old": target, "__new": "key"}).select(*table.columns)
    return renumber(renamed, order or [target, "pos"])


def rename_keys(table: DataFrame, mapping: DataFrame, column: str = "key") -> DataFrame:
    """Entries under the new keys of ``mapping`` ``(old, new)``; entries without one go."""
    return map_column(table, column, mapping)


def compare_headers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Compare two tables ``(key, header)``: one row ``(old_key, new_key, state)`` per header.

    state: ``removed``, ``kept`` or ``new``.  Of repeated headers within a table the smallest key counts.
    """
    left = old.groupBy("header").agg(F.min("key").alias("old_key"))
    right = new.groupBy("header").agg(F.min("key").alias("new_key"))
    state = F.when(F.col("new_key").isNull(), "removed").when(F.col("old_key").isNull(), "new").otherwise("kept")
    return left.join(right, "header", "full_outer").select("old_key", "new_key", state.alias("state"))


def merge_by_set(members: DataFrame, table: DataFrame) -> DataFrame:
    """Lines of all members of a set under the set's key; members: ``(set_id, member)``; numbered by member and place."""
    named = members.select(F.col("set_id").alias("__set"), F.col("member").alias("__member"))
    joined = table.join(named, table["key"] == named["__member"]).drop("key")
    numbered = renumber(joined.withColumnRenamed("__set", "key"), ["__member", "pos"])
    return numbered.select("key", F.col("__member").alias("member"), *[c for c in table.columns if c != "key"])


# --- aggregates over entries

STATISTICS = ("linecount", "mean", "min", "max", "sum", "firstline")


def statistics(table: DataFrame, column: str, which: Sequence[str] = STATISTICS, keys: DataFrame | None = None) -> DataFrame:
    """One row per entry; ``keys`` (its only column) adds entries without lines, whose count is 0 and the rest null."""
    found = {
        "linecount": F.count(F.lit(1)).alias("linecount"),
        "mean": F.avg(column).alias("mean"),
        "min": F.min(column).alias("min"),
        "max": F.max(column).alias("max"),
        "sum": F.sum(column).alias("sum"),
        "firstline": F.min_by(column, "pos").alias("firstline"),
    }
    out = table.groupBy("key").agg(*[found[w] for w in which])
    if keys is not None:
        out = keys.select(F.col(keys.columns[0]).alias("key")).distinct().join(out, "key", "left")
        if "linecount" in which:
            out = out.withColumn("linecount", F.coalesce("linecount", F.lit(0)))
    return out


def representative(table: DataFrame, sequences: DataFrame, target: str = "target") -> DataFrame:
    """The sequence that each entry's first line names: ``(key, seq)``."""
    first = table.groupBy("key").agg(F.min_by(target, "pos").alias("__first"))
    named = sequences.select(F.col("key").alias("__key"), "seq")
    return first.join(named, first["__first"] == named["__key"]).select("key", "seq")

"""Incremental clustering of a stream of sequences.

Every micro-batch is clustered against the representatives so far and appended to a table of members; state lives in that
table, so a restarted query goes on from it.  Batches are written under their number and a batch that comes again replaces
its own part, so each sequence counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from manyfold.operators import candidates
from manyfold.operators.storage import materialise
from manyfold.plans.workflows import linear_cluster

MEMBERS = "rep long, member long, seq string, batch long"


def members(spark: SparkSession, path: str) -> DataFrame:
    """All members so far: ``(rep, member, seq, batch)``; ``seq`` is kept for representatives alone."""
    try:
        return spark.read.schema(MEMBERS).parquet(path)
    except Exception as missing:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MEMBERS)


def absorb(path: str, k: int = 12, per_sequence: int = 21, least_identity: float = 0.9, least_coverage: float = 0.8) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over ``(key, seq)``."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = members(spark, path).where(F.col("batch") < number)
        # several steps read the batch: it is cut through a shared table, which a lost executor doesn't lose
        fresh = materialise(batch.select("key", "seq").dropDuplicates(["key"]).join(known.select(F.col("member").alias("key")), "key", "left_anti"))
        reps = known.where("rep = member").select(F.col("rep").alias("key"), "seq")
        pairs = candidates.search_kmers(fresh, candidates.kmer_index(reps, k, per_sequence), k, per_sequence)
        scored = candidates.rescore_diagonals(pairs, fresh, reps)
        good = scored.where((F.col("identical") >= least_identity * F.col("overlap")) & (F.col("overlap") >= least_coverage * F.greatest("qlen", "tlen")))
        joined = good.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "target"))["target"].alias("rep")).select("rep", F.col("key").alias("member"))
        rest = fresh.join(joined.select(F.col("member").alias("key")), "key", "left_anti")
        found = joined.unionByName(linear_cluster(rest, k, per_sequence, least_identity, least_coverage))
        texts = fresh.select(F.col("key").alias("member"), "seq")
        out = found.join(texts, "member").select("rep", "member", F.when(F.col("rep") == F.col("member"), F.col("seq")).alias("seq"))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return one


def start(stream: DataFrame, path: str, checkpoint: str, **options: float) -> StreamingQuery:
    """Run the clustering over a streaming table ``(key, seq)``."""
    return stream.writeStream.foreachBatch(absorb(path, **options)).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", column: str = "event_type") -> DataFrame:
    """Counts per tumbling window and value, for batches and streams; events later than ``late`` are dropped from a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), column).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), column, "n")

"""Catalogue commands on stored tables: Parquet folders and names in the session's catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import manyfold


def save(table: DataFrame, path: str, compressed: bool = True, mode: str = "errorifexists") -> None:
    """Write a table; compressed with zstd, or not at all."""
    table.write.mode(mode).option("compression", "zstd" if compressed else "none").parquet(path)


def save_index(table: DataFrame, name: str, column: str = "kmer", buckets: int = 64) -> None:
    """Write an index as a table bucketed and sorted by its column, so that joins on it need no shuffle of its side."""
    table.write.mode("overwrite").bucketBy(buckets, column).sortBy(column).saveAsTable(name)


def append_to_index(table: DataFrame, name: str) -> None:
    """Add rows to a stored index; they are bucketed as it is."""
    table.select(*table.sparkSession.table(name).columns).write.mode("append").insertInto(name)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.delete(place, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    files, place = _file_system(spark, path)
    return files.rename(place, _file_system(spark, to)[1])


def copy(spark: SparkSession, path: str, to: str) -> None:
    spark.read.parquet(path).write.parquet(to)


def link(spark: SparkSession, path: str, name: str) -> None:
    """Name a stored table in this session without copying it."""
    spark.read.parquet(path).createOrReplaceTempView(name)


def touch(table: DataFrame) -> DataFrame:
    """Keep a table in the executors' memory, spilling to disk."""
    return table.persist()


def free_space(spark: SparkSession, path: str) -> int:
    files, place = _file_system(spark, path)
    return files.getStatus(place).getRemaining()


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def set_kind(spark: SparkSession, path: str, kind: str) -> None:
    """Note what a stored table holds, in a file beside its parts that readers skip."""
    files, place = _file_system(spark, f"{path}/_kind")
    out = files.create(place, True)
    out.write(bytearray(kind.encode()))
    out.close()


def kind(spark: SparkSession, path: str) -> str | None:
    """What was noted, or None."""
    files, place = _file_system(spark, f"{path}/_kind")
    if not files.exists(place):
        return None
    read = files.open(place)
    try:
        return bytes(read.readAllBytes()).decode()
    finally:
        read.close()


def version() -> str:
    return manyfold.__version__

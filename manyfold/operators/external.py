"""Piping entries through an external program."""

from __future__ import annotations

import os
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_VARIABLE = "ENTRY_KEY"


def apply_program(table: DataFrame, program: list[str], column: str = "seq", into: str = "output") -> DataFrame:
    """``(key, <into>)``: what the program writes when it reads an entry's text; the key is in its environment.

    A program that ends with an error fails the query, with what it said.
    """

    @F.arrow_udf("string")
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for key, text in zip(keys.to_pylist(), texts.to_pylist(), strict=True):
            done = subprocess.run(program, input=text or "", capture_output=True, text=True, env=os.environ | {KEY_VARIABLE: str(key)}, check=False)
            if done.returncode:
                raise RuntimeError(f"{program[0]} failed on {key}: {done.stderr[-500:]}")
            out.append(done.stdout)
        return pa.array(out, pa.string())

    return table.select("key", run(F.col("key"), F.col(column)).alias(into))

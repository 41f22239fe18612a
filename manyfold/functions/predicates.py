"""Predicates and orders that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coverage modes: of both sides, of the target, of the query, and lengths within a share of each other.
BOTH, TARGET, QUERY, TARGET_LENGTH, QUERY_LENGTH, SHORTER_LENGTH = range(6)


def can_be_covered(share: float, mode: int, query_length: Column, target_length: Column) -> Column:
    """Whether the lengths alone allow the coverage."""
    q, t = query_length.cast("double"), target_length.cast("double")
    return {
        BOTH: (q / t >= share) & (t / q >= share),
        QUERY: t / q >= share,
        TARGET: q / t >= share,
        TARGET_LENGTH: (t / q >= share) & (t / q <= 1.0),
        QUERY_LENGTH: (q / t >= share) & (q / t <= 1.0),
        SHORTER_LENGTH: F.least(q, t) / F.greatest(q, t) >= share,
    }[mode]


def has_coverage(share: float, mode: int, query_coverage: Column, target_coverage: Column) -> Column:
    """Whether an alignment covers enough; modes on lengths ask nothing of it."""
    return {BOTH: (query_coverage >= share) & (target_coverage >= share), QUERY: query_coverage >= share, TARGET: target_coverage >= share}.get(mode, F.lit(True))


def swapped_mode(mode: int) -> int:
    """The mode that means the same once query and target change sides."""
    return {QUERY: TARGET, TARGET: QUERY, QUERY_LENGTH: TARGET_LENGTH, TARGET_LENGTH: QUERY_LENGTH}.get(mode, mode)


def coverage(start: Column, end: Column, length: Column) -> Column:
    low = F.least(start, end)
    return (F.least(length, F.greatest(start, end)) - low + 1) / length


def identity_share(identical: Column, alignment: Column, query_length: Column, target_length: Column, by: str = "alignment") -> Column:
    """Share of identical places by the length of the alignment, or of the shorter or longer sequence."""
    return identical / {"alignment": alignment, "shorter": F.least(query_length, target_length), "longer": F.greatest(query_length, target_length)}[by]


def estimated_identity(score: Column, query_span: Column, target_span: Column) -> Column:
    """Identity guessed from the bit score where no alignment path is known; fixed regression values."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / F.greatest(query_span, target_span) * 0.1656 + 0.1141))


def hit_order() -> list[Column]:
    """Best hits first: e-value, score, target length, target."""
    return [F.col("evalue").asc(), F.col("score").desc(), F.col("tlen").asc(), F.col("target").asc()]

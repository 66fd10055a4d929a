"""Ordered rule tables and pairwise evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def graded(rules: list[tuple[str, Column, str, Column]]) -> tuple[Column, Column]:
    """(grade, reasons): each rule is (severe name, severe, suspect name, suspect), the milder counting only where the
    severe doesn't hold. Grade 3 if any is severe, 2 if any is suspect, else 1; reasons joined by ';', OK if none.
    A null condition doesn't hold."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    reasons = [F.when(holds(s), F.lit(sn)).when(holds(m), F.lit(mn)) for sn, s, mn, m in rules]
    severe, mild = F.lit(False), F.lit(False)
    for _, s, _, m in rules:
        severe, mild = severe | holds(s), mild | (holds(m) & ~holds(s))
    text = F.concat_ws(";", *reasons)
    return F.when(severe, 3).when(mild, 2).otherwise(1), F.when(text == "", "OK").otherwise(text)


def pair_evidence(fields: dict[str, int], deciding: list[str], unique: str, left: str = "l_", right: str = "r_") -> Column:
    """Struct (evidence, contradictions, decision, strength) of two records in prefixed columns.

    A field counts where both sides have it: equal sets its evidence bit; for `deciding` fields, different sets the
    contradiction bit of its place. Decision 3 (different) on a contradiction, 2 (strong, strength 100) on an equal
    `unique`, 1 (candidate, strength the number of equal fields) on any evidence, else 0.
    """
    evidence, contradictions = F.lit(0), F.lit(0)
    for name, bit in fields.items():
        a, b = F.col(left + name), F.col(right + name)
        evidence = evidence + F.when(a == b, 1 << bit).otherwise(0)
    for i, name in enumerate(deciding):
        contradictions = contradictions + F.when(F.col(left + name) != F.col(right + name), 1 << i).otherwise(0)
    strong = F.coalesce(F.col(left + unique) == F.col(right + unique), F.lit(False))
    decision = F.when(contradictions > 0, 3).when(strong, 2).when(evidence > 0, 1).otherwise(0)
    strength = F.when(decision == 2, 100).when(decision == 1, F.bit_count(evidence)).otherwise(0)
    return F.struct(evidence.alias("evidence"), contradictions.alias("contradictions"), decision.alias("decision"), strength.cast("int").alias("strength"))


def seed_of(hash_bytes: Column) -> Column:
    """The first four bytes, little-endian, without the sign bit."""
    h = F.hex(F.substring(hash_bytes, 1, 4))
    little = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(little, 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))

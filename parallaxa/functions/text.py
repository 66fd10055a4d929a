"""Names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of the 26 Latin letters only."""
    return F.translate(text, _UPPER, _LOWER)


def ascii_contains(text: Column, part: str) -> Column:
    """Whether `part` occurs, Latin letters of either case being equal; an empty part always does."""
    return ascii_lower(text).contains(part.translate(str.maketrans(_UPPER, _LOWER)))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count as numbers and the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(
        runs,
        lambda r: F.struct(
            F.when(r.rlike(r"^\d"), 0).otherwise(1).alias("kind"),
            F.when(r.rlike(r"^\d"), r.cast("decimal(38,0)")).alias("number"),
            F.when(~r.rlike(r"^\d"), r).alias("text"),
        ),
    )


def normalized_relative(path: Column) -> Column:
    """Relative, without empty, '.' or '..' parts; null and empty paths are not."""
    p = F.coalesce(path, F.lit(""))
    return p.rlike(r"^[^/]+(/[^/]+)*$") & ~p.rlike(r"(^|/)\.\.?(/|$)")


def same_stem(a: Column, b: Column) -> Column:
    """Equal base names up to the last dot."""
    stem = lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return stem(a) == stem(b)


def human_size(size: Column) -> Column:
    """Bytes with a binary unit: whole below 1024, else one decimal."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KiB", "MiB", "GiB"), start=1):
        scaled = size / F.lit(float(1024**power))
        out = out.when(size < 1024 ** (power + 1), F.concat(F.format_number(scaled, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(size / F.lit(float(1024**4)), 1), F.lit(" TiB")))


def pressure_basis_points(line: Column) -> Column:
    """Hundredths of a percent of the one `avg10=` token of a pressure line; null if it is missing or repeated."""
    found = F.regexp_extract_all(line, F.lit(r"(?:^|\s)avg10=(\d{1,3}\.\d{2})(?=\s|$)"), 1)
    return F.when(F.size(found) == 1, F.round(found[0].cast("decimal(6,2)") * 100).cast("int"))

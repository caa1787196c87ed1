"""Text helpers (X7–X9): fixed decimals, output names, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: str | Column, digits: int) -> Column:
    """A number with a fixed number of decimals. Ties round half up on the
    shortest decimal text of the double (Java's formatter); a formatter that
    rounds the exact binary value differs on values like 1.005."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def grouped(n: Column) -> Column:
    """Integer with grouped thousands, e.g. 1,234,567."""
    return F.format_number(n.cast("double"), 0)


_SPLITEXT = r"^\.*[^.].*(\.[^.]*)$"  # extension as os.path.splitext finds it


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _split_ext(name: Column) -> Column:
    return F.regexp_extract(name, _SPLITEXT, 1)


def base_name(path: Column) -> Column:
    """File name without directories, without '.gz', without the last extension."""
    name = F.regexp_replace(_file_name(path), r"\.gz$", "")
    return F.left(name, F.length(name) - F.length(_split_ext(name)))


def compound_ext(path: Column) -> Column:
    """X8: '.csv.gz' style extension: the extension before '.gz' plus '.gz', or
    the last extension."""
    name = _file_name(path)
    inner = F.regexp_replace(name, r"\.gz$", "")
    return F.when(name.endswith(".gz"), F.concat(_split_ext(inner), F.lit(".gz"))).otherwise(_split_ext(name))


def two_digits(n: Column) -> Column:
    """A number with at least two digits (lpad alone would cut longer ones)."""
    s = n.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def part_name(path: Column, n: Column) -> Column:
    """X8: '<base>.partNN<ext>' output name of part n (more digits from 100 on)."""
    return F.concat(base_name(path), F.lit(".part"), two_digits(n), compound_ext(path))


def percent_ratio(part: Column, whole: Column) -> Column:
    """100 * part / whole, null when whole is 0."""
    return part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))


def reduction_percent(new: Column, old: Column) -> Column:
    """(1 - new/old) * 100, null when old is 0."""
    return (1 - new.cast("double") / F.nullif(old.cast("double"), F.lit(0.0))) * 100.0

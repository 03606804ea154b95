"""Column expressions that read names: dump files, work lists, bucket directories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dump_file(url: Column) -> Column:
    """The file name of a compressed monthly dump in a URL; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"([^/]*pgn\.zst)", 1), F.lit(""))


def dump_name(url: Column) -> Column:
    """The month part of a dump's name."""
    return F.nullif(F.regexp_extract(url, r"standard_rated_([0-9-]+)\.pgn\.zst", 1), F.lit(""))


def bucket_value(name: Column) -> Column:
    """2500 of 2500+ or 2500; null for any other name."""
    return F.nullif(F.regexp_extract(name, r"^(\d{1,9})\+?$", 1), F.lit("")).cast("int")


def bucket_plus(name: Column) -> Column:
    """Whether a bucket's name ends in +; null for a name that is no bucket's."""
    return F.when(bucket_value(name).isNotNull(), F.endswith(name, F.lit("+")))


def bucket_of_path(path: Column, level: int) -> Column:
    """The directory name of level 1 (outer) or 2 in .../outer/inner/name.parquet, without a partition column's name=."""
    return F.nullif(F.regexp_extract(path, r"(?:[^/=]*=)?([^/]+)/(?:[^/=]*=)?([^/]+)/[^/]*\.parquet$", level), F.lit(""))

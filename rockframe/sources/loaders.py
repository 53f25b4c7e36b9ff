"""Which reader a file gets."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from rockframe.sources import delimited, las

#: Extensions without a reader, and why.
NO_READER = {".dlis": "binary logs need a library that is not here", ".pdf": "tables of pages need a library that is not here", ".mrml": "project files hold references, not rows"}


def loader_of(path: str) -> Callable[..., DataFrame]:
    """The reader (spark, path) of a well log by its extension, whatever its case; others are an error."""
    ext = PurePosixPath(path).suffix.lower()
    if ext == ".las":
        return las.read_las
    if ext == ".csv":
        return delimited.read_well_csv
    raise NotImplementedError(f"{path}: {NO_READER.get(ext, 'no reader of this extension; there are .las and .csv')}")


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    return loader_of(path)(spark, path, **options)

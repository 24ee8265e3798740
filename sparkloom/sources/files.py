"""File sources and sinks."""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One Parquet table of a folder, as file or as directory of parts."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def list_paths(folder: str, suffix: str = ".csv") -> list[str]:
    """Paths in a folder of any file system that Spark reads (of the local disk without a session), by name."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return sorted(glob.glob(os.path.join(glob.escape(folder), f"*{suffix}")))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
    return sorted(f"{folder.rstrip('/')}/{name}" for name in found if name.endswith(suffix) and not name.startswith(("_", ".")))


def find_csv(keyword: str, folder: str) -> str:
    """The first CSV (by name) of a folder whose path holds the keyword.

    Raises FileNotFoundError when there is none.
    """
    hits = [p for p in list_paths(folder) if keyword in p]
    if not hits:
        raise FileNotFoundError(f"no CSV in {folder} matches {keyword!r}")
    return hits[0]


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with header; without a schema one is inferred. gzip files are read as they are."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def _first_number(path: str) -> tuple[int, str]:
    found = re.search(r"\d+", os.path.basename(path))
    return (int(found.group()) if found else -1, path)


def concat_files(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None, fraction: float | None = None, seed: int = 42, sort: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """All CSV files of a folder united by column name, missing columns null.

    Files are ordered by the first number in their own name (not in the folder's); ``first`` / ``last``
    keep so many files from either end, ``fraction`` samples rows with a seed.
    """
    paths = list_paths(folder)
    paths = sorted(paths, key=_first_number) if sort else paths
    if first is not None:
        paths = paths[:first]
    if last is not None:
        paths = paths[-last:] if last else []
    if not paths:
        raise FileNotFoundError(f"no CSV files to read in {folder}")
    frames = [read_csv(spark, p, schema) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.sample(fraction=fraction, seed=seed) if fraction is not None else out


def read_json_columns(spark: SparkSession, path: str, field: str = "columns") -> DataFrame:
    """A JSON document whose array ``field`` holds the records of a table (a data dictionary)."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("c")).select("c.*")


def read_addresses(spark: SparkSession, path: str, town: str, columns: Iterable[str] = ("numero", "suffixe", "nom_voie", "lon", "lat"), town_col: str = "nom_commune") -> DataFrame:
    """Rows of one town from a ``;`` separated address base (plain or gzip)."""
    df = read_csv(spark, path, sep=";")
    return df.filter(F.col(town_col) == town).select(*columns)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)

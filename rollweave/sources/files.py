"""Finding and reading input files."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..log import get_logger
from .excel import read_xlsx

logger = get_logger(__name__)
_ENDINGS = (".xlsx", ".xls")


def excel_files(folder: str, print_to_terminal: bool = False) -> list[str]:
    """Excel files right inside a local folder, sorted; endings in any case."""
    where = Path(folder)
    if not where.is_dir():
        raise FileNotFoundError(f"no folder {folder}")
    found = sorted(str(p) for p in where.iterdir() if p.is_file() and p.name.lower().endswith(_ENDINGS))
    logger.info("%d Excel file(s) in %s", len(found), folder)
    if print_to_terminal:
        print(f"{len(found)} Excel file(s) in {folder}", *found, sep="\n")
    return found


def remote_excel_files(spark: SparkSession, folder: str) -> list[str]:
    """The same for any file system that Spark reads; only names are read."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(f"no folder {folder}")
    return sorted(s.getPath().toString() for s in fs.listStatus(fs_path) if s.isFile() and s.getPath().getName().lower().endswith(_ENDINGS))


def read_excel(spark: SparkSession, paths: list[str] | str, sheet: str | int = 0) -> DataFrame:
    """A sheet of Excel files as one table of strings; files may differ in their columns.

    ``.xlsx`` files are read by the executors. The old binary ``.xls`` needs an Excel engine of pandas, and is read on the driver.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files to read")
    new, old = [p for p in paths if not p.lower().endswith(".xls")], [p for p in paths if p.lower().endswith(".xls")]
    frames = [read_xlsx(spark, new, sheet)] if new else []
    if old:
        import pandas as pd

        frames += [spark.createDataFrame(pd.read_excel(p, sheet_name=sheet, dtype=str)) for p in old]
    return union_all(frames)


def read_csv(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """CSV files with headers as one table of strings; files may differ in their columns."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files to read")
    return union_all([spark.read.csv(p, header=True, **options) for p in paths])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

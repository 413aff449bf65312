"""Reading and writing tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.sources.contracts import check_columns, check_footers, common_types


def scan_parquet(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    contract: T.StructType | None = None,
    check_files: bool = False,
) -> DataFrame:
    """Lazy scan of a file, directory or glob, pruned to ``columns``.

    With a contract the schema is checked at load; ``check_files`` looks at every file,
    see ``scan_contract``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if contract is not None and check_files:
        df = scan_contract(spark, paths, contract)
    else:
        df = spark.read.parquet(*paths)
        if contract is not None:
            check_columns(df, contract)
    return df.select(*columns) if columns else df


def scan_contract(
    spark: SparkSession, paths: Sequence[str], contract: T.StructType
) -> DataFrame:
    """The contract's columns of many files whose physical types may differ.

    Every footer is read first: a file that lacks a column, or holds another kind of
    type in it, is an error that names both. The files are grouped by the physical types
    of the columns, each group is one scan, cast to the contract, and the groups are
    put together by name. Numbers may be of any numeric type and strings stored as
    dictionaries; a column without any value may have any type. Columns that may be of
    any type keep theirs if all files agree.
    """
    files = spark.read.parquet(*paths).inputFiles()
    found = check_footers(spark, files, contract)
    types = common_types(found, contract)
    groups: dict[tuple, list[str]] = {}
    for file in sorted(files):
        groups.setdefault(tuple(sorted(found[file].items())), []).append(unquote(file))
    parts = []
    for physical, members in groups.items():
        kinds = {name: kind for name, (kind, _) in physical}
        read = spark.read.parquet(*(paths if len(groups) == 1 else members))
        parts.append(
            read.select(
                *[
                    _as_type(F.col(f.name), kinds[f.name], types[f.name]).alias(f.name)
                    for f in contract
                ]
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _as_type(column: Column, kind: str, to: T.DataType | None) -> Column:
    if kind == "null":  # no value, so any type will do
        return F.lit(None).cast(to or "string")
    return column if to is None else column.cast(to)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only a local session, which is a single
    machine, may go without and gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute a frame once, in the shared folder.

    For frames much smaller than their input that several results are made of;
    the copy outlives the executors that made it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Compute a frame once, as a table in the shared folder.

    Unlike a checkpoint it is compressed and read by column; it outlives the session, so
    the folder's owner clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), single_file: bool = False
) -> None:
    """Write a table; ``single_file`` is for summaries of a bounded number of rows."""
    # repartition, not coalesce: the work before it keeps its parallelism.
    df = df.repartition(1) if single_file else df
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a summary as CSV with a header; nulls are empty fields."""
    df = df.repartition(1) if single_file else df
    df.write.mode("overwrite").option("header", True).csv(path)

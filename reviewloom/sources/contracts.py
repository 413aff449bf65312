"""Column contracts of the two input tables and their load-time checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that are passed through as read may have any type.
ANY = T.NullType()

# The input columns in use and the types they arrive in.
REVIEWS = T.StructType(
    [
        T.StructField("appid", T.DoubleType()),
        T.StructField("game", T.StringType()),
        T.StructField("author_playtime_forever", T.DoubleType()),
        T.StructField("author_playtime_at_review", T.DoubleType()),
        T.StructField("language", T.StringType()),
        T.StructField("review", T.StringType()),
        T.StructField("timestamp_created", T.DoubleType()),
        T.StructField("voted_up", T.DoubleType()),
        T.StructField("votes_up", T.DoubleType()),
        T.StructField("weighted_vote_score", ANY),
        T.StructField("steam_purchase", T.DoubleType()),
        T.StructField("received_for_free", T.DoubleType()),
        T.StructField("written_during_early_access", T.DoubleType()),
    ]
)
REVIEW_FLAGS = [
    "voted_up",
    "steam_purchase",
    "received_for_free",
    "written_during_early_access",
]
# ``tags`` is not part of the contract: it is an empty list everywhere, whose
# element type differs between files.
GAMES = T.StructType(
    [
        T.StructField("appID", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("estimated_owners", T.StringType()),
        T.StructField("peak_ccu", ANY),
        T.StructField("price", ANY),
        T.StructField("windows", ANY),
        T.StructField("mac", ANY),
        T.StructField("linux", ANY),
        T.StructField("metacritic_score", ANY),
        T.StructField("positive", ANY),
        T.StructField("negative", ANY),
        T.StructField("recommendations", ANY),
        T.StructField("average_playtime_forever", ANY),
        T.StructField("median_playtime_forever", ANY),
        T.StructField("developers", T.ArrayType(T.StringType())),
        T.StructField("publishers", T.ArrayType(T.StringType())),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("genres", T.ArrayType(T.StringType())),
    ]
)


class ContractError(ValueError):
    """Input files do not carry the columns or kinds of types they should."""


def _fits(expected: str, actual: str) -> bool:
    if actual == "null":  # a column without any value has no type of its own
        return True
    return actual == expected or (expected == "any" and actual != "missing")


def _kind(data_type: T.DataType) -> str:
    if data_type == ANY:
        return "any"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.ArrayType):
        return "list"
    return data_type.typeName()


def _plain(data_type: pa.DataType) -> pa.DataType:
    """The type of the values: a dictionary is only a way to store them."""
    return _plain(data_type.value_type) if pa.types.is_dictionary(data_type) else data_type


def _arrow_kind(data_type: pa.DataType) -> str:
    data_type = _plain(data_type)
    if pa.types.is_integer(data_type) or pa.types.is_floating(data_type):
        return "number"
    if pa.types.is_decimal(data_type):
        return "number"
    if pa.types.is_boolean(data_type):
        return "boolean"
    if pa.types.is_string(data_type) or pa.types.is_large_string(data_type):
        return "string"
    if pa.types.is_list(data_type) or pa.types.is_large_list(data_type):
        return "list"
    return str(data_type)


def check_columns(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Return ``df`` if its schema carries the contract's columns, raise otherwise.

    Numeric columns may have any numeric type; cleaning casts them.
    """
    found = {field.name: _kind(field.dataType) for field in df.schema}
    wrong = []
    for field in contract:
        expected, actual = _kind(field.dataType), found.get(field.name, "missing")
        if not _fits(expected, actual):
            wrong.append(f"{field.name}: {expected} expected, {actual}")
    if wrong:
        raise ContractError("; ".join(wrong))
    return df


def _arrow_schema(uri: str) -> pa.Schema | None:
    """The schema in a file's footer, None if only Spark's readers can open the file."""
    try:
        # Spark's name for the S3 connector is not known to Arrow.
        filesystem, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
        with filesystem.open_input_file(path) as handle:
            return pq.read_schema(handle)
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return None


FOOTERS = "file string, columns array<struct<name: string, kind: string, type: string>>"


def footers(spark: SparkSession, files: Sequence[str], contract: T.StructType) -> DataFrame:
    """(file, columns): name, kind and physical type of each contract column a file has.

    Spark infers one schema for all files, reads a column missing from some of them as
    null and dies on one of another type, so every footer is looked at. Tasks read the
    footers, 500 each; what they cannot open, Spark's own reader looks at file by file.
    ``files`` are encoded URIs, as ``DataFrame.inputFiles`` gives them.
    """
    names = list(contract.names)

    def read_footers(batches: Iterator) -> Iterator:
        for batch in batches:
            found = []
            for uri in batch["file"]:
                schema = _arrow_schema(uri)
                if schema is not None:
                    fields = [schema.field(i) for i in range(len(schema)) if schema.names[i] in names]
                    found.append([(f.name, _arrow_kind(f.type), str(_plain(f.type))) for f in fields])
                else:
                    found.append(None)
            columns = [
                None if rows is None else [dict(zip(("name", "kind", "type"), r)) for r in rows]
                for rows in found
            ]
            yield pd.DataFrame({"file": batch["file"], "columns": pd.Series(columns, dtype="object")})

    per_task = 500
    paths = spark.createDataFrame([(f,) for f in files], "file string")
    paths = paths.repartition(max(1, -(-len(files) // per_task)), F.col("file"))
    return paths.mapInPandas(read_footers, FOOTERS)


def read_footers(
    spark: SparkSession, files: Sequence[str], contract: T.StructType
) -> dict[str, dict[str, tuple[str, str]]]:
    """For each file, kind and physical type by column; the driver holds the file list anyway."""

    def by_spark(uri: str) -> dict[str, tuple[str, str]]:
        schema = spark.read.parquet(unquote(uri)).schema
        return {
            f.name: (_kind(f.dataType), f.dataType.simpleString())
            for f in schema
            if f.name in contract.names
        }

    found = {}
    for row in footers(spark, files, contract).collect():
        columns = row.columns
        known = None if columns is None else {c.name: (c.kind, c.type) for c in columns}
        found[row.file] = by_spark(row.file) if known is None else known
    return found


def violations(
    found: dict[str, dict[str, tuple[str, str]]], contract: T.StructType
) -> list[tuple[str, str, str, str]]:
    """(file, column, expected kind, found kind) of what does not fit the contract."""
    wrong = []
    for file, columns in sorted(found.items()):
        for field in contract:
            expected, actual = _kind(field.dataType), columns.get(field.name, ("missing", ""))[0]
            if not _fits(expected, actual):
                wrong.append((file, field.name, expected, actual))
    return wrong


def check_footers(
    spark: SparkSession, files: Sequence[str], contract: T.StructType
) -> dict[str, dict[str, tuple[str, str]]]:
    """The footers of all files; raises if any file breaks the contract, naming a few."""
    found = read_footers(spark, files, contract)
    wrong = violations(found, contract)
    if wrong:
        raise ContractError(
            "; ".join(f"{f}: {name} should be {kind}, is {is_}" for f, name, kind, is_ in wrong[:5])
        )
    return found


def common_types(
    found: dict[str, dict[str, tuple[str, str]]], contract: T.StructType
) -> dict[str, T.DataType | None]:
    """The type each column is read as: the contract's, or what all files agree on.

    A column of any type stays as it is (None) where all files have one type; numbers of
    several types become doubles, other mixtures strings.
    """
    types: dict[str, T.DataType | None] = {}
    for field in contract:
        if field.dataType != ANY:
            types[field.name] = field.dataType
            continue
        held = {columns[field.name] for columns in found.values()} - {("null", "null")}
        if len(held) <= 1:
            types[field.name] = None
        elif {kind for kind, _ in held} == {"number"}:
            types[field.name] = T.DoubleType()
        else:
            types[field.name] = T.StringType()
    return types

"""Reading tables and files. No reader counts its rows; see :func:`observed_rows`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.errors import ConfigError, EmptyInputError, SchemaError, SourceError


def _attempt(what: str, build: Callable[[], DataFrame]) -> DataFrame:
    try:
        return build()
    except Exception as exc:
        raise SourceError(f"cannot read {what}: {exc}") from exc


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return _attempt(f"table {name}", lambda: spark.table(name))


def read_path(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, **options
) -> DataFrame:
    """Any path-based format by name; a lake format works when its jar is on the class path."""
    reader = spark.read.format(fmt).options(**options)
    reader = reader if schema is None else reader.schema(schema)
    return _attempt(f"{fmt} at {path}", lambda: reader.load(path))


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet files; with a schema no file has to be opened to plan the read."""
    return read_path(spark, path, "parquet", schema)


def _need_schema(kind: str, path: str, schema: StructType | None, infer: bool) -> None:
    if schema is None and not infer:
        raise SourceError(f"reading {kind} at {path} needs a schema (or allow_schema_inference=True)")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    header: bool = True,
    allow_schema_inference: bool = False,
    sep: str = ",",
) -> DataFrame:
    _need_schema("CSV", path, schema, allow_schema_inference)
    reader = spark.read.options(header=header, sep=sep)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return _attempt(f"CSV at {path}", lambda: reader.csv(path))


def read_json(
    spark: SparkSession, path: str, schema: StructType | None = None, allow_schema_inference: bool = False
) -> DataFrame:
    """JSON lines."""
    _need_schema("JSON", path, schema, allow_schema_inference)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return _attempt(f"JSON at {path}", lambda: reader.json(path))


@dataclass(frozen=True)
class JdbcPartitions:
    """How a JDBC table is read in parallel: a numeric or date column, its bounds and the number of slices."""

    column: str
    lower: int | str
    upper: int | str
    slices: int

    def options(self) -> dict[str, str]:
        if self.slices < 1:
            raise ConfigError("a JDBC read needs at least one slice")
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.slices),
        }


def has_credentials(properties: dict[str, str]) -> bool:
    return bool(properties.get("user")) and bool(properties.get("password"))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    partitions: JdbcPartitions | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A database table; without ``partitions`` it is read through one connection."""
    if not has_credentials(properties):
        raise SourceError("a JDBC read needs 'user' and 'password'")
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if partitions is not None:
        options.update(partitions.options())
    return _attempt(f"JDBC table {table}", lambda: spark.read.format("jdbc").options(**options).load())


@dataclass(frozen=True)
class Source:
    """Where a dataset lives: ``table`` by name, or ``csv``, ``json``, ``parquet``, ``jdbc`` or another format by path."""

    kind: str
    location: str
    schema: StructType | None = None
    options: dict = field(default_factory=dict)


def load(spark: SparkSession, source: Source) -> DataFrame:
    """Read a :class:`Source`."""
    if source.kind == "table":
        return read_table(spark, source.location)
    if source.kind == "csv":
        return read_csv(spark, source.location, source.schema, **source.options)
    if source.kind == "json":
        return read_json(spark, source.location, source.schema, **source.options)
    if source.kind == "jdbc":
        return read_jdbc(spark, table=source.location, **source.options)
    if source.kind in ("parquet", "orc", "delta"):
        return read_path(spark, source.location, source.kind, source.schema, **source.options)
    raise ConfigError(f"unknown source kind {source.kind!r}")


def require_non_empty(df: DataFrame, name: str) -> DataFrame:
    """The frame itself, or an error when it has no rows; stops at the first row found."""
    if df.isEmpty():
        raise EmptyInputError(f"{name} has no rows")
    return df


def schema_problems(schema: StructType, expected: StructType) -> list[tuple[str, str, str | None]]:
    """(field, expected type, actual type) of expected fields that are missing or of another type."""
    have = {f.name: f.dataType.simpleString() for f in schema.fields}
    return [
        (f.name, f.dataType.simpleString(), have.get(f.name))
        for f in expected.fields
        if have.get(f.name) != f.dataType.simpleString()
    ]


def validate_schema(df: DataFrame, expected: StructType, name: str = "input") -> DataFrame:
    """The frame itself, or an error naming the wrong fields. Extra fields and nullability do not matter."""
    problems = schema_problems(df.schema, expected)
    if problems:
        text = ", ".join(f"{field}: expected {want}, found {have or 'nothing'}" for field, want, have in problems)
        raise SchemaError(f"{name}: {text}")
    return df


def observed_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame with a row counter that fills in as part of the next action on it.

    Spark 4.1 cannot ship a model fitted in a session to executors once that
    session has an Observation; save and load the model, or count without this.
    """
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n")), observation

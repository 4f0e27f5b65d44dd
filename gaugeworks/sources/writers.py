"""Guarded writes. Rows are counted from the files that a write added, and from no others."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from gaugeworks.errors import EmptyInputError, SinkError
from gaugeworks.sources.readers import has_credentials

MODES = ("append", "overwrite", "errorifexists", "ignore")
PRODUCTION = "prd"


@dataclass(frozen=True)
class WriteOptions:
    """What a write may do.

    ``overwrite`` in the production environment needs ``allow_prd_overwrite``; a
    dry run checks everything, counts the rows and writes nothing. ``count_rows``
    set to False leaves the written rows uncounted.
    """

    mode: str = "errorifexists"
    partition_by: tuple[str, ...] = ()
    environment: str = "dev"
    allow_prd_overwrite: bool = False
    dry_run: bool = False
    count_rows: bool = True


@dataclass(frozen=True)
class WriteResult:
    destination: str
    mode: str
    row_count: int | None
    written: bool


def check_write(df: DataFrame, destination: str, options: WriteOptions) -> None:
    """Mode, then emptiness, then production overwrite, then partition columns."""
    if options.mode not in MODES:
        raise SinkError(f"unknown write mode {options.mode!r}; use one of {', '.join(MODES)}")
    if df.isEmpty():
        raise EmptyInputError(f"nothing to write to {destination}")
    if options.mode == "overwrite" and options.environment == PRODUCTION and not options.allow_prd_overwrite:
        raise SinkError(f"overwriting {destination} in {PRODUCTION} needs allow_prd_overwrite=True")
    missing = [c for c in options.partition_by if c not in df.columns]
    if missing:
        raise SinkError(f"partition column(s) not in the data: {', '.join(missing)}")


#: Formats whose files can be counted one by one.
_COUNTED = ("parquet", "orc", "json", "csv")


def _files(stored: Callable[[], DataFrame]) -> set[str]:
    """Names of the target's files, none when it does not exist; no file is opened."""
    try:
        return set(stored().inputFiles())
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return set()
        raise


def _write(
    df: DataFrame,
    destination: str,
    options: WriteOptions,
    save: Callable[[DataFrameWriter], None],
    stored: Callable[[], DataFrame] | None = None,
    rows_in: Callable[[list[str]], DataFrame] | None = None,
) -> WriteResult:
    """Check, write, count.

    ``stored`` reads the target and ``rows_in`` a list of its files: the files that
    are new after the write are counted, Parquet and ORC from their footers.
    Without them, or without ``count_rows``, the number of rows is not known.
    """
    check_write(df, destination, options)
    if options.dry_run:
        return WriteResult(destination, options.mode, df.count(), False)
    counted = stored is not None and rows_in is not None and options.count_rows
    before = _files(stored) if counted else set()
    writer = df.write.mode(options.mode)
    if options.partition_by:
        writer = writer.partitionBy(*options.partition_by)
    try:
        save(writer)
    except Exception as exc:
        raise SinkError(f"cannot write {destination}: {exc}") from exc
    if not counted:
        return WriteResult(destination, options.mode, None, True)
    added = sorted(_files(stored) - before)
    n = rows_in(added).count() if added else 0
    return WriteResult(destination, options.mode, n, n > 0)


def _by_path(df: DataFrame, path: str, fmt: str, **settings) -> dict:
    """How the files of a folder are listed, with a known schema, and counted."""
    if fmt not in _COUNTED:
        return {}
    spark = df.sparkSession

    def rows_in(files: list[str]) -> DataFrame:
        # One line of text is one row of JSON.
        return spark.read.text(files) if fmt == "json" else spark.read.format(fmt).options(**settings).load(files)

    return {"stored": lambda: spark.read.format(fmt).schema(df.schema).load(path), "rows_in": rows_in}


def write_table(
    df: DataFrame, name: str, options: WriteOptions, fmt: str = "parquet", path: str | None = None
) -> WriteResult:
    """A catalog table; managed unless ``path`` is given."""

    def save(writer: DataFrameWriter) -> None:
        writer = writer.format(fmt)
        (writer if path is None else writer.option("path", path)).saveAsTable(name)

    counted = {**_by_path(df, "", fmt), "stored": lambda: df.sparkSession.table(name)} if fmt in _COUNTED else {}
    return _write(df, name, options, save, **counted)


def write_path(df: DataFrame, path: str, options: WriteOptions, fmt: str = "parquet") -> WriteResult:
    return _write(df, path, options, lambda w: w.format(fmt).save(path), **_by_path(df, path, fmt))


def write_parquet(df: DataFrame, path: str, options: WriteOptions) -> WriteResult:
    return write_path(df, path, options, "parquet")


def write_csv(df: DataFrame, path: str, options: WriteOptions, header: bool = True, sep: str = ",") -> WriteResult:
    """For exports."""
    counted = _by_path(df, path, "csv", header=header, sep=sep, multiLine=True)
    return _write(df, path, options, lambda w: w.options(header=header, sep=sep).csv(path), **counted)


def write_json(df: DataFrame, path: str, options: WriteOptions) -> WriteResult:
    return write_path(df, path, options, "json")


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    properties: dict[str, str],
    options: WriteOptions,
    connections: int = 8,
    batch_size: int = 10_000,
) -> WriteResult:
    """A database table; credentials are checked before anything else, and connections are limited."""
    if not has_credentials(properties):
        raise SinkError("a JDBC write needs 'user' and 'password'")
    jdbc = {
        "url": url,
        "dbtable": table,
        "numPartitions": str(connections),
        "batchsize": str(batch_size),
        **properties,
    }
    return _write(df, table, options, lambda w: w.format("jdbc").options(**jdbc).save())


def write_report(df: DataFrame, path: str, run_id: str, keys: Sequence[str] = (), fmt: str = "parquet") -> None:
    """Add one run to a report table, partitioned by ``run_id``.

    Writing the same run again replaces it, so a retried job leaves one copy.
    """
    tagged = df.withColumn("run_id", F.lit(run_id))
    (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", *keys)
        .format(fmt)
        .save(path)
    )


def write_sections(sections: Mapping[str, DataFrame], folder: str, run_id: str, fmt: str = "parquet") -> None:
    """Add one run to a report of several tables, one per section, such as a profile's."""
    for name, rows in sections.items():
        write_report(rows, f"{folder.rstrip('/')}/{name}", run_id, fmt=fmt)

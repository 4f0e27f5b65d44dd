"""Tables with one row per key: upsert, versions, change feed.

A table is a database of the catalog at a folder, and each version a table in
it, bucketed by the key. An upsert joins the last version with the batch: only
the batch is shuffled, to the buckets the version already has, and the result
is written as the next version. It becomes that version by being renamed, which
the catalog allows one writer only, so of two writers of one version the second
fails and changes nothing. No version is changed afterwards: readers are not
disturbed, and a job that dies half way leaves the table as it was.

Each row knows the version in which it last changed. The change feed of a
version is its rows of that number next to the version before, joined bucket by
bucket.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType

from gaugeworks.errors import EmptyInputError, FeatureError, SinkError, SourceError
from gaugeworks.functions.columns import all_set, name_of
from gaugeworks.operators.features import FeatureSpec, feature_lookup, training_set
from gaugeworks.sources.writers import WriteResult
from gaugeworks.workspace import fresh_path

_CHANGED = "__changed_in"
_WIDTHS = (ByteType(), ShortType(), IntegerType(), LongType())
#: Key buckets whose digests are compared before two states are joined.
DIGESTS = 4096


@dataclass(frozen=True)
class Commit:
    """What is known of a version: its number, when and from how many rows it was made, and the last batch of each source in it."""

    version: int
    row_count: int
    committed_at: datetime
    sources: dict[str, int | None]


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.database = f"keyed_{hashlib.md5(self.path.encode()).hexdigest()}"

    # -- versions ---------------------------------------------------------

    def versions(self) -> list[int]:
        """The numbers of the versions that are kept, oldest first."""
        if not self.spark.catalog.databaseExists(self.database):
            return []
        return sorted(int(t.name[1:]) for t in self.spark.catalog.listTables(self.database, "v*"))

    def commit(self, version: int) -> Commit:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(version)}").collect()
        found = {r["key"]: r["value"] for r in rows}
        at = datetime.fromisoformat(found["committed_at"])
        return Commit(version, int(found["row_count"]), at, json.loads(found["sources"]))

    def commits(self) -> list[Commit]:
        return [self.commit(v) for v in self.versions()]

    def exists(self) -> bool:
        return bool(self.versions())

    def _name(self, version: int | str) -> str:
        return f"{self.database}.{version}" if isinstance(version, str) else f"{self.database}.v{version}"

    def _state(self, version: int) -> DataFrame:
        return self.spark.table(self._name(version))

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the latest when none is given."""
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise SourceError(f"no version {'at all' if version is None else version} in {self.path}")
        return self._state(versions[-1] if version is None else version).drop(_CHANGED)

    def drop_before(self, version: int) -> None:
        """Drop older versions and their files; the change feed then starts after the oldest one left."""
        for old in self.versions():
            if old < version:
                self.spark.sql(f"DROP TABLE {self._name(old)}")

    # -- writing ----------------------------------------------------------

    def upsert(
        self, batch: DataFrame, dry_run: bool = False, source: str | None = None, source_batch: int | None = None
    ) -> WriteResult:
        """Replace rows with the same key, add the others; the first upsert creates the table.

        The numbers of a source's batches grow: one that is not above the last
        committed number of its source is skipped, which makes a repeated micro-batch
        harmless. Columns may come in another order, and with a narrower number type;
        any other difference is refused, and so is a key that repeats. Rows with a
        NULL key replace nothing. When another writer commits the same version first,
        this one fails with :class:`SinkError`.
        """
        if not self.keys:
            raise SinkError("an upsert needs at least one key column")
        missing = [k for k in self.keys if k not in batch.columns]
        if missing:
            raise SinkError(f"key column(s) not in the batch: {', '.join(missing)}")
        if dry_run:
            return WriteResult(self.path, "upsert", self._not_empty(batch.count()), False)
        versions = self.versions()
        sources = dict(self.commit(versions[-1]).sources) if versions else {}
        if source is not None and source in sources and (source_batch or 0) <= (sources[source] or 0):
            return WriteResult(self.path, "upsert", 0, False)
        if source is not None:
            sources[source] = source_batch
        # Stored first, so that the batch is computed once.
        aligned = self._aligned(batch, versions)
        staged = fresh_path(self.spark, "batch")
        aligned.write.parquet(staged)
        rows = self.spark.read.schema(aligned.schema).parquet(staged)
        n = self._checked_count(rows)
        version = versions[-1] + 1 if versions else 0
        merged = self._merged(rows, versions[-1], version) if versions else rows.withColumn(_CHANGED, F.lit(0).cast("bigint"))
        self._publish(merged, version, n, sources)
        return WriteResult(self.path, "upsert", n, True)

    def _merged(self, batch: DataFrame, last: int, version: int) -> DataFrame:
        """The last version with the batch in it, joined bucket by bucket; rows with a NULL key need no join."""
        old, now = self._state(last), F.lit(version).cast("bigint")
        payload = [c for c in batch.columns if c not in self.keys]
        known = all_set(self.keys)
        was = old.where(known).select(*self.keys, F.struct(*payload, _CHANGED).alias("__old"))
        new = batch.where(known).select(*self.keys, F.struct(*[F.col(c) for c in payload], F.lit(1).alias("__in")).alias("__new"))
        both = was.join(new, self.keys, "full_outer")
        a, b = F.col("__old"), F.col("__new")
        same = F.lit(True)
        for c in payload:
            same = same & a[c].eqNullSafe(b[c])
        kept = b.isNull() | (a.isNotNull() & same)
        merged = both.select(
            *self.keys,
            *[F.when(b.isNull(), a[c]).otherwise(b[c]).alias(c) for c in payload],
            F.when(kept, a[_CHANGED]).otherwise(now).alias(_CHANGED),
        )
        loose = old.where(~known).unionByName(batch.where(~known).withColumn(_CHANGED, now))
        return merged.unionByName(loose).select(*batch.columns, _CHANGED)

    def _publish(self, rows: DataFrame, version: int, row_count: int, sources: dict[str, int | None]) -> None:
        sql = self.spark.sql
        sql(f"CREATE DATABASE IF NOT EXISTS {self.database} LOCATION '{self.path}'")
        attempt = self._name(f"attempt_{uuid.uuid4().hex}")
        rows.write.format("parquet").bucketBy(self.buckets, *self.keys).saveAsTable(attempt)
        at = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        known = json.dumps(sources).replace("\\", "\\\\").replace("'", "\\'")
        sql(f"ALTER TABLE {attempt} SET TBLPROPERTIES ('committed_at' = '{at}', 'row_count' = '{row_count}', 'sources' = '{known}')")
        try:
            sql(f"ALTER TABLE {attempt} RENAME TO {self._name(version)}")
        except AnalysisException as exc:
            sql(f"DROP TABLE {attempt}")
            if "ALREADY_EXISTS" in (exc.getCondition() or ""):
                raise SinkError(f"version {version} of {self.path} was committed by another writer") from None
            raise

    def _aligned(self, batch: DataFrame, versions: Sequence[int]) -> DataFrame:
        if not versions:
            return batch
        kinds = {f.name: f.dataType for f in self._state(versions[-1]).drop(_CHANGED).schema.fields}
        if set(kinds) != set(batch.columns):
            raise SinkError(f"columns of the batch differ from the table: {sorted(set(kinds) ^ set(batch.columns))}")
        other = [c for c, kind in kinds.items() if not _fits(batch.schema[c].dataType, kind)]
        if other:
            told = ", ".join(f"{c} is {batch.schema[c].dataType.simpleString()}, not {kinds[c].simpleString()}" for c in other)
            raise SinkError(f"types of the batch differ from the table: {told}")
        return batch.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])

    def _checked_count(self, batch: DataFrame) -> int:
        """Rows of the batch, or an error when there are none or a key repeats."""
        per_key = batch.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"))
        found = per_key.agg(F.sum("n").alias("rows"), F.max(F.when(all_set(self.keys), F.col("n"))).alias("most")).first()
        if (found["most"] or 0) > 1:
            raise SinkError("the batch has more than one row for some key")
        return self._not_empty(found["rows"])

    def _not_empty(self, n: int) -> int:
        if not n:
            raise EmptyInputError(f"nothing to upsert into {self.path}")
        return n

    # -- change feed ------------------------------------------------------

    def changes(self, starting_version: int | None = None, starting_timestamp: datetime | None = None) -> DataFrame:
        """Rows changed by the upserts from a version or time on; the version wins when both are given.

        ``_change_type`` is insert, update_preimage or update_postimage; a row
        written again without a difference is no change. A time with a zone is that
        instant, one without is in the session's time zone.
        """
        if starting_version is None and starting_timestamp is None:
            raise SourceError("an incremental read needs starting_version or starting_timestamp")
        versions = self.versions()
        if starting_version is None:
            starting_version = self._version_at(versions, starting_timestamp)
        new = [v for v in versions if v >= starting_version]
        if not new or (starting_version > 0 and new[0] > 0 and new[0] - 1 not in versions):
            raise SourceError(f"no version {starting_version} or later with the one before it in {self.path}")
        found = None
        for version in new:
            part = self._changes_in(version)
            found = part if found is None else found.unionByName(part)
        return found

    def _changes_in(self, version: int) -> DataFrame:
        rows = self._state(version).where(F.col(_CHANGED) == version)
        payload = [c for c in rows.columns if c not in self.keys and c != _CHANGED]
        if version == 0:
            changed = rows.withColumn("_change_type", F.lit("insert"))
        else:
            known = all_set(self.keys)
            before = self._state(version - 1).where(known).select(*self.keys, F.struct(*payload, _CHANGED).alias("__before"))
            changed = _change_rows(rows.join(before, self.keys, "left"), payload)
        return changed.drop(_CHANGED).withColumn("_commit_version", F.lit(version).cast("bigint"))

    def _version_at(self, versions: Sequence[int], time: datetime) -> int:
        """The first version committed at or after a time."""
        if time.tzinfo is None:
            # The instant that this wall clock time is in the session's zone, as Spark reads it.
            row = self.spark.range(1).select(F.unix_micros(F.to_timestamp(F.lit(time.isoformat(sep=" "))))).first()
            time = datetime.fromtimestamp(row[0] // 1_000_000, timezone.utc).replace(microsecond=row[0] % 1_000_000)
        found = [v for v in versions if self.commit(v).committed_at >= time]
        if not found:
            raise SourceError(f"no commit at or after {time}")
        return found[0]


def _fits(given: DataType, kind: DataType) -> bool:
    """Whether values of a type can be stored as another without loss: the same, or a wider number of its family."""
    if given in _WIDTHS and kind in _WIDTHS:
        return _WIDTHS.index(given) <= _WIDTHS.index(kind)
    return given.simpleString() == kind.simpleString() or (given == FloatType() and kind == DoubleType())


def _change_rows(paired: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Rows with a ``__before`` image become one insert, or a pre and a post image where they differ."""
    keep = [c for c in paired.columns if c not in payload and c != "__before"]
    before = F.col("__before")

    def image(kind: str, source: Callable[[str], Column]) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), *[source(c).alias(c) for c in payload])

    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(before[c])
    updated = F.array(image("update_preimage", lambda c: before[c]), image("update_postimage", F.col))
    events = F.when(before.isNull(), F.array(image("insert", F.col))).otherwise(updated)
    differing = paired.where(before.isNull() | ~same)
    return differing.select(*keep, F.explode(events).alias("__e")).select(*keep, "__e.*")


def snapshot_changes(
    before: DataFrame, after: DataFrame, keys: Sequence[str], version: int | None = None, digests: int = DIGESTS
) -> DataFrame:
    """What turns one state of a table into another, with ``_change_type`` and ``_commit_version``.

    Both states have one row per key. Values are compared NULL-safe. A row with a
    NULL key matches nothing: it is a delete in the old state, an insert in the new.

    Keys are dealt into ``digests`` buckets. Each state is first reduced to a digest
    per bucket: the number of rows, and sum and XOR of two hashes of each. Only rows
    of buckets whose digests differ are shuffled and joined. Columns that can't be
    hashed are compared in all buckets; so are all of them with ``digests=0``.
    """
    keys = list(keys)
    payload = [c for c in after.columns if c not in keys]
    known = all_set(keys)
    hashable = all(not f.dataType.simpleString().startswith(("map", "variant")) for f in after.schema.fields)
    if digests and hashable and before.select(*after.columns).dtypes == after.dtypes:
        differ = _differing_buckets(before.where(known), after.where(known), keys, after.columns, digests)
        in_bucket = lambda df: df.where(known).withColumn("__bucket", _bucket(keys, digests)).join(
            F.broadcast(differ), "__bucket", "left_semi"
        )
    else:
        in_bucket = lambda df: df.where(known)

    def side(df: DataFrame, name: str) -> DataFrame:
        return in_bucket(df).select(*keys, F.struct(*payload, F.lit(1).alias("__in")).alias(name))

    old, new = F.col("__old"), F.col("__new")
    both = side(before, "__old").join(side(after, "__new"), keys, "full_outer")
    same = F.lit(True)
    for c in payload:
        same = same & old[c].eqNullSafe(new[c])

    def image(kind: str, source: Column) -> Column:
        return F.struct(F.lit(kind).alias("_change_type"), *[source[c].alias(c) for c in payload])

    events = (
        F.when(old.isNull(), F.array(image("insert", new)))
        .when(new.isNull(), F.array(image("delete", old)))
        .otherwise(F.array(image("update_preimage", old), image("update_postimage", new)))
    )
    changed = both.where(old.isNull() | new.isNull() | ~same).select(*keys, F.explode(events).alias("__e"))
    rows = changed.select(*keys, "__e.*")
    for df, kind in ((before, "delete"), (after, "insert")):
        rows = rows.unionByName(df.where(~known).withColumn("_change_type", F.lit(kind)))
    return rows.withColumn("_commit_version", F.lit(version).cast("bigint"))


def _bucket(keys: Sequence[str], digests: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(digests))


def _differing_buckets(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], digests: int) -> DataFrame:
    """The buckets, at most ``digests``, in which the two states are not the same rows."""
    signed = None
    for df, sign in ((before, 1), (after, -1)):
        listed = ", ".join(name_of(c) for c in columns)
        # Telling NULL from its place in the row: the hash skips NULLs.
        nulls = "concat(" + ", ".join(f"if({name_of(c)} IS NULL, '1', '0')" for c in columns) + ")"
        part = df.select(
            _bucket(keys, digests).alias("__bucket"),
            F.expr(f"xxhash64({nulls}, {listed})").alias("h"),
            F.expr(f"xxhash64('other', {listed}, {nulls})").alias("g"),
            F.lit(sign).alias("sign"),
        )
        signed = part if signed is None else signed.unionByName(part)
    sums = signed.groupBy("__bucket").agg(
        F.sum("sign").alias("n"),
        F.expr("sum(CAST(h AS DECIMAL(20,0)) * sign) AS total"),
        F.bit_xor("g").alias("mixed"),
    )
    return sums.where("n <> 0 OR total <> 0 OR mixed <> 0").select("__bucket")


class FeatureStore:
    """Feature tables by name under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, spec: FeatureSpec) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/{spec.table.replace('.', '_')}", spec.keys)

    @property
    def _register(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/registered_tables", ["table_name"])

    def write(self, features: DataFrame, spec: FeatureSpec, at: Column | None = None) -> WriteResult:
        """Create the table or upsert into it; with a time, the table is also entered in the list of tables."""
        done = self.table(spec).upsert(features)
        if at is not None:
            self._register.upsert(self._record(spec, at))
        return done

    def _record(self, spec: FeatureSpec, at: Column) -> DataFrame:
        names = lambda columns: F.array(*[F.lit(c) for c in columns])
        return self.spark.range(1, numPartitions=1).select(
            F.lit(spec.table).alias("table_name"),
            names(spec.keys).alias("lookup_keys"),
            names(spec.features).alias("feature_names"),
            F.lit(spec.timestamp).alias("timestamp_column"),
            at.alias("updated_at"),
        )

    def tables(self) -> DataFrame:
        """The feature tables that were written with a time: name, keys, features, timestamp column, last update."""
        if not self._register.exists():
            raise FeatureError(f"no feature table is listed in {self.folder}")
        return self._register.read()

    def provenance(self, spec: FeatureSpec, label: str) -> DataFrame:
        """What a training set from the table's latest version is made of, one row."""
        version = self.table(spec).versions()[-1]
        listed = self.tables().where(F.col("table_name") == spec.table)
        return listed.withColumns({"label": F.lit(label), "table_version": F.lit(version)})

    def read(self, spec: FeatureSpec) -> DataFrame:
        table = self.table(spec)
        if not table.exists():
            raise FeatureError(f"feature table {spec.table} does not exist; run the feature job first")
        return table.read()

    def training_set(self, labels: DataFrame, spec: FeatureSpec, label: str) -> DataFrame:
        return training_set(labels, self.read(spec), spec, label)

    def lookup(self, keys_df: DataFrame, spec: FeatureSpec) -> DataFrame:
        return feature_lookup(keys_df, self.read(spec), spec)

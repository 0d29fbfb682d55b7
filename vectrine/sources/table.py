"""A collection of vector records: upserts, reads, updates and deletes on versioned Parquet files.

Nothing is rewritten in place. A write adds files and a deletion vector for the
rows that it replaces; ``compact`` folds them. Reads have no side effects: an
access is noted by ``touch`` in a log that ``fold_accesses`` applies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from vectrine.functions.vectors import magnitude
from vectrine.operators.filters import compile_filter
from vectrine.session import materialize
from vectrine.sources.versioned import FILE, POSITION, VersionedTable

SCHEMA = "id string, vector array<float>, metadata string, magnitude double, format string, normalized boolean, timestamp bigint, last_accessed bigint, access_count bigint"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


BAD_RECORD = "a record has no id, or a vector of another dimension"


class NotFound(KeyError):
    """No record has this id."""


@F.pandas_udf(StringType())
def merge_metadata(old: pd.Series, new: pd.Series) -> pd.Series:
    """Top-level fields of both objects, those of the new one winning; text that is no object counts as empty."""

    def obj(t: str | None) -> dict:
        try:
            found = json.loads(t) if t else {}
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    return pd.Series([json.dumps(obj(a) | obj(b)) for a, b in zip(old, new)])


@F.pandas_udf(MapType(StringType(), StringType()))
def metadata_fields(text: pd.Series) -> pd.Series:
    """Top-level fields of an object as JSON texts, their names too; none of text that is no object."""

    def fields(t: str | None) -> dict:
        try:
            found = json.loads(t) if t else {}
        except ValueError:
            return {}
        return {json.dumps(k): json.dumps(v) for k, v in found.items()} if isinstance(found, dict) else {}

    return text.map(fields)


def measured(rows: DataFrame) -> DataFrame:
    """With the length of the vector, and whether it is 1."""
    return rows.withColumn("magnitude", magnitude(F.col("vector"))).withColumn("normalized", F.abs(F.col("magnitude") - 1) < 1e-6)


def last_of_each(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Of rows with the same id the one of the greatest ``seq``."""
    others = [c for c in rows.columns if c != "id"]
    kept = rows.groupBy("id").agg(F.max_by(F.struct(*others), F.col(seq)).alias("r"))
    return kept.select("id", *[F.col(f"r.{c}").alias(c) for c in others])


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose id isn't among them."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


class VectorTable:
    """Records of one dimension at ``path``."""

    def __init__(self, spark: SparkSession, path: str, dimension: int):
        if not isinstance(dimension, int) or not 1 <= dimension <= 100_000:
            raise ValueError(f"a dimension is a whole number from 1 to 100000, not {dimension!r}")
        self.spark, self.dimension, self.files = spark, dimension, VersionedTable(spark, path)

    def all(self) -> DataFrame:
        """All records."""
        return self.files.read() if self.files.versions() else self.spark.createDataFrame([], SCHEMA)

    def count(self) -> int:
        return self.all().count()

    def _rows(self, base: dict) -> DataFrame:
        """Records of a version."""
        return self.files.read(base["version"]) if base["version"] else self.spark.createDataFrame([], SCHEMA)

    def _positions(self, ids: DataFrame, base: dict) -> DataFrame:
        """Where the ids are in a version. What is written on it has to be committed on it, too."""
        if not base["version"]:
            return self.spark.createDataFrame([], f"{FILE} string, {POSITION} long")
        rows = self.files.read(base["version"], positions=True)
        return rows.select("id", FILE, POSITION).join(ids.select("id").distinct(), "id", "left_semi").select(FILE, POSITION)

    def put(self, rows: DataFrame, now_ms: int, seq: str | None = None, about: dict | None = None) -> int:
        """Adds records, replacing those of the same id, metadata and counts included. Returns the version.

        Of repeated ids in ``rows`` the greatest ``seq`` counts, without one any.
        All rows are checked before anything is written. ``about`` is saved with
        the commit.
        """
        v = F.col("vector")
        bad = F.coalesce((F.col("id") == "") | (F.size("vector") != self.dimension), F.lit(True)) | v.isNull()
        checked = rows.withColumn("id", F.when(bad, F.raise_error(F.lit(BAD_RECORD))).otherwise(F.col("id")))
        one = last_of_each(checked, seq) if seq else checked.dropDuplicates(["id"])
        has = one.columns
        given = lambda c, other, kind: F.coalesce(F.col(c).cast(kind), other) if c in has else other
        length = magnitude(v)
        full = one.select(
            "id", v.cast("array<float>").alias("vector"), given("metadata", F.lit(None).cast("string"), "string").alias("metadata"), length.alias("magnitude"), given("format", F.lit("float32"), "string").alias("format"),
            (F.abs(length - 1) < 1e-6).alias("normalized"), given("timestamp", F.lit(now_ms), "bigint").cast("bigint").alias("timestamp"), F.lit(now_ms).cast("bigint").alias("last_accessed"), F.lit(0).cast("bigint").alias("access_count"),
        )
        try:
            full = materialize(full, "put")
        except Exception as e:
            if BAD_RECORD in str(e):
                raise ValueError(BAD_RECORD) from None
            raise

        def write(base: dict) -> int:
            return self.files.commit(add=full, delete=self._positions(full, base) if base["version"] else None, about={**base["about"], **(about or {})}, base=base)

        return self.files.retry(write)

    def get(self, key: str) -> dict | None:
        """The record, or None."""
        found = self.all().where(F.col("id") == key).limit(1).collect()
        return found[0].asDict() if found else None

    def get_many(self, ids: DataFrame) -> DataFrame:
        """Records of the ids (a column ``id``); missing ones are skipped."""
        return self.all().join(ids.select("id").distinct(), "id", "left_semi")

    def exists(self, key: str) -> bool:
        return not self.all().where(F.col("id") == key).select("id").isEmpty()

    def where(self, condition: dict | Column) -> DataFrame:
        """Records that meet a metadata filter or a condition."""
        return self.all().where(compile_filter(condition) if isinstance(condition, dict) else condition)

    def page(self, after: str | None = None, size: int = 500) -> DataFrame:
        """The next records in the order of ids."""
        rows = self.all()
        return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(size)

    def pages(self, size: int = 500) -> Iterator[list]:
        """All records page by page: one sort, pulled partition by partition."""
        page = []
        for row in self.all().orderBy("id").toLocalIterator():
            page.append(row)
            if len(page) == size:
                yield page
                page = []
        if page:
            yield page

    def delete(self, ids: DataFrame) -> int:
        """Removes records and returns how many there were; missing ids are no error."""

        def write(base: dict) -> int:
            gone = materialize(self._positions(ids, base), "gone")
            n = gone.count()
            if n:
                self.files.commit(delete=gone, base=base)
            return n

        return self.files.retry(write)

    def clear(self) -> None:
        """Removes all records, in a version of its own."""
        if self.files.versions():
            self.files.retry(lambda base: self.files.commit(remove_files=tuple(base["files"]), base=base))

    def destroy(self) -> None:
        """Deletes all files."""
        from vectrine.session import drop

        drop(self.spark, self.files.path)
        self.files = VersionedTable(self.spark, self.files.path)

    def compact(self) -> int:
        return self.files.compact()

    def _change(self, key: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces a record by what ``change`` makes of it; :class:`NotFound` if there is none."""

        def write(base: dict) -> None:
            row = self._rows(base).where(F.col("id") == key)
            if row.isEmpty():
                raise NotFound(key)
            self._replace(change(row), base)

        self.files.retry(write)

    def _replace(self, rows: DataFrame, base: dict) -> None:
        rows = materialize(rows.select(*COLUMNS), "replaced")
        self.files.commit(add=rows, delete=self._positions(rows, base), base=base)

    def update_vector(self, key: str, vector: list[float], now_ms: int, keep_timestamp: bool = False) -> None:
        """New vector of a record, its length recomputed; :class:`NotFound` if there is none."""
        if len(vector) != self.dimension:
            raise ValueError(f"the vector has {len(vector)} elements, the table {self.dimension}")

        def change(row: DataFrame) -> DataFrame:
            new = measured(row.withColumn("vector", F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")))
            return new if keep_timestamp else new.withColumn("timestamp", F.lit(now_ms).cast("bigint"))

        self._change(key, change)

    def update_metadata(self, key: str, metadata: dict, merge: bool = True, now_ms: int | None = None) -> None:
        """Merges, or replaces, the metadata of a record."""
        text = F.lit(json.dumps(metadata))

        def change(row: DataFrame) -> DataFrame:
            new = row.withColumn("metadata", merge_metadata(F.col("metadata"), text) if merge else text)
            return new if now_ms is None else new.withColumn("timestamp", F.lit(now_ms).cast("bigint"))

        self._change(key, change)

    def update_batch(self, changes: DataFrame, now_ms: int, seq: str | None = None) -> dict:
        """Applies ``(id, vector?, metadata?)`` rows, metadata always merged: ``{succeeded, failed, errors}``.

        Rows of the same id are applied in the order of ``seq``, without one in
        that of the rows as they are read. Null fields keep the old value. A row
        fails as a whole if its vector has another dimension, or no record has
        its id; ``errors`` is a table ``(id, error)`` of all of them. The other
        numbers count rows, too.
        """
        has_v, has_m = "vector" in changes.columns, "metadata" in changes.columns
        rows = changes.select(
            "id", (F.col(seq) if seq else F.monotonically_increasing_id()).alias("_seq"),
            (F.col("vector").cast("array<float>") if has_v else F.lit(None).cast("array<float>")).alias("_v"), (F.col("metadata") if has_m else F.lit(None).cast("string")).alias("_m"),
        )
        rows = materialize(rows, "changes")
        wrong = F.coalesce(F.col("_v").isNotNull() & (F.size("_v") != self.dimension), F.lit(False))
        fit = rows.where(~wrong)
        # the last vector and the last value of each top-level field, so that an id of any number of rows is reduced on the way
        vectors = fit.groupBy("id").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_seq"))).alias("_v"), F.count(F.lit(1)).alias("_n"))
        fields = fit.where(F.col("_m").isNotNull()).select("id", "_seq", F.explode(metadata_fields(F.col("_m"))).alias("_key", "_value"))
        last = fields.groupBy("id", "_key").agg(F.max_by("_value", "_seq").alias("_value"))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_key", "_value"))), lambda x: F.concat(x["_key"], F.lit(":"), x["_value"])), ","), F.lit("}"))
        given = materialize(vectors.join(last.groupBy("id").agg(text.alias("_m")), "id", "left"), "given")

        def write(base: dict) -> dict:
            met = self._rows(base).join(given, "id")
            new = met.withColumn("metadata", F.when(F.col("_m").isNull(), F.col("metadata")).otherwise(merge_metadata(F.col("metadata"), F.col("_m"))))
            new = measured(new.withColumn("vector", F.coalesce("_v", "vector"))).withColumn("timestamp", F.lit(now_ms).cast("bigint"))
            new = materialize(new.select(*COLUMNS, "_n"), "updated")
            done = new.agg(F.sum("_n")).first()[0] or 0
            lost = fit.join(new.select("id"), "id", "left_anti").select("id", F.lit("there is no such record").alias("error"))
            errors = rows.where(wrong).select("id", F.lit("the vector has another dimension").alias("error")).unionByName(lost)
            if done:
                self._replace(new, base)
            return {"succeeded": done, "failed": errors.count(), "errors": errors}

        return self.files.retry(write)

    def touch(self, ids: DataFrame, now_ms: int, log: str) -> None:
        """Notes an access of each id in a log (a Parquet folder)."""
        ids.select("id", F.lit(now_ms).cast("bigint").alias("at")).write.mode("append").parquet(log)

    def fold_accesses(self, log: str) -> None:
        """Applies a log of accesses to ``last_accessed`` and ``access_count``."""
        seen = self.spark.read.parquet(log).groupBy("id").agg(F.max("at").alias("_at"), F.count(F.lit(1)).alias("_n"))
        later, more = F.greatest("last_accessed", "_at"), F.col("access_count") + F.col("_n")
        self.files.retry(lambda base: self._replace(self._rows(base).join(seen, "id").withColumns({"last_accessed": later, "access_count": more}), base))


def batch_numbers(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch_no``: runs of ``size`` rows in the given order."""
    from vectrine.operators.eviction import running

    found = running(rows.withColumn("_one", F.lit(1)), [F.col(order)], "_one")
    return found.withColumn("batch_no", F.floor((F.col("place") - 1) / size).cast("int")).drop("_one", "before", "place")


def rows_in_budget(dimension: int, budget: int = 64 * 2**20) -> int:
    """Rows of a batch that a budget of bytes allows."""
    return max(1, budget // (dimension * 8))


def progress(done: int, total: int) -> int:
    """Percent, rounded; 100 of nothing."""
    return 100 if total <= 0 else int(100 * done / total + 0.5)


def ranked_pages(rows: DataFrame, size: int) -> DataFrame:
    """``(id, page)`` by id, for tables of which every page is wanted at once."""
    from vectrine.operators.eviction import running

    found = running(rows.select("id").withColumn("_one", F.lit(1)), [F.col("id")], "_one")
    return found.select("id", F.floor((F.col("place") - 1) / size).cast("int").alias("page"))



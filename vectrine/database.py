"""A database of namespaces, each a collection of its own dimension and metric."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine import errors
from vectrine.observe import Journal
from vectrine.operators import ann, eviction, monitor, search
from vectrine.operators.filters import compile_filter
from vectrine.operators.namespaces import NamespaceError, check_name
from vectrine.operators.validate import check_range, database_name, whole
from vectrine.session import drop, materialize
from vectrine.sources.table import VectorTable
from vectrine.sources.versioned import VersionedTable

DEFAULT = "default"


class Collection:
    """One namespace: storage, searches, an index and eviction.

    Operations are timed in ``journal``. With a ``quota`` of bytes a write is
    checked before it is made: from 95 % in use on the least recently used
    records are evicted, and a write that still has no room is refused.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str, journal: Journal | None = None, quota: int | None = None):
        self.spark, self.table, self.dimension, self.metric = spark, VectorTable(spark, path, dimension), dimension, metric
        self.journal, self.quota, self.indexing = journal or Journal(), quota, False
        self.indexes = f"{path.rstrip('/')}/_indexes"

    def _where(self, condition: dict | Column | None) -> Column | None:
        return compile_filter(condition) if isinstance(condition, dict) else condition

    # writes

    def _guard(self) -> None:
        if self.quota is None:
            return

        def evict(share: float) -> float:
            freed = eviction.lru(eviction.measured(self.table.all()), target=max(1, int(self.used() * share)))
            self.journal.note("quota", "evict", records=self.table.delete(freed.select("id")))
            return self.used()

        monitor.guard_write(self.used(), self.quota, evict)

    def used(self) -> float:
        """Estimated bytes of all records."""
        return float(eviction.measured(self.table.all()).agg(F.sum("size")).first()[0] or 0)

    def put(self, rows: DataFrame, now_ms: int, seq: str | None = None) -> int:
        """Adds or replaces records; see :meth:`VectorTable.put`."""
        with self.journal.timed("write", "put"):
            self._guard()
            return self.table.put(rows, now_ms, seq)

    def update(self, changes: DataFrame, now_ms: int, seq: str | None = None) -> dict:
        """Changes records; see :meth:`VectorTable.update_batch`."""
        with self.journal.timed("write", "update"):
            self._guard()
            return self.table.update_batch(changes, now_ms, seq)

    def delete(self, ids: DataFrame) -> int:
        """Removes records, from a fitting index too, and returns their number."""
        with self.journal.timed("write", "delete"):
            fits = self.index_health() == "healthy"
            n = self.table.delete(ids)
            if n and fits:
                found, about = ann.load(self.spark, self._index())
                left = materialize(ann.remove(found, ids), "index")
                ann.save(left, self._index(), self._parameters(about), about["rows"] - n, self._version())
            return n

    # index

    def _index(self, name: str = "graph") -> str:
        return f"{self.indexes}/{name}"

    def _version(self) -> int:
        return max(self.table.files.versions(), default=0)

    def _parameters(self, about: dict) -> ann.Parameters:
        return ann.Parameters(**{f: about[f] for f in ann.Parameters.__dataclass_fields__})

    def set_indexing(self, on: bool) -> None:
        """Whether searches may be approximate, through the index."""
        self.indexing = on

    def rebuild_index(self, parameters: ann.Parameters | None = None, queries: DataFrame | None = None, least: float = 0.0, k: int = 10) -> float | None:
        """Builds the index anew. With ``queries`` (qid, qvec) it is only saved if its mean recall is ``least`` or more, which is returned."""
        p = parameters or ann.Parameters(metric=self.metric)
        with self.journal.timed("index", "rebuild"):
            at, rows = self._version(), self.table.all()
            made, reached = materialize(ann.build(rows, p), "index"), None
            if queries is not None:
                found = ann.search(made, queries, k, p, id_type="string")
                reached = search.recall(found, search.batch_search(rows, queries, k, self.metric), k).agg(F.avg("recall")).first()[0]
                if reached is not None and reached < least:
                    raise errors.IndexFailed(f"the recall is {reached:.3f}, below {least}")
            ann.save(made, self._index(), p, rows.count(), at)
            return reached

    def index_health(self) -> str:
        """missing, incompatible, stale or healthy."""
        found = ann.load(self.spark, self._index())
        return ann.health(None if found is None else found[1], found[1]["rows"] if found else 0, self.metric, at=self._version())

    def list_indexes(self) -> list[str]:
        return ann.saved(self.spark, self.indexes)

    def delete_index(self) -> None:
        ann.discard(self.spark, self._index())

    # searches

    def search(self, query: list[float], k: int = 10, where: dict | Column | None = None, include: tuple[str, ...] = ()) -> DataFrame:
        """The ``k`` nearest records, optionally of those that meet a filter.

        With indexing on and a fitting index the search is approximate; filtered
        ones, and all others, are exact.
        """
        query, k = search.check_query(query, self.dimension), whole(k, 1, 10_000, "k")
        with self.journal.timed("search", "knn", k=k):
            if self.indexing and where is None and self.index_health() == "healthy":
                asked = self.spark.createDataFrame([(0, query)], "qid int, qvec array<double>")
                found, about = ann.load(self.spark, self._index())
                near = ann.search(found, asked, k, self._parameters(about), id_type="string").select("id", "distance", "score")
                if include:
                    near = near.join(self.table.all().select("id", *include), "id")
                return near.orderBy(*search.order())
            return search.knn(self.table.all(), query, k, self.metric, self._where(where), include=include)

    def search_range(self, query: list[float], distance: float, limit: int | None = None, where: dict | Column | None = None) -> DataFrame:
        """All records within a distance."""
        with self.journal.timed("search", "range"):
            return search.search_range(self.table.all(), search.check_query(query, self.dimension), check_range(distance, self.metric, self.dimension), self.metric, limit, self._where(where))

    def search_stream(self, query: list[float], batch: int = 10, most: int = 50_000):
        """Batches of results, pulled one after the other."""
        return search.stream_batches(search.search_stream(self.table.all(), search.check_query(query, self.dimension), self.metric, batch, most))

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The ``k`` nearest records of each query (qid, qvec)."""
        with self.journal.timed("search", "batch", k=k):
            return search.batch_search(self.table.all(), queries, k, self.metric)

    def evict(self, strategy: str, now_ms: int, **options) -> int:
        """Evicts by 'lru', 'lfu', 'ttl', 'score' or 'hybrid'; returns the number of records removed."""
        rows = eviction.measured(self.table.all())
        chosen = {"lru": eviction.lru, "lfu": eviction.lfu}.get(strategy)
        if chosen:
            return self.table.delete(chosen(rows, **options).select("id"))
        timed = {"ttl": eviction.ttl, "score": eviction.by_score, "hybrid": eviction.hybrid}[strategy]
        return self.table.delete(timed(rows, now_ms, **options).select("id"))

    def statistics(self, now_ms: int) -> dict:
        return eviction.statistics(eviction.measured(self.table.all()), now_ms).first().asDict()


class Database:
    """Namespaces below ``path``; their registry is a versioned table."""

    SCHEMA = "namespace string, dimension int, metric string, description string, created bigint"

    def __init__(self, spark: SparkSession, path: str, name: str = "vectors", quota: int | None = None):
        self.journal, self.quota = Journal(), quota
        self.spark, self.path = spark, f"{path.rstrip('/')}/{database_name(name)}"
        self._registry = VersionedTable(spark, f"{self.path}/registry")

    def registry(self) -> DataFrame:
        return self._registry.read() if self._registry.versions() else self.spark.createDataFrame([], self.SCHEMA)

    def names(self) -> list[str]:
        return sorted(r.namespace for r in self.registry().select("namespace").collect())

    def create(self, name: str, dimension: int, metric: str = "cosine", description: str | None = None, now_ms: int = 0) -> Collection:
        """A new namespace; an error if there is one of this name."""
        check_name(name)
        made = Collection(self.spark, f"{self.path}/ns/{name}", whole(dimension, 1, 100_000, "dimension"), metric, self.journal, self.quota)

        def write(base: dict) -> None:
            if name in self.names():
                raise NamespaceError(f"the namespace {name} exists")
            self._registry.commit(add=self.spark.createDataFrame([(name, dimension, metric, description, now_ms)], self.SCHEMA), base=base)

        self._registry.retry(write)
        return made

    def get(self, name: str = DEFAULT) -> Collection:
        row = self.registry().where(F.col("namespace") == name).first()
        if row is None:
            raise NamespaceError(f"there is no namespace {name}")
        return Collection(self.spark, f"{self.path}/ns/{name}", row.dimension, row.metric, self.journal, self.quota)

    def default(self, dimension: int) -> Collection:
        """The default namespace, made if it is missing."""
        return self.get() if DEFAULT in self.names() else self.create(DEFAULT, dimension)

    def delete(self, name: str) -> None:
        """Removes a namespace and its records; the default one stays."""
        if name == DEFAULT:
            raise NamespaceError("the default namespace can't be deleted")
        if name not in self.names():
            raise NamespaceError(f"there is no namespace {name}")
        from vectrine.sources.versioned import FILE, POSITION

        self._registry.retry(lambda base: self._registry.commit(delete=self._registry.read(base["version"], positions=True).where(F.col("namespace") == name).select(FILE, POSITION), base=base))
        drop(self.spark, f"{self.path}/ns/{name}")

    def describe(self) -> str:
        """The registry as JSON."""
        return json.dumps([r.asDict() for r in self.registry().orderBy("namespace").collect()])

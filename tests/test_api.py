"""The database facade, validation, compression, streams, the journal and errors."""

import json
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrine import errors
from vectrine.database import Database
from vectrine.observe import Journal
from vectrine.operators import aggregates, ann, monitor, validate
from vectrine.operators.compress import compress, restored, scalar
from vectrine.operators.namespaces import NamespaceError
from vectrine.session import shared_path
from vectrine.sources.table import VectorTable
from vectrine.streaming.ingest import neighbours_stream, upsert_stream


def test_database(spark):
    db = Database(spark, shared_path(spark, "db"))
    c = db.create("first-one", 2)
    with pytest.raises(NamespaceError):
        db.create("first-one", 2)
    c.table.put(spark.createDataFrame([("a", [1.0, 0.0], '{"k": 1}'), ("b", [0.0, 1.0], '{"k": 2}'), ("c", [1.0, 1.0], None)], "id string, vector array<float>, metadata string"), 1000)
    assert [r.id for r in c.search([1.0, 0.1], 2).collect()] == ["a", "c"]
    assert [r.id for r in c.search([1.0, 0.1], 2, where={"k": {"$gt": 1}}).collect()] == ["b"]
    assert [r.id for r in c.search_range([1.0, 0.0], 0.5).collect()] == ["a", "c"]
    assert [len(x) for x in c.search_stream([1.0, 0.0], 2)] == [2, 1]
    with pytest.raises(ValueError):
        c.search([1.0], 2)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "qid int, qvec array<float>")
    assert [r.id for r in c.search_batch(asked, 1).collect()] == ["b"]
    assert c.evict("lru", 2000, most=1) == 1 and c.statistics(2000)["records"] == 2
    assert db.get("first-one").table.count() == 2
    db.default(3)
    assert db.names() == ["default", "first-one"] and len(json.loads(db.describe())) == 2
    for bad in ("default", "missing"):
        with pytest.raises(NamespaceError):
            db.delete(bad)
    db.delete("first-one")
    assert db.names() == ["default"]
    with pytest.raises(NamespaceError):
        db.get("first-one")


def test_searches_through_the_index(spark):
    rng = np.random.default_rng(2)
    c = Database(spark, shared_path(spark, "db")).create("name", 8, "euclidean")
    rows = spark.createDataFrame([(f"v{i}", v.tolist(), '{"k": 1}') for i, v in enumerate(rng.standard_normal((120, 8)))], "id string, vector array<double>, metadata string")
    c.put(rows, 5)
    query = [0.1] * 8
    exact = [r.id for r in c.search(query, 5).collect()]
    assert c.index_health() == "missing" and c.list_indexes() == []
    asked = spark.createDataFrame([(1, query)], "qid int, qvec array<double>")
    with pytest.raises(errors.IndexFailed):
        c.rebuild_index(queries=asked, least=1.1)
    assert c.rebuild_index(ann.Parameters("euclidean", shard_rows=40), asked, 0.9) >= 0.9
    c.set_indexing(True)
    assert c.index_health() == "healthy" and c.list_indexes() == ["graph"]
    found = c.search(query, 5, include=("metadata",))
    assert [r.id for r in found.collect()] == exact and "metadata" in found.columns
    assert c.delete(spark.createDataFrame([(exact[0],), ("none",)], "id string")) == 1
    assert c.index_health() == "healthy" and exact[0] not in [r.id for r in c.search(query, 5).collect()]
    assert ann.load(spark, c._index())[0].agg(F.sum("nodes")).first()[0] == 119
    c.put(rows.limit(1), 6)
    assert c.index_health() == "stale" and len(c.search(query, 5).collect()) == 5
    c.delete_index()
    assert c.index_health() == "missing"
    assert {e["kind"] for e in c.journal.entries} == {"write", "search", "index"} and c.journal.select("search", "knn")[0]["ok"]


def test_quota_is_checked_before_a_write(spark):
    c = Database(spark, shared_path(spark, "db"), quota=10**6).create("name", 4)
    rows = lambda names: spark.createDataFrame([(n, [1.0] * 4) for n in names], "id string, vector array<float>")
    c.put(rows("abcdefghij"), 5)
    c.quota = int(c.used() * 1.02)
    c.put(rows("k"), 6)  # at 98 %: a fifth is evicted first
    assert c.table.count() == 9 and c.journal.select("quota")[0]["about"] == '{"records": 2}'
    c.quota = 1
    with pytest.raises(monitor.QuotaError):
        c.put(rows("l"), 7)


def test_cache_of_indexes_saves_what_changed(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id bigint, vector array<double>")
    p, paths = ann.Parameters(), [shared_path(spark, "i") for _ in range(2)]
    cache = ann.IndexCache(spark, 1)
    about = {"rows": 10, "at": None, **asdict(p)}
    for path in paths:
        cache.put(path, ann.build(df, p), about)
    assert ann.load(spark, paths[0])[1]["rows"] == 10 and ann.load(spark, paths[1]) is None  # the first had to leave
    assert cache.flush() == 1 and cache.flush() == 0 and ann.load(spark, paths[1])[1]["rows"] == 10


def test_limits():
    for bad in ("", "1a", "a b", "x" * 65, None):
        with pytest.raises(errors.InvalidInput):
            validate.database_name(bad)
    for f, args in ((validate.whole, (0, 1, 5, "k")), (validate.whole, (True, 1, 5, "k")), (validate.options, ({"q": 1}, {"k"})), (validate.check_range, (5.0, "cosine", 3)), (validate.check_range, (-1, "euclidean", 3)), (validate.ids_of_batch, (["a", "a"],)), (validate.ids_of_batch, ([],))):
        with pytest.raises(errors.InvalidInput):
            f(*args)
    assert validate.check_range(-5, "dot", 3) == -5.0 and validate.greatest_distance("euclidean", 4) == 200 and validate.greatest_distance("own", 4) == 1000
    assert validate.sanitized(" a\x00b\n ") == "ab"


def test_report(spark):
    deep = json.dumps({"a": json.loads("[" * 12 + "]" * 12)})
    rows = [("a", [1.0, 2.0], '{"x": 1}'), ("b/c", [1.0], "{"), (None, None, "[1]"), ("d", [1.0, float("nan")], '{"__p": 1}'), ("e", [1.0, 2.0], deep), ("f", [], json.dumps({"s": "x" * 10_001})), ("g", [1.0, 2.0], None)]
    found = sorted(tuple(str(x) for x in r) for r in validate.report(spark.createDataFrame(rows, "id string, vector array<float>, metadata string"), 2).collect())
    assert found == sorted([("b/c", "id", "characters"), ("b/c", "vector", "dimension"), ("b/c", "metadata", "no JSON"), ("None", "id", "missing"), ("None", "vector", "missing"), ("None", "metadata", "no object"), ("d", "vector", "not finite"), ("d", "metadata", "key"), ("e", "metadata", "too deep"), ("f", "vector", "empty"), ("f", "metadata", "long string")])


def test_compression(spark):
    df = spark.range(5).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * (F.col("id") + 1)).cast("float")).alias("vector"))
    back = {r.id: r.vector for r in restored(scalar(df)).collect()}
    for r in df.collect():
        assert max(abs(a - b) for a, b in zip(r.vector, back[r.id])) <= 2 / 255 / 2 + 1e-6
    assert scalar(df, loss=0.05).count() == 5
    with pytest.raises(Exception, match="loses too much"):
        scalar(df, bits=4, loss=1e-9).collect()
    with pytest.raises(errors.InvalidInput):
        compress(df.select("id", F.slice("vector", 1, 8).alias("vector")))
    with pytest.raises(errors.InvalidInput):
        compress(df, "zip")


def test_streams(spark):
    source, check = shared_path(spark, "in"), shared_path(spark, "check")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<float>")
    rows.write.parquet(source)
    store = VectorTable(spark, shared_path(spark, "v"), 2)
    stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
    upsert_stream(stream(), store, check, 5).awaitTermination()
    upsert_stream(stream(), store, check, 6).awaitTermination()
    assert store.count() == 2 and store.files.latest()["version"] == 1
    found = []
    asked = stream().select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    neighbours_stream(asked, store.all(), 1, lambda d, n: found.extend((r.qid, r.id) for r in d.collect()), shared_path(spark, "c2")).awaitTermination()
    assert sorted(found) == [("a", "a"), ("b", "b")]


def test_journal(spark):
    j, heard = Journal(), []
    j.listeners += [heard.append, lambda e: 1 / 0]
    with j.timed("search", "knn", k=3, api_key="x"):
        pass
    with pytest.raises(KeyError), j.timed("search", "knn"):
        raise KeyError
    assert [e["ok"] for e in j.select("search")] == [True, False] and len(heard) == 2 and '"***"' in heard[0]["about"]
    assert aggregates.profile(j.table(spark), "ms", ("name",)).first().n == 2
    assert len(json.loads(j.export())) == 2 and j.export("csv").count("\n") == 3
    assert len(json.loads(j.export("trace"))["traceEvents"]) == 2 and j.export("html").count("<tr>") == 3


def test_errors():
    told = errors.DimensionMismatch("no", size=3, auth={"password": "p"}).told()
    assert told["code"] == "DIMENSION_MISMATCH" and told["context"] == {"size": 3, "auth": {"password": "***"}} and told["hint"]

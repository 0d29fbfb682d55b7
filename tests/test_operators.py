"""Metrics, vectors, searches, quantization, eviction, storage, index and codecs."""

import json
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrine.functions import metrics as M
from vectrine.functions import vectors as V
from vectrine.operators import ann
from vectrine.operators import eviction as E
from vectrine.operators import monitor, namespaces, pq
from vectrine.operators import quantize as Z
from vectrine.operators import search as S
from vectrine.session import shared_path
from vectrine.sources import codecs as C
from vectrine.sources.table import NotFound, VectorTable, progress, rows_in_budget

few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
floats = st.floats(-100, 100, width=32)
pair = st.integers(1, 9).flatmap(lambda n: st.tuples(st.lists(floats, min_size=n, max_size=n), st.lists(floats, min_size=n, max_size=n)))


def one(spark, a, b, *columns):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(*columns).first()


def naive(name, a, b):
    a, b = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
    match name:
        case "cosine":
            n = np.linalg.norm(a) * np.linalg.norm(b)
            return 1 - a @ b / n if n else 1.0
        case "euclidean":
            return np.linalg.norm(a - b)
        case "manhattan":
            return np.abs(a - b).sum()
        case "hamming":
            return ((a > 0) != (b > 0)).sum()
        case "jaccard":
            u = ((a > 0) | (b > 0)).sum()
            return 1 - ((a > 0) & (b > 0)).sum() / u if u else 0.0
        case "dot":
            return -(a @ b)
        case "hamming_exact_frac":
            return (a != b).mean()
        case "weighted_jaccard":
            m = np.maximum(a, b).sum()
            return 1 - np.minimum(a, b).sum() / m if m else 0.0


@few
@given(pair)
def test_metrics_agree_with_numpy(spark, p):
    found = one(spark, *p, *[M.distance(F.col("a"), F.col("b"), m).alias(m) for m in M.metrics()])
    for m in M.metrics():
        assert found[m] == pytest.approx(naive(m, *p), rel=1e-6, abs=1e-6)


@few
@given(pair)
def test_metric_axioms(spark, p):
    for m in ("euclidean", "manhattan", "hamming"):
        r = one(spark, *p, M.metric(m)(F.col("a"), F.col("b")), M.metric(m)(F.col("b"), F.col("a")), M.metric(m)(F.col("a"), F.col("a")))
        assert r[0] == pytest.approx(r[1]) and r[0] >= 0 and r[2] == 0


def test_lengths_and_nulls(spark):
    assert one(spark, [1.0], [1.0, 2.0], M.distance(F.col("a"), F.col("b")))[0] is None
    assert one(spark, None, [1.0], M.distance(F.col("a"), F.col("b"), "euclidean"))[0] is None
    with pytest.raises(Exception, match="different length"):
        one(spark, [1.0], [1.0, 2.0], M.distance(F.col("a"), F.col("b"), strict=True))


def test_registry(spark):
    with pytest.raises(M.UnknownMetric):
        M.metric("none")
    M.register_python("chebyshev", lambda a, b: float(np.abs(a - b).max()))
    try:
        assert one(spark, [1.0, 5.0], [2.0, 2.0], M.distance(F.col("a"), F.col("b"), "chebyshev"))[0] == 3
        with pytest.raises(ValueError):
            M.register("chebyshev", M.cosine)
    finally:
        M.unregister("chebyshev")


def test_vector_functions(spark):
    a, b = F.col("a"), F.col("b")
    r = one(spark, [3.0, 4.0], [0.0, 0.0], V.normalize(a), V.normalize(b), V.is_normalized(V.normalize(a)), V.equals(a, a), V.equals(a, b), V.mean(a), V.std(a))
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0, 0] and r[2] and r[3] and not r[4] and r[5] == 3.5 and r[6] == 0.5
    with pytest.raises(Exception, match="zero vector"):
        one(spark, [0.0], [0.0], V.normalize_strict(a))
    assert one(spark, [-0.5, 1.0], [0.0, 0.0], V.from_float32(a, "int8"))[0] == [-63, 127]
    assert one(spark, [], [0.0], V.problem(a), V.problem(b))[:] == ("empty", None)
    same = one(spark, [0.0], [0.0], V.random_vector(F.lit(1), 5), V.random_vector(F.lit(1), 5), V.random_vector(F.lit(2), 5))
    assert same[0] == same[1] != same[2] and all(-1 <= x < 1 for x in same[0])


# search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 12)).astype(np.float32)
    x[7] = 0
    x[11] = x[10]
    return x, spark.createDataFrame([(i, v.tolist(), f'{{"g": {i % 4}}}') for i, v in enumerate(x)] + [(900, None, None), (901, [1.0], None)], "id bigint, vector array<float>, metadata string").cache()


@pytest.mark.parametrize("name", ["cosine", "euclidean", "dot", "manhattan", "hamming"])
def test_batch_search_is_exact(spark, points, name):
    x, df = points
    asked = df.where("id in (0, 10, 50)").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    got = {}
    for r in S.batch_search(df, asked, 5, name).collect():
        got.setdefault(r.qid, []).append((r.place, r.id))
    for q in (0, 10, 50):
        d = [(round(float(naive(name, x[i], x[q])), 9), i) for i in range(300)]
        assert [i for _, i in sorted(got[q])] == [i for _, i in sorted(d)[:5]]


@pytest.mark.parametrize("name", sorted(S._KERNELS))
def test_distances_of_blocks(spark, points, name):
    """Blocks of queries of several lengths, repeated ones and null ones, against rows with nulls: as pair by pair."""
    x, df = points
    odd = spark.createDataFrame([(950, [1.0, None]), (951, [2.0]), (952, [float("inf")] + [0.0] * 11), (953, [])], "id bigint, vector array<float>")
    rows = df.select("id", "vector").unionByName(odd)
    asked = rows.where("id in (0, 7, 10, 11, 50, 900, 901, 950, 953)").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    asked = asked.unionByName(asked.where("qid < 11"))
    pairs = rows.join(asked.distinct()).withColumn("d", M.distance(F.col("vector"), F.col("qvec"), name)).where("d is not null")
    plain = {(r.qid, r.id): r.d for r in pairs.select("qid", "id", "d").collect()}
    for most in (3, 100):
        found = S.all_distances(rows, asked, name, most).collect()
        assert len(found) == len(plain) and {(r.qid, r.id) for r in found} == set(plain)
        for r in found:
            assert r.distance == pytest.approx(plain[r.qid, r.id], abs=1e-9, nan_ok=True)
    few, many = (sorted(tuple(r)[:2] + (r.place,) for r in S.batch_search(rows.where("id <> 952"), asked, 4, name, most=m).collect()) for m in (3, 100))
    assert few == many and len(few) == 5 * 4 + 2 * 1 + 1


def test_knn_plan_is_a_distributed_top_k(points):
    plan = S.knn(points[1], [1.0] * 12, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_multi_query_plan_limits_each_window(spark, points):
    asked = points[1].where("id < 3").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    plan = S.batch_search(points[1], asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_arguments_of_a_search(points):
    for bad in (0, -1, 10_001, 1.5, True):
        with pytest.raises(ValueError):
            S.knn(points[1], [1.0] * 12, bad)
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            S.check_query(bad)
    with pytest.raises(ValueError):
        S.check_query([1.0], 2)


def test_stream_and_progressive(points):
    _, df = points
    found = S.search_stream(df, [1.0] * 12, batch=7, most=20)
    assert [len(b) for b in S.stream_batches(found)] == [7, 7, 6]
    first = S.progressive(df, [1.0] * 12, batch=10, most=25).collect()
    assert [r.stage for r in first].count(0) == 10 and len({r.id for r in first}) == len(first) <= 25


def test_empty_collection(points):
    _, df = points
    assert S.knn(df.limit(0), [1.0] * 12, 5).isEmpty()
    assert S.progressive(df.limit(0), [1.0] * 12).isEmpty()
    asked = df.limit(0).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    assert S.batch_search(df, asked, 3).isEmpty()


def test_timeout(spark):
    assert S.with_timeout(spark.range(3), 60) == spark.range(3).collect()
    slow = spark.range(0, 10**12, 1, 4).selectExpr("sum(sqrt(id) * sin(id))")
    with pytest.raises(TimeoutError):
        S.with_timeout(slow, 1.0)


# index


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "manhattan"])
def test_graph_recall(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    asked = df.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    p = ann.Parameters(metric=metric, shard_rows=200, breadth=60)
    found = ann.search(ann.build(df, p), asked, 10, p)
    exact = S.batch_search(df, asked, 10, metric)
    assert S.recall(found, exact, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_index_health_and_fallback(spark, points):
    _, df = points
    df, path = df.where("size(vector) = 12"), shared_path(spark, "index")
    asked = df.where("id < 2").select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    assert ann.load(spark, path) is None and ann.health(None, 1, "cosine") == "missing"
    exact = sorted(S.batch_search(df, asked, 3).select("qid", "id").collect())
    assert sorted(ann.indexed_search(df, path, asked, 3).select("qid", "id").collect()) == exact
    p = ann.Parameters(shard_rows=400)
    ann.save(ann.build(df, p), path, p, 300)
    about = ann.load(spark, path)[1]
    assert [ann.health(about, 300, "cosine"), ann.health(about, 301, "cosine"), ann.health(about, 300, "dot"), ann.health(about, 300, "cosine", True)] == ["healthy", "stale", "incompatible", "dirty"]
    assert sorted(ann.indexed_search(df, path, asked, 3).select("qid", "id").collect()) == exact


# quantization


@few
@given(st.lists(floats, min_size=2, max_size=20), st.integers(4, 12))
def test_quantization_error_is_half_a_step(spark, v, bits):
    a = F.col("a")
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    codes = Z.quantize(a, low, high, bits)
    r = one(spark, v, v, a, Z.dequantize(codes, low, high, bits), codes)
    step = (max(r[0]) - min(r[0])) / (2**bits - 1)
    assert all(abs(x - y) <= step / 2 + 1e-6 for x, y in zip(r[0], r[1])) and all(0 <= c < 2**bits for c in r[2])


@given(st.integers(1, 16).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=40))))
def test_bit_packing_round_trip(case):
    bits, codes = case
    assert C.unpack(C.pack(codes, bits), bits, len(codes)) == codes


def test_product_quantization(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<float>")
    book = pq.train(df, 4, 16)
    back = {r.id: np.array(r.vector) for r in pq.decode(pq.encode(df, book), book).collect()}
    loss = np.mean([((back[i] - x[i]) ** 2).sum() for i in range(200)])
    assert loss == pytest.approx(book.distortion, rel=1e-4) and loss < 0.5 * (x**2).sum(1).mean()
    near = {r.id: r.distance for r in pq.asymmetric(pq.encode(df, book), book, x[0].tolist()).collect()}
    assert near[3] == pytest.approx(np.linalg.norm(back[3] - x[0]), rel=1e-5)
    with pytest.raises(ValueError):
        pq.check_shape(10, 4)
    with pytest.raises(ValueError):
        pq.train(df, 4, 256)


# eviction


def test_record_size(spark):
    cases = [None, "{", '{"a": null, "b": true, "c": 1.5, "d": "xyz", "e": [1, "q"], "f": {"g": 2}}']
    df = spark.createDataFrame([(t,) for t in cases], "m string")
    nested = 48 + 2 * 6 + 8 + 4 + 8 + 6 + (24 + 8 + 2) + (48 + 2 + 8)
    assert [r[0] for r in df.select(E.metadata_size("m")).collect()] == [0, 48, nested]


def use(spark):
    rows = [("a", 100, 5, 10, False), ("b", 100, 1, 20, False), ("c", 100, 9, 10, False), ("d", 100, 0, 5, True)]
    return spark.createDataFrame([(i, 1, n, None, s, t, p) for i, s, n, t, p in rows], "id string, timestamp bigint, access_count bigint, metadata string, size bigint, accessed bigint, permanent boolean")


def test_selections(spark):
    df = use(spark)
    ids = lambda x: [r.id for r in x.orderBy("place").collect()]
    assert ids(E.lru(df)) == ["a", "c", "b"] and ids(E.lru(df, target=101)) == ["a", "c"] and ids(E.lru(df, most=1)) == ["a"]
    assert ids(E.lfu(df)) == ["b", "a", "c"] and ids(E.lfu(df, keep_permanent=False, most=1)) == ["d"]
    assert [r.id for r in E.ttl(df, 10 + E.HOUR, 1 - 5 / E.HOUR).orderBy("id").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        E.hybrid(df, 100)
    assert E.apply(df, E.lru(df)).count() == 1
    assert E.lru(df.limit(0)).isEmpty()
    assert list(E.batches(E.lru(df), 2))[0] and sum(map(len, E.batches(E.lru(df), 2))) == 3


# storage


def test_percentiles_leave_out_elements_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([([float(i), 1e308 * (-1) ** i, inf, -inf, nan],) for i in range(12_000)], "vector array<double>")
    low, high = Z.percentile_bounds(df, share=(0.3, 0.7)).first()
    assert (low, high) == (sorted([float(i) for i in range(12_000)] + [1e308, -1e308] * 6000)[7200], sorted([float(i) for i in range(12_000)] + [1e308, -1e308] * 6000)[16_800])


def test_vector_table(spark):
    t = VectorTable(spark, shared_path(spark, "v"), 2)
    assert t.count() == 0 and t.get("a") is None and t.delete(spark.createDataFrame([("a",)], "id string")) == 0
    t.put(spark.createDataFrame([("a", [3.0, 4.0], '{"x": 1}', 1), ("a", [1.0, 0.0], '{"x": 2}', 2), ("b", [0.0, 1.0], None, 1)], "id string, vector array<float>, metadata string, seq int"), 5, seq="seq")
    assert t.count() == 2 and t.get("a")["metadata"] == '{"x": 2}' and t.get("a")["normalized"]
    for bad in ([("c", [1.0])], [(None, [1.0, 2.0])], [("", [1.0, 2.0])], [("c", None)]):
        with pytest.raises(ValueError):
            t.put(spark.createDataFrame(bad, "id string, vector array<float>"), 5)
    t.update_metadata("a", {"y": [1]})
    assert json.loads(t.get("a")["metadata"]) == {"x": 2, "y": [1]}
    t.update_vector("b", [6.0, 8.0], 9)
    assert t.get("b")["magnitude"] == 10 and t.get("b")["timestamp"] == 9
    with pytest.raises(NotFound):
        t.update_vector("z", [1.0, 1.0], 1)
    told = t.update_batch(spark.createDataFrame([("a", '{"x": 5}'), ("z", "{}")], "id string, metadata string"), 11)
    assert (told["succeeded"], told["failed"]) == (1, 1) and told["errors"].collect() == [("z", "there is no such record")]
    assert [r.id for page in t.pages(1) for r in page] == ["a", "b"] and [r.id for r in t.page("a", 5).collect()] == ["b"]
    assert t.delete(spark.createDataFrame([("a",), ("a",), ("q",)], "id string")) == 1
    t.compact()
    assert t.count() == 1 and not t.exists("a") and t.exists("b")
    t.clear()
    assert t.count() == 0
    assert [progress(1, 3), progress(0, 0), rows_in_budget(10**9)] == [33, 100, 1]


def test_batch_updates_tell_every_failure(spark):
    t = VectorTable(spark, shared_path(spark, "v"), 2)
    t.put(spark.createDataFrame([(k, [3.0, 4.0], '{"x": 1, "y": "1"}') for k in "abc"], "id string, vector array<float>, metadata string"), 5)
    rows = [("a", [1.0], '{"x": 9}', 1), ("b", [0.0, 2.0], '{"x": 2}', 1), ("b", None, '{"x": 3, "z": [null]}', 3), ("b", [0.0, 1.0], '{"x": "4"}', 2), ("c", None, "[1]", 1), ("q", None, None, 1), (None, None, None, 1)]
    told = t.update_batch(spark.createDataFrame(rows, "id string, vector array<float>, metadata string, seq int"), 9, seq="seq")
    assert (told["succeeded"], told["failed"]) == (4, 3)
    assert sorted((r.id or "", r.error) for r in told["errors"].collect()) == [("", "there is no such record"), ("a", "the vector has another dimension"), ("q", "there is no such record")]
    b = t.get("b")
    assert b["vector"] == [0.0, 1.0] and b["normalized"] and json.loads(b["metadata"]) == {"x": 3, "y": "1", "z": [None]}
    assert t.get("a")["timestamp"] == 5 and json.loads(t.get("c")["metadata"]) == {"x": 1, "y": "1"} and t.count() == 3


def test_upserts_at_the_same_time_leave_an_id_once(spark):
    path = shared_path(spark, "v")
    one, other = VectorTable(spark, path, 1), VectorTable(spark, path, 1)
    rows = lambda x: spark.createDataFrame([("a", [x])], "id string, vector array<float>")
    one.put(rows(1.0), 1)
    plain, late = one._positions, []

    def positions(ids, base):  # the other table is written after the first has read where its ids are
        found = plain(ids, base)
        if not late:
            late.append(other.put(rows(2.0), 2))
        return found

    one._positions = positions
    assert one.put(rows(3.0), 3) == 3 and late == [2]
    assert [r.vector for r in one.all().collect()] == [[3.0]]


# codecs


def test_relational_tables_and_memory(spark):
    rows = [(f"k{i}", [float(i), 0.5], json.dumps({"n": i, "t": "x'y"})) for i in range(20)] + [("none", [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, metadata string")
    url, driver = f"jdbc:derby:memory:v{np.random.default_rng().integers(10**9)};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    C.write_jdbc(df, url, "records", 3, driver)
    back = C.read_jdbc(spark, url, "records", 3, driver)
    found = sorted((r.id, r.vector, None if r.metadata is None else json.dumps(json.loads(r.metadata))) for r in back.collect())
    assert found == sorted((i, v, m) for i, v, m in rows) and back.rdd.getNumPartitions() == 3
    C.keep_in_memory(df, "kept")
    assert C.open_source(spark, "memory:kept").count() == 21
    with pytest.raises(ValueError):
        C.open_source(spark, "kept")


@given(st.lists(floats, max_size=8), st.text(min_size=1, max_size=5), st.integers(0, 2**40))
def test_binary_round_trip(vector, key, now):
    r = {"id": key, "vector": vector, "metadata": json.dumps({"k": key}), "magnitude": 1.5, "format": "float32", "normalized": False, "timestamp": now, "last_accessed": None, "access_count": 3}
    assert C.decode(C.encode(r)) == {**r, "vector": np.asarray(vector, np.float32).tolist()}


def test_corruption_is_noticed(spark):
    good = C.encode({"id": "a", "vector": [1.0, 2.0], "magnitude": 1.0, "timestamp": 1})
    flipped = good[:25] + bytes([good[25] ^ 1]) + good[26:]
    for bad in (b"", good[:-1], flipped, b"XXXX" + good[4:], good + b"x"):
        with pytest.raises(C.Corrupt):
            C.decode(bad)
    df = spark.createDataFrame([(good,), (bytearray(flipped),), (None,)], "data binary")
    assert [r.id for r in C.from_binary(df, skip_corrupt=True).collect()] == ["a"]
    with pytest.raises(Exception, match="checksum"):
        C.from_binary(df).collect()


def test_addresses(spark):
    for bad in ("json:", "what:/x", "nothing"):
        with pytest.raises(ValueError):
            C.open_source(spark, bad)


# the rest


def test_namespaces(spark):
    for bad in ("ab", "x" * 65, "root", "a b c", "a-ns-b", None):
        with pytest.raises(namespaces.NamespaceError):
            namespaces.check_name(bad)
    reg = spark.createDataFrame([("one", (3, "cosine", None), (1, 2, 3, 4), 5, 6)], "namespace string, config struct<dimension int, distance_metric string, description string>, stats struct<vector_count bigint, storage_size bigint, last_accessed bigint, index_size bigint>, created bigint, modified bigint")
    with pytest.raises(namespaces.NamespaceError):
        namespaces.create(reg, "one", 3)
    with pytest.raises(namespaces.NamespaceError):
        namespaces.delete(reg, "two")
    assert namespaces.create(reg, "two", 4).count() == 2


def test_monitoring():
    assert monitor.guard_write(50, 100, None) == 50 and monitor.guard_write(96, 100, lambda s: 96 * (1 - s)) == pytest.approx(86.4)
    with pytest.raises(monitor.QuotaError):
        monitor.guard_write(99, 100, lambda s: 97)
    assert monitor.health({"a": 0.5, "b": True})["status"] == "healthy" and monitor.health({"a": 0.85})["status"] == "degraded"
    assert monitor.health({"a": 0.1, "b": False})["status"] == "critical" and math.isclose(1, 1)

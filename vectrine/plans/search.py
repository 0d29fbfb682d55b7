"""Queries of searches, metadata filters and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.functions.metrics import distance
from vectrine.operators import aggregates as A
from vectrine.operators import ann, monitor
from vectrine.operators import search as S
from vectrine.operators.filters import FilterBuilder, compile_filter
from vectrine.plans.common import BASE, METRIC, embeddings, query_vector, r6, r6_sql, total
from vectrine.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {BASE} {sql}" if base else sql
        return f

    return put


COS = METRIC["cosine"]
RANKED = f"(SELECT e.vec_id AS id, e.label, {COS} AS d FROM e, q)"
OUT = f"SELECT id, {r6_sql('d')} AS distance, {r6_sql('1 - d / 2')} AS score"
E_ = {"key": "vec_id", "vector": "embedding"}


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", r6(F.col("distance")).alias("distance"), r6(F.col("score")).alias("score"), *more)


@query("q1_knn_cosine", f"{OUT} FROM {RANKED} ORDER BY round(d, 9), id LIMIT 10")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.knn(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, **E_))


@query("q2_knn_with_columns", f"{OUT}, label FROM {RANKED} ORDER BY round(d, 9), id LIMIT 10")
def q2(spark, sf_dir):
    return _out(S.knn(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, include=("label",), **E_), "label")


@query("q3_knn_filtered", f"{OUT} FROM {RANKED} WHERE label IN (1, 3, 5) ORDER BY round(d, 9), id LIMIT 10")
def q3(spark, sf_dir):
    df = embeddings(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    return _out(S.knn(df, query_vector(spark, sf_dir), 10, where=compile_filter({"label": {"$in": [1, 3, 5]}}), **E_))


@query("q4_range", f"{OUT} FROM {RANKED} WHERE round(d, 9) <= 0.9")
def q4(spark, sf_dir):
    return _out(S.search_range(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 0.9, **E_))


@query("q4_range_limited", f"{OUT} FROM {RANKED} WHERE round(d, 9) <= 0.9 ORDER BY round(d, 9), id LIMIT 25")
def q4_limited(spark, sf_dir):
    return _out(S.search_range(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 0.9, limit=25, **E_))


@query("q5_stream", f"SELECT id, {r6_sql('d')} AS distance, n::INT AS place, ((n - 1) // 10)::INT AS batch_no FROM (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS n FROM {RANKED})")
def q5(spark, sf_dir):
    found = S.search_stream(embeddings(spark, sf_dir), query_vector(spark, sf_dir), batch=10, **E_)
    return found.select("id", r6(F.col("distance")).alias("distance"), "place", "batch_no")


@query("q6_progressive", f"""SELECT stage, id, {r6_sql('d')} AS distance FROM (
WITH r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS o FROM {RANKED}), n AS (SELECT count(*) AS n FROM r),
a AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS p FROM r WHERE o <= 100 ORDER BY p LIMIT 20),
b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS p FROM (SELECT id, d FROM r WHERE o <= 1000 ORDER BY round(d, 9), id LIMIT 20) WHERE id NOT IN (SELECT id FROM a)) WHERE (SELECT n FROM n) > 1000),
b_given AS (SELECT least(count(*), 10) AS c FROM b),
c AS (SELECT *, row_number() OVER (ORDER BY round(d, 9), id) AS p FROM (SELECT id, d FROM r ORDER BY round(d, 9), id LIMIT 20) WHERE id NOT IN (SELECT id FROM a) AND id NOT IN (SELECT id FROM b))
SELECT 0 AS stage, id, d FROM a WHERE p <= 10 UNION ALL SELECT 1, id, d FROM b WHERE p <= 10
UNION ALL SELECT CASE WHEN (SELECT n FROM n) > 1000 THEN 2 ELSE 1 END, id, d FROM c WHERE p <= 10)""")
def q6(spark, sf_dir):
    found = S.progressive(embeddings(spark, sf_dir), query_vector(spark, sf_dir), batch=10, most=50, **E_)
    return found.select("stage", "id", r6(F.col("distance")).alias("distance"))


@query("q7_in_candidates", f"{OUT} FROM {RANKED} WHERE id % 3 = 0 ORDER BY round(d, 9), id LIMIT 10")
def q7(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return _out(S.search_in(e, e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id")), query_vector(spark, sf_dir), 10, **E_))


def _asked(spark, sf_dir, step: int = 100) -> DataFrame:
    """The stated query set: every id divisible by ``step``."""
    return embeddings(spark, sf_dir).where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


QPAIR = f"(SELECT b.vec_id AS qid, a.vec_id AS id, {COS} AS d FROM e a, (SELECT vec_id, v AS q FROM e WHERE vec_id % 100 = 0) b)"


@query("q8_batch_similarity", f"SELECT qid, id, {r6_sql('1 - d / 2')} AS score FROM {QPAIR}")
def q8(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.all_distances(rows, _asked(spark, sf_dir)).select("qid", "id", r6(F.col("score")).alias("score"))


TOP = f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS place FROM {QPAIR})"


@query("q9_multi_query", f"SELECT qid, id, {r6_sql('d')} AS distance, place::INT AS place FROM {TOP} WHERE place <= 10")
def q9(spark, sf_dir):
    found = S.batch_search(embeddings(spark, sf_dir), _asked(spark, sf_dir), 10, **E_)
    return found.select("qid", "id", r6(F.col("distance")).alias("distance"), "place")


@query("q9_every_row", f"SELECT qid, id, {r6_sql('d')} AS distance, place::INT AS place FROM {TOP.replace(' WHERE vec_id % 100 = 0', '')} WHERE place <= 10")
def q9_every(spark, sf_dir):
    """Every row as a query."""
    found = S.batch_search(embeddings(spark, sf_dir), _asked(spark, sf_dir, 1), 10, **E_)
    return found.select("qid", "id", r6(F.col("distance")).alias("distance"), "place")


@query("q9_multi_query_euclidean", f"SELECT qid, id, {r6_sql('d')} AS distance FROM {TOP.replace(COS, METRIC['euclidean'])} WHERE place <= 10")
def q9_euclidean(spark, sf_dir):
    return S.batch_search(embeddings(spark, sf_dir), _asked(spark, sf_dir), 10, "euclidean", **E_).select("qid", "id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("q10_shared_memory", f"SELECT n - 1 AS position, {r6_sql('d')} AS distance FROM (SELECT id, d, row_number() OVER (ORDER BY id) AS n FROM {RANKED}) ORDER BY round(d, 9), n LIMIT 10")
def q10(spark, sf_dir):
    """Results by position: ids of this table run from 0 without gaps, so the id is the position."""
    return S.knn(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 10, **E_).select(F.col("id").alias("position"), r6(F.col("distance")).alias("distance"))


@query("q11_shared_memory_batch", f"SELECT qid, id AS position, {r6_sql('d')} AS distance FROM {TOP.replace(COS, METRIC['dot'])} WHERE place <= 5")
def q11(spark, sf_dir):
    return S.batch_search(embeddings(spark, sf_dir), _asked(spark, sf_dir), 5, "dot", **E_).select("qid", F.col("id").alias("position"), r6(F.col("distance")).alias("distance"))


@query("q12_two_phase", f"SELECT id, {r6_sql('d')} AS distance FROM {RANKED.replace(COS, METRIC['manhattan'])} ORDER BY round(d, 9), id LIMIT 15")
def q12(spark, sf_dir):
    return S.knn(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 15, "manhattan", **E_).select("id", r6(F.col("distance")).alias("distance"))


@query("q15_recall", "SELECT vec_id AS qid, 1.0::DOUBLE AS recall FROM e WHERE vec_id % 100 = 0")
def q15(spark, sf_dir):
    """Recall of the search by blocks against distances of single pairs."""
    e, asked = embeddings(spark, sf_dir), _asked(spark, sf_dir)
    pairs = e.join(F.broadcast(asked)).select("qid", F.col("vec_id").alias("id"), distance(F.col("embedding"), F.col("qvec")).alias("distance"))
    exact = pairs.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*S.order()))).where("place <= 10")
    return S.recall(S.batch_search(e, asked, 10, **E_), exact, 10)


@query("i2_graph_search")
def i2(spark, sf_dir):
    """Sharded graph search: the 10 nearest of every hundredth row."""
    p = ann.Parameters(shard_rows=1000)
    index = ann.build(embeddings(spark, sf_dir), p, "vec_id", "embedding")
    return ann.search(index, _asked(spark, sf_dir), 10, p).select("qid", "id", r6(F.col("distance")).alias("distance"), "place")


@query("i2_graph_recall", "SELECT true AS reached", base=False)
def i2_recall(spark, sf_dir):
    """Whether the graph search of every hundredth row has a recall of 0.9 against all rows."""
    e, asked, p = embeddings(spark, sf_dir), _asked(spark, sf_dir), ann.Parameters(shard_rows=1000)
    found = ann.search(ann.build(e, p, "vec_id", "embedding"), asked, 10, p)
    return S.recall(found, S.batch_search(e, asked, 10, **E_), 10).agg((F.avg("recall") >= 0.9).alias("reached"))


@query("a11_graph_statistics")
def a11(spark, sf_dir):
    return ann.statistics(ann.build(embeddings(spark, sf_dir), ann.Parameters(shard_rows=1000), "vec_id", "embedding"))


# metadata filters, on the properties of events and on the metadata of records


def _events(name: str, condition: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").where(compile_filter(condition, "props")).select("event_id")

    QUERIES[name] = run
    SQL[name] = f"SELECT event_id FROM (SELECT event_id, props, (props ->> '$.k')::DOUBLE AS k FROM events) WHERE {sql}"


_events("f0_empty", {}, "true")
_events("f1_simple", {"k": 42}, "k = 42")
_events("f2_and", {"$and": [{"k": {"$gt": 20}}, {"k": {"$lt": 30}}]}, "k > 20 AND k < 30")
_events("f3_or", {"$or": [{"k": 3}, {"k": 5}]}, "k = 3 OR k = 5")
_events("f4_not", {"$not": {"k": {"$gte": 10}}}, "NOT coalesce(k >= 10, false)")
_events("f5_siblings", {"$or": [{"k": {"$lt": 10}}, {"k": {"$gt": 90}}], "k": {"$ne": 95}}, "(k < 10 OR k > 90) AND k <> 95")
_events("f6_ne", {"k": {"$ne": 7}}, "k IS DISTINCT FROM 7")
_events("f7_gt", {"k": {"$gt": 50}}, "k > 50")
_events("f8_in", {"k": {"$in": [1, 2, 3]}}, "k IN (1, 2, 3)")
_events("f8_nin", {"k": {"$nin": [1, 2, 3]}}, "coalesce(k NOT IN (1, 2, 3), true)")
_events("f10_between", {"k": {"$between": [10, 20]}}, "k BETWEEN 10 AND 20")
_events("f11_exists", {"k": {"$exists": True}}, "json_exists(props, '$.k')")
_events("f12_type_number", {"k": {"$type": "number"}}, "json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'DOUBLE')")
_events("f18_several", {"k": {"$gte": 10, "$lte": 30, "$ne": 20}}, "k BETWEEN 10 AND 30 AND k <> 20")

RECORD = "SELECT id, file_no, epoch_us(ingested_at) AS arrived FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata::JSON END AS m FROM vectors) WHERE "


def _records(name: str, condition: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "vectors").where(compile_filter(condition)).select("id", "file_no", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("arrived"))

    QUERIES[name] = run
    SQL[name] = RECORD + sql


def _is(key: str, kind: str) -> str:
    return f"coalesce(json_type(m, '$.{key}') = '{kind}', false)"


STRING = lambda key, test: f"coalesce({_is(key, 'VARCHAR')} AND {test.format(x=f'(m ->> {chr(39)}$.{key}{chr(39)})')}, false)"

_records("f6_eq_null", {"tags": {"$eq": None}}, _is("tags", "NULL"))
_records("f6_eq_string", {"lang": {"$eq": "fr"}}, STRING("lang", "{x} = 'fr'"))
_records("f9_contains", {"caption": {"$contains": "shori"}}, STRING("caption", "contains({x}, 'shori')"))
_records("f11_missing", {"status": {"$exists": False}}, "m IS NULL OR NOT json_exists(m, '$.status')")
_records("f12_type_array", {"tags": {"$type": "array"}}, _is("tags", "ARRAY"))
_records("f12_type_object", {"unit_price": {"$type": "object"}}, _is("unit_price", "OBJECT"))
_records("f12_type_null", {"revision": {"$type": "null"}}, _is("revision", "NULL"))
_records("f13_regex", {"caption": {"$regex": "^[a-m].*el"}}, STRING("caption", "regexp_matches({x}, '^[a-m].*el')"))
_records("f13_regex_flags", {"status": {"$regex": {"pattern": "^ACT", "flags": "i"}}}, STRING("status", "regexp_matches({x}, '(?i)^ACT')"))
_records("f15_size", {"tags": {"$size": 2}}, f"{_is('tags', 'ARRAY')} AND json_array_length(m, '$.tags') = 2")
_records("f15_size_range", {"tags": {"$size": {"$gte": 2, "$lt": 4}}}, f"{_is('tags', 'ARRAY')} AND json_array_length(m, '$.tags') BETWEEN 2 AND 3")
_records("f16_all", {"tags": {"$all": ["sports", "travel"]}}, f"{_is('tags', 'ARRAY')} AND list_contains(json_extract(m, '$.tags[*]')::VARCHAR[], '\"sports\"') AND list_contains(json_extract(m, '$.tags[*]')::VARCHAR[], '\"travel\"')")
_records("f17_elem_match", {"tags": {"$elemMatch": {"value": {"$in": ["travel", "toys"]}}}}, f"{_is('tags', 'ARRAY')} AND (list_contains(json_extract(m, '$.tags[*]')::VARCHAR[], '\"travel\"') OR list_contains(json_extract(m, '$.tags[*]')::VARCHAR[], '\"toys\"'))")
_records("f19_deep_array", {"tags": ["tools"]}, f"{_is('tags', 'ARRAY')} AND (m -> '$.tags')::VARCHAR = '[\"tools\"]'")
_records("f19_deep_object", {"unit_price": {"amount": 42.29, "unit": "eur"}}, f"{_is('unit_price', 'OBJECT')} AND len(json_keys(m -> '$.unit_price')) = 2 AND (m ->> '$.unit_price.unit') = 'eur' AND (m ->> '$.unit_price.amount')::DOUBLE = 42.29")
_records("f21_builder", FilterBuilder().range("revision", 2, 3).is_in("status", ["active", "draft"]).build(), f"coalesce({_is('revision', 'UBIGINT')} AND (m ->> '$.revision')::DOUBLE BETWEEN 2 AND 3 AND {_is('status', 'VARCHAR')} AND (m ->> '$.status') IN ('active', 'draft'), false)")


# aggregates

CELLS = "(SELECT label, (i - 1)::INT AS pos, v[i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e))"


@query("a1_mean", f"SELECT label, pos, {r6_sql('avg(value)')} AS mean FROM {CELLS} GROUP BY label, pos")
def a1(spark, sf_dir):
    found = A.centroid(embeddings(spark, sf_dir), "embedding", ("label",))
    return found.select("label", F.posexplode("centroid").alias("pos", "m")).select("label", "pos", r6(F.col("m")).alias("mean"))


@query("a2_variance", f"SELECT pos, {r6_sql('var_pop(value)')} AS variance FROM {CELLS} GROUP BY pos")
def a2(spark, sf_dir):
    return A.by_dimension(embeddings(spark, sf_dir), "embedding").select("pos", r6(F.col("variance")).alias("variance"))


@query("a3_standard_deviation", f"SELECT pos, {r6_sql('stddev_pop(value)')} AS std FROM {CELLS} GROUP BY pos")
def a3(spark, sf_dir):
    return A.by_dimension(embeddings(spark, sf_dir), "embedding").select("pos", r6(F.col("std")).alias("std"))


@query("a4_vector_statistics", f"SELECT vec_id, {r6_sql('lo')} AS low, {r6_sql('hi')} AS high, {r6_sql('m')} AS mean, {r6_sql('sqrt(' + total('(v[i] - m) * (v[i] - m)') + ' / len(v))')} AS std, {r6_sql('hi - lo')} AS span FROM (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi, {total('v[i]')} / len(v) AS m FROM e)")
def a4(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", *[r6(c).alias(k) for k, c in A.vector_statistics(F.col("embedding")).items()])


@query("a5_batch_statistics", f"SELECT pos, {r6_sql('min(value)')} AS low, {r6_sql('max(value)')} AS high, {r6_sql('avg(value)')} AS mean, {r6_sql('stddev_pop(value)')} AS std FROM {CELLS} GROUP BY GROUPING SETS ((pos), ())")
def a5(spark, sf_dir):
    return A.batch_statistics(embeddings(spark, sf_dir), "embedding").select("pos", *[r6(F.col(c)).alias(c) for c in ("low", "high", "mean", "std")])


@query("a6_count", "SELECT count(*) AS vectors, 64::INT AS dimension FROM e")
def a6(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dimension"))


@query("a10_profile", """SELECT event_type, count("value") AS n, min("value") AS low, max("value") AS high, round(avg("value"), 6) AS mean, round(sum("value"), 4) AS total,
percentile_disc(0.5) WITHIN GROUP (ORDER BY "value") AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY "value") AS p90, percentile_disc(0.95) WITHIN GROUP (ORDER BY "value") AS p95, percentile_disc(0.99) WITHIN GROUP (ORDER BY "value") AS p99 FROM events GROUP BY event_type""", base=False)
def a10(spark, sf_dir):
    found = A.profile(table(spark, sf_dir, "events"), "value", ("event_type",))
    return found.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


HISTORY = """h AS (SELECT epoch_ms(date_trunc('day', ts)) AS ts, count(*) * 100 AS usage FROM events GROUP BY 1), l AS (SELECT * FROM h ORDER BY ts DESC LIMIT {n})"""


def _history(spark, sf_dir) -> DataFrame:
    """Usage by day: 100 bytes for each event."""
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").groupBy(day.alias("ts")).agg((F.count(F.lit(1)) * 100).alias("usage"))


GROWTH = "(arg_max(usage, ts) - arg_min(usage, ts))"


@query("a12_usage_trend", f"""WITH {HISTORY.format(n=5)}, r AS (SELECT count(*) AS n, {GROWTH} / (max(ts) - min(ts)) * 3600000 AS rate FROM l)
SELECT CASE WHEN n < 3 THEN 'insufficient_data' WHEN abs(rate) < 1024 THEN 'stable' WHEN rate > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, round(rate, 6) AS rate, round(least(n / 10, 1.0), 6)::DOUBLE AS confidence FROM r""", base=False)
def a12(spark, sf_dir):
    return monitor.usage_trend(_history(spark, sf_dir)).select("trend", F.round("rate", 6).alias("rate"), F.round("confidence", 6).alias("confidence"))


@query("a13_time_to_full", f"WITH {HISTORY.format(n=10)} SELECT CASE WHEN count(*) >= 5 AND {GROWTH} > 0 THEN round(1000000.0 / ({GROWTH} / (max(ts) - min(ts))), 3)::DOUBLE END AS ms FROM l", base=False)
def a13(spark, sf_dir):
    return monitor.time_to_full(_history(spark, sf_dir), 1_000_000).select(F.round("ms", 3).alias("ms"))


@query("a14_breakdown", "SELECT namespace, count(*) AS records, sum(coalesce(len(vector), 0) * 4 + coalesce(strlen(metadata), 0))::BIGINT AS bytes FROM vectors GROUP BY namespace", base=False)
def a14(spark, sf_dir):
    size = F.coalesce(F.greatest(F.size("vector"), F.lit(0)), F.lit(0)) * 4 + F.coalesce(F.octet_length("metadata"), F.lit(0))
    return monitor.breakdown(table(spark, sf_dir, "vectors"), "namespace", size.cast("bigint"))


@query("a15_index_bytes")
def a15(spark, sf_dir):
    """Shards of a saved index and the bytes of their JSON."""
    index = ann.build(embeddings(spark, sf_dir), ann.Parameters(shard_rows=1000), "vec_id", "embedding")
    return index.agg(F.count(F.lit(1)).alias("shards"), F.sum(F.octet_length(F.to_json(F.struct("shard", "nodes", "graph", F.base64("vectors").alias("vectors"))))).alias("bytes"))



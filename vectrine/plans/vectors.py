"""Queries of metrics, scores and functions of single vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.functions import metrics as M
from vectrine.functions import vectors as V
from vectrine.operators import search as S
from vectrine.plans.common import BASE, METRIC, embeddings, query_vector, r6, r6_sql, scaled, total

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {BASE} {sql}"
        return f

    return put


def _metric(number: int, name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = query_vector(spark, sf_dir)
        found = S.with_distance(scaled(embeddings(spark, sf_dir)), q, name, "embedding")
        return found.select("vec_id", r6(F.col("distance")).alias("distance"))

    QUERIES[f"m{number}_{name}"] = run
    SQL[f"m{number}_{name}"] = f"WITH {BASE} SELECT vec_id, {r6_sql(METRIC[name])} AS distance FROM s, q"


for n_, name_ in ((1, "cosine"), (2, "euclidean"), (3, "manhattan"), (4, "hamming"), (5, "jaccard"), (6, "dot"), (11, "hamming_exact_frac"), (12, "weighted_jaccard")):
    _metric(n_, name_)


@query("m8_calculate", f"SELECT a.vec_id, {r6_sql(METRIC['euclidean'])} AS distance FROM e a, q WHERE len(v) = len(q)")
def m8(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    return embeddings(spark, sf_dir).select("vec_id", r6(M.distance(F.col("embedding"), q, "euclidean", strict=True)).alias("distance"))


@query("m9_calculate_batch", f"SELECT vec_id, {r6_sql(METRIC['manhattan'])} AS distance FROM e, q")
def m9(spark, sf_dir):
    return S.with_distance(embeddings(spark, sf_dir), query_vector(spark, sf_dir), "manhattan", "embedding").select("vec_id", r6(F.col("distance")).alias("distance"))


@query("m10_find_nearest", f"SELECT vec_id AS id, {r6_sql('d')} AS distance FROM (SELECT vec_id, {METRIC['euclidean']} AS d FROM e, q) ORDER BY round(d, 9), vec_id LIMIT 7")
def m10(spark, sf_dir):
    return S.knn(embeddings(spark, sf_dir), query_vector(spark, sf_dir), 7, "euclidean", key="vec_id", vector="embedding").select("id", r6(F.col("distance")).alias("distance"))


@query("m13_batch_distances", " UNION ALL ".join(f"SELECT '{m}' AS metric, vec_id, (round({METRIC[m]}, 4) + 0.0) AS distance FROM s, q" for m in ("cosine", "euclidean", "manhattan", "dot")))
def m13(spark, sf_dir):
    q, df, out = query_vector(spark, sf_dir), scaled(embeddings(spark, sf_dir)), None
    named = [F.struct(F.lit(m).alias("metric"), (F.round(M.distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q]), m), 4) + 0.0).alias("distance")) for m in ("cosine", "euclidean", "manhattan", "dot")]
    out = df.select("vec_id", F.explode(F.array(*named)).alias("x"))
    return out.select("x.metric", "vec_id", "x.distance")


@query("m15_distance_matrix", f"SELECT b.vec_id AS qid, a.vec_id AS id, {r6_sql(METRIC['euclidean'].replace('q[', 'b.v[').replace('v[i]', 'a.v[i]').replace('b.a.v', 'b.v').replace('len(v)', 'len(a.v)'))} AS distance FROM e a, e b WHERE b.vec_id % 100 = 0")
def m15(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vector").alias("qvec"))
    return S.all_distances(rows, asked, "euclidean").select("qid", "id", r6(F.col("distance")).alias("distance"))


SCORES = {
    "cosine": "greatest(0.0, least(1.0, 1 - d / 2))", "dot": "-d", "euclidean": "exp(-d)", "manhattan": "exp(-d)", "hamming": "1 - d / 64", "jaccard": "1 - d", "weighted_jaccard": "1 / (1 + d)",
}


@query("s1_score", " UNION ALL ".join(f"SELECT '{m}' AS metric, vec_id, {r6_sql(x)} AS score FROM (SELECT vec_id, {METRIC[m]} AS d FROM s, q)" for m, x in SCORES.items()))
def s1(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    df = scaled(embeddings(spark, sf_dir))
    named = [F.struct(F.lit(m).alias("metric"), r6(M.score(M.distance(F.col("embedding"), q, m), m, 64)).alias("score")) for m in SCORES]
    return df.select("vec_id", F.explode(F.array(*named)).alias("x")).select("x.metric", "vec_id", "x.score")


@query("s2_inverse_score", f"SELECT vec_id, {r6_sql('1 / (1 + d)')} AS score, {r6_sql('1 / (1 / (1 + d)) - 1')} AS back FROM (SELECT vec_id, {METRIC['euclidean']} AS d FROM s, q)")
def s2(spark, sf_dir):
    found = S.with_distance(scaled(embeddings(spark, sf_dir)), query_vector(spark, sf_dir), "euclidean", "embedding")
    s = M.inverse_score(F.col("distance"))
    return found.select("vec_id", r6(s).alias("score"), r6(M.distance_of_score(s, "euclidean")).alias("back"))


# functions of single vectors


def _positions(df: DataFrame, value, name: str = "value") -> DataFrame:
    """A row for each element of an array column."""
    return df.select("vec_id", F.posexplode(value).alias("pos", name)).select("vec_id", "pos", r6(F.col(name).cast("double")).alias(name))


def _elements(expr: str, source: str = "s", extra: str = "") -> str:
    return f"SELECT vec_id, i - 1 AS pos, {r6_sql(expr)} AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {source}{extra})".replace("i - 1 AS pos", "(i - 1)::INT AS pos")


F32 = lambda x: f"({x})::FLOAT::DOUBLE"


@query("v1_magnitude", f"SELECT vec_id, {r6_sql('sqrt(' + total('v[i] * v[i]') + ')')} AS magnitude FROM s")
def v1(spark, sf_dir):
    return scaled(embeddings(spark, sf_dir)).select("vec_id", r6(V.magnitude(F.col("embedding"))).alias("magnitude"))


NORMED = f"(SELECT vec_id, v, sqrt({total('v[i] * v[i]')}) AS n FROM s)"


@query("v2_normalize", _elements(F32("v[i] / n"), NORMED))
def v2(spark, sf_dir):
    return _positions(scaled(embeddings(spark, sf_dir)), V.normalize(F.col("embedding")))


@query("v3_is_normalized", f"SELECT vec_id, abs(n - 1) < 1e-6 AS normalized FROM {NORMED}")
def v3(spark, sf_dir):
    return scaled(embeddings(spark, sf_dir)).select("vec_id", V.is_normalized(F.col("embedding")).alias("normalized"))


def _pairs(spark, sf_dir) -> DataFrame:
    """Each vector a beside its successor b by vec_id."""
    e = embeddings(spark, sf_dir)
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


PAIRS = "(SELECT x.vec_id, x.v, y.v AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)"


@query("v4_dot_product", f"SELECT vec_id, {r6_sql(total('v[i] * b[i]'))} AS value FROM {PAIRS}")
def v4(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", r6(V.dot_product(F.col("a"), F.col("b"))).alias("value"))


@query("v5_add", _elements(F32("v[i] + b[i]"), PAIRS))
def v5(spark, sf_dir):
    return _positions(_pairs(spark, sf_dir), V.add(F.col("a"), F.col("b")))


@query("v6_subtract", _elements(F32("v[i] - b[i]"), PAIRS))
def v6(spark, sf_dir):
    return _positions(_pairs(spark, sf_dir), V.subtract(F.col("a"), F.col("b")))


@query("v7_scale", _elements(F32("v[i] * 2.5"), "e"))
def v7(spark, sf_dir):
    return _positions(embeddings(spark, sf_dir), V.scale(F.col("embedding"), 2.5))


@query("v8_equals", f"SELECT vec_id, len(v) = len(b) AND len(list_filter(range(1, len(v) + 1), lambda i: abs(v[i] - b[i]) > 0.4)) = 0 AS same FROM {PAIRS}")
def v8(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", V.equals(F.col("a"), F.col("b"), 0.4).alias("same"))


@query("v9_fused_multiply_add", _elements(F32("v[i] * b[i] + v[i]"), PAIRS))
def v9(spark, sf_dir):
    return _positions(_pairs(spark, sf_dir), V.fused_multiply_add(F.col("a"), F.col("b"), F.col("a")))


@query("v10_batch_dot_product", f"SELECT vec_id, {r6_sql(total('v[i] * q[i]'))} AS value FROM s, q")
def v10(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in query_vector(spark, sf_dir)])
    return scaled(embeddings(spark, sf_dir)).select("vec_id", r6(M.dot(F.col("embedding"), q)).alias("value"))


@query("v11_batch_normalize", f"SELECT vec_id, {r6_sql('sqrt(' + total('v[i] / n * (v[i] / n)') + ')')} AS length FROM {NORMED}")
def v11(spark, sf_dir):
    unit = V.normalize(F.col("embedding"), "double")
    return scaled(embeddings(spark, sf_dir)).select("vec_id", r6(V.magnitude(unit)).alias("length"))


@query("v12_random")
def v12(spark, sf_dir):
    """Random vectors of each id, and their lengths once scaled to 1."""
    e = embeddings(spark, sf_dir)
    v = V.random_vector(F.col("vec_id"), 16)
    return e.select("vec_id", F.array_min(v).alias("low"), F.array_max(v).alias("high"), r6(V.magnitude(V.random_unit(F.col("vec_id"), 16))).alias("length"))


@query("v13_prepare", f"SELECT vec_id, {r6_sql('n')} AS magnitude, 'float32' AS format, abs(n - 1) < 1e-6 AS normalized, 5::BIGINT AS \"timestamp\" FROM {NORMED}")
def v13(spark, sf_dir):
    made = V.prepared(scaled(embeddings(spark, sf_dir)), "embedding", now_ms=5)
    return made.select("vec_id", r6(F.col("magnitude")).alias("magnitude"), "format", "normalized", "timestamp")


@query("v14_detect_format", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'binary' ELSE 'uint8' END AS format FROM e")
def v14(spark, sf_dir):
    v = F.transform("embedding", lambda x: F.when(x > 0, 1 + F.col("label") % 2 * 6).otherwise(0).cast("smallint"))
    return embeddings(spark, sf_dir).select("vec_id", V.detect_format(v, "smallint").alias("format"))


INT8 = "floor(greatest(-1.0, least(1.0, v[i])) * 127 + 0.5)"
UINT8 = "floor(greatest(0.0, least(1.0, v[i])) * 255 + 0.5)"


@query("v15_to_float32", _elements(F32(INT8 + " / 127"), "e"))
def v15(spark, sf_dir):
    return _positions(embeddings(spark, sf_dir), V.to_float32(V.from_float32(F.col("embedding"), "int8"), "int8"))


@query("v16_from_float32", " UNION ALL ".join(f"SELECT '{f}' AS format, vec_id, (i - 1)::INT AS pos, {x}::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM s)" for f, x in (("int8", INT8), ("uint8", UINT8), ("binary", "(v[i] > 0)::INT"))))
def v16(spark, sf_dir):
    df, out = scaled(embeddings(spark, sf_dir)), None
    named = [F.struct(F.lit(f).alias("format"), F.transform(V.from_float32(F.col("embedding"), f), lambda x: x.cast("double")).alias("v")) for f in ("int8", "uint8", "binary")]
    out = df.select("vec_id", F.explode(F.array(*named)).alias("x"))
    return out.select("x.format", "vec_id", F.posexplode("x.v").alias("pos", "value"))


@query("v17_validate", """SELECT id, file_no, ingested_at::VARCHAR AS arrived, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> 128 THEN 'dimension'
 WHEN len(list_filter(vector, lambda x: NOT coalesce(isfinite(x), false))) > 0 THEN 'not finite'
 WHEN NOT abs(sqrt(list_sum(list_transform(vector::DOUBLE[], lambda x: x * x))) - 1) < 1e-6 THEN 'not normalized' END AS problem FROM vectors""".replace("ingested_at::VARCHAR AS arrived", "epoch_us(ingested_at) AS arrived"))
def v17(spark, sf_dir):
    from vectrine.session import table

    found = V.problem(F.col("vector"), 128, normalized=True)
    return table(spark, sf_dir, "vectors").select("id", "file_no", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("arrived"), found.alias("problem"))


@query("v18_byte_size", " UNION ALL ".join(f"SELECT '{f}' AS format, vec_id, (len(v) * {w})::INT AS bytes FROM e" for f, w in V.BYTES.items()))
def v18(spark, sf_dir):
    named = F.array(*[F.struct(F.lit(f).alias("format"), V.byte_size(F.col("embedding"), f).alias("bytes")) for f in V.BYTES])
    return embeddings(spark, sf_dir).select("vec_id", F.explode(named).alias("x")).select("x.format", "vec_id", "x.bytes")


@query("v19_zero_vector", "SELECT vec_id, 0.0::DOUBLE AS total, 8::INT AS dimension FROM e")
def v19(spark, sf_dir):
    z = V.zero_vector(8)
    return embeddings(spark, sf_dir).select("vec_id", M.total(F.transform(z, lambda x: x.cast("double"))).alias("total"), F.size(z).alias("dimension"))


@query("v20_normalize_format", _elements("floor(greatest(-1.0, least(1.0, v[i] / n)) * 127 + 0.5)", NORMED))
def v20(spark, sf_dir):
    unit = V.normalize_strict(F.col("embedding"), "double")
    return _positions(scaled(embeddings(spark, sf_dir)), V.from_float32(unit, "int8"))


@query("v21_is_equal", f"SELECT vec_id, len(list_filter(range(1, len(v) + 1), lambda i: abs(v[i] - {INT8} / 127) > 0.003)) = 0 AS same FROM e")
def v21(spark, sf_dir):
    back = F.transform(V.from_float32(F.col("embedding"), "int8"), lambda x: x.cast("double") / 127)
    return embeddings(spark, sf_dir).select("vec_id", V.equals(F.col("embedding"), back, 0.003).alias("same"))


MEAN = f"({total('v[i]')} / len(v))"
INFO = f"(SELECT vec_id, v, n, m, sqrt({total('(v[i] - m) * (v[i] - m)')} / len(v)) AS sd, list_min(v) AS lo, list_max(v) AS hi FROM (SELECT *, {MEAN} AS m FROM {NORMED}))"


@query("v22_vector_info", f"SELECT vec_id, 'float32' AS format, len(v)::INT AS dimension, (4 * len(v))::INT AS bytes, {r6_sql('n')} AS magnitude, abs(n - 1) < 1e-6 AS normalized, false AS invalid, {r6_sql('lo')} AS low, {r6_sql('hi')} AS high, {r6_sql('m')} AS mean, {r6_sql('sd')} AS std FROM {INFO}")
def v22(spark, sf_dir):
    told = V.describe(F.col("embedding"))
    numbers = ("magnitude", "low", "high", "mean", "std")
    return scaled(embeddings(spark, sf_dir)).select("vec_id", *[(r6(c) if k in numbers else c).alias(k) for k, c in told.items()])


@query("v23_best_format", f"SELECT vec_id, CASE WHEN lo >= 0 AND hi <= 1 AND sd > 0.01 THEN 'uint8' WHEN lo >= -1 AND hi <= 1 AND sd > 0.01 THEN 'int8' ELSE 'float32' END AS format FROM {INFO}")
def v23(spark, sf_dir):
    return scaled(embeddings(spark, sf_dir)).select("vec_id", V.best_format(F.col("embedding")).alias("format"))

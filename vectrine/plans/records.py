"""Queries of quantization, storage, eviction, namespaces, monitoring and codecs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrine.operators import eviction as E
from vectrine.operators import monitor as M
from vectrine.operators import namespaces as N
from vectrine.operators import pq as P
from vectrine.operators import quantize as Z
from vectrine.operators.records import current_rows
from vectrine.plans.common import BASE, NOW, embeddings, query_vector, r6, r6_sql, total
from vectrine.session import materialize, shared_path, table
from vectrine.sources import codecs as C
from vectrine.sources import table as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {BASE} {sql}" if base else sql
        return f

    return put


# scalar quantization


@query("k1_bounds_global", f"SELECT {r6_sql('min(list_min(v))')} AS low, {r6_sql('max(list_max(v))')} AS high FROM e")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Z.bounds(embeddings(spark, sf_dir), "embedding").select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


CELLS = "(SELECT vec_id, (i - 1)::INT AS pos, v[i] AS x FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e))"


@query("k1_bounds_dimension", f"SELECT pos, {r6_sql('min(x)')} AS low, {r6_sql('max(x)')} AS high FROM {CELLS} GROUP BY pos")
def k1_dimension(spark, sf_dir):
    return Z.dimension_bounds(embeddings(spark, sf_dir), "embedding").select("pos", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("k1_bounds_percentile", f"SELECT {r6_sql('max(x) FILTER (n = floor(c * 0.01))')} AS low, {r6_sql('max(x) FILTER (n = floor(c * 0.99))')} AS high FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS n, count(*) OVER () AS c FROM {CELLS})")
def k1_percentile(spark, sf_dir):
    return Z.percentile_bounds(embeddings(spark, sf_dir), "embedding").select(r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


CODE = "greatest(0, least(255, floor((v[i] + 1) / 2 * 255 + 0.5)))::INT"


def _coded(df: DataFrame):
    return Z.quantize(F.col("embedding"), F.lit(-1.0), F.lit(1.0), 8)


@query("k2_quantize", f"SELECT vec_id, (i - 1)::INT AS pos, {CODE} AS code, {r6_sql(f'-1 + {CODE} / 255 * 2')} AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e)")
def k2(spark, sf_dir):
    codes = _coded(embeddings(spark, sf_dir))
    found = embeddings(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip(codes.alias("c"), Z.dequantize(codes, F.lit(-1.0), F.lit(1.0), 8).alias("v"))).alias("pos", "x"))
    return found.select("vec_id", "pos", F.col("x").getField("c").alias("code"), r6(F.col("x").getField("v")).alias("value"))


@query("k3_optimal_bits", "SELECT vec_id, loss, CASE loss WHEN 0.0005 THEN 16 WHEN 0.005 THEN 12 WHEN 0.02 THEN CASE WHEN hi - lo > 1000 THEN 12 ELSE 8 END ELSE CASE WHEN hi - lo > 1000 THEN 12 WHEN hi - lo > 100 THEN 8 ELSE 4 END END::INT AS bits FROM (SELECT vec_id, list_min(v) * vec_id AS lo, list_max(v) * vec_id AS hi FROM e), (VALUES (0.0005::DOUBLE), (0.005), (0.02), (0.05)) t(loss)".replace("WHEN 0.005 THEN 12", "WHEN 0.005 THEN 12"))
def k3(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * F.col("vec_id"))
    named = F.array(*[F.struct(F.lit(loss).alias("loss"), Z.optimal_bits(v, loss).alias("bits")) for loss in (0.0005, 0.005, 0.02, 0.05)])
    return embeddings(spark, sf_dir).select("vec_id", F.explode(named).alias("x")).select("vec_id", "x.loss", "x.bits")


@query("k4_bit_packing", "SELECT vec_id, 5::INT AS bits, true AS same, 40::INT AS bytes FROM e")
def k4(spark, sf_dir):
    """Codes of 5 bits packed and unpacked again."""
    codes = Z.quantize(F.col("embedding"), F.lit(-1.0), F.lit(1.0), 5)
    df = embeddings(spark, sf_dir).select("vec_id", codes.alias("codes"), F.size("embedding").alias("n"))
    df = df.withColumn("data", C.packed("codes", 5)).withColumn("back", C.unpacked("data", "n", 5))
    return df.select("vec_id", F.lit(5).alias("bits"), (F.col("codes") == F.col("back")).alias("same"), F.length("data").alias("bytes"))


@query("k5_memory", "SELECT dimension, bits, (ceil((ceil(dimension * bits / 8) + 8) / 4) * 4)::BIGINT AS bytes FROM (SELECT (vec_id + 1)::INT AS dimension FROM e), (VALUES (4), (8), (12), (16)) t(bits)")
def k5(spark, sf_dir):
    df = embeddings(spark, sf_dir).select((F.col("vec_id") + 1).cast("int").alias("dimension"), F.explode(F.array(*map(F.lit, (4, 8, 12, 16)))).alias("bits"))
    return df.withColumn("bytes", Z.memory(F.col("dimension"), F.col("bits")).cast("bigint"))


LEVEL = "(greatest(0, least(15, floor((v[i] - lo) / (hi - lo) * 15 + 0.5))))"
BACK = f"(SELECT vec_id, v, list_transform(range(1, len(v) + 1), lambda i: lo + {LEVEL} / 15 * (hi - lo)) AS w FROM (SELECT vec_id, v, list_min(v) AS lo, list_max(v) AS hi FROM e))"


@query("k6_scalar_compress", f"SELECT vec_id, (i - 1)::INT AS pos, {r6_sql('w[i]')} AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM {BACK})")
def k6(spark, sf_dir):
    v = F.col("embedding")
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    back = Z.dequantize(Z.quantize(v, low, high, 4), low, high, 4)
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(back).alias("pos", "value")).select("vec_id", "pos", r6(F.col("value")).alias("value"))


MSE = f"({total('(v[i] - w[i]) * (v[i] - w[i])')} / len(v))"
COSINE = f"({total('v[i] * w[i]')} / (sqrt({total('v[i] * v[i]')}) * sqrt({total('w[i] * w[i]')})))"


@query("k7_quality", f"SELECT vec_id, {r6_sql('mse')} AS mse, {r6_sql('snr')} AS snr, {r6_sql('c')} AS cosine, {r6_sql('sqrt(mse * 64)')} AS euclidean, {r6_sql('0.3 * greatest(0.0, 1 - mse) + 0.3 * greatest(0.0, least(1.0, snr / 20)) + 0.4 * c')} AS score FROM (SELECT vec_id, mse, c, 10 * log10({total('v[i] * v[i]')} / len(v) / mse) AS snr FROM (SELECT vec_id, v, {MSE} AS mse, {COSINE} AS c FROM {BACK}))")
def k7(spark, sf_dir):
    v = F.col("embedding")
    # columns of their own, else the bounds are looked for again at each element
    df = embeddings(spark, sf_dir).withColumns({"low": F.array_min(v).cast("double"), "high": F.array_max(v).cast("double")})
    df = df.withColumn("back", Z.dequantize(Z.quantize(v, F.col("low"), F.col("high"), 4), F.col("low"), F.col("high"), 4))
    return df.select("vec_id", Z.quality_sums(v, F.col("back")).alias("sums")).select("vec_id", *[r6(c).alias(k) for k, c in Z.quality_of(F.col("sums")).items()])


BOOK = P.Codebook(np.stack([np.stack([np.full(8, (k - 8) / 32 + m / 100) for k in range(16)]) for m in range(8)]), 0.0)
#: The same codebook in SQL: 8 subspaces of 8 elements, 16 constant centroids each.
FIXED_CODES = """codes AS (SELECT vec_id, m::INT AS m, arg_min(k, (round(d, 12), k))::INT AS code FROM (
SELECT vec_id, m, k, list_sum(list_transform(range(1, 9), lambda i: (v[m * 8 + i] - ((k - 8) / 32 + m / 100)) * (v[m * 8 + i] - ((k - 8) / 32 + m / 100)))) AS d FROM e, range(8) a(m), range(16) b(k)) GROUP BY vec_id, m)"""


@query("k8_pq_train")
def k8(spark, sf_dir):
    """Trained codebook: a row for each subspace and centroid with its length."""
    book = P.train(embeddings(spark, sf_dir), 8, 16, "embedding", "vec_id")
    rows = [(m, k, float(np.sqrt((c**2).sum()))) for m, part in enumerate(book.centroids) for k, c in enumerate(part)]
    return spark.createDataFrame(rows, "subspace int, centroid int, length double")


@query("k9_pq_encode", f", {FIXED_CODES} SELECT vec_id, m AS subspace, code FROM codes")
def k9(spark, sf_dir):
    found = P.encode(embeddings(spark, sf_dir), BOOK, "embedding", "vec_id")
    return found.select("vec_id", F.posexplode("codes").alias("subspace", "code"))


@query("k9_pq_decode", f", {FIXED_CODES} SELECT vec_id, round(sum(((code - 8) / 32 + m / 100) * 8), 4) + 0.0 AS total FROM codes GROUP BY vec_id")
def k9_decode(spark, sf_dir):
    found = P.decode(P.encode(embeddings(spark, sf_dir), BOOK, "embedding", "vec_id"), BOOK, "vec_id")
    total_ = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return found.select("vec_id", (F.round(total_, 4) + 0.0).alias("total"))


@query("k10_pq_distance", f", {FIXED_CODES} SELECT vec_id, {r6_sql('sqrt(sum(d))')} AS distance FROM (SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: (q[m * 8 + i] - ((code - 8) / 32 + m / 100)) * (q[m * 8 + i] - ((code - 8) / 32 + m / 100)))) AS d FROM codes, q) GROUP BY vec_id")
def k10(spark, sf_dir):
    codes = P.encode(embeddings(spark, sf_dir), BOOK, "embedding", "vec_id")
    return P.asymmetric(codes, BOOK, query_vector(spark, sf_dir), key="vec_id").select("vec_id", r6(F.col("distance")).alias("distance"))


@query("k11_pq_statistics", "SELECT 64::INT AS dimension, 32.0::DOUBLE AS ratio, 65536::BIGINT AS codebook_bytes", base=False)
def k11(spark, sf_dir):
    told = P.statistics(64, 8, 256)
    return spark.createDataFrame([(64, told["ratio"], told["codebook_bytes"])], "dimension int, ratio double, codebook_bytes bigint")


BINS = "list_transform(v, lambda x: least(31, floor((x - lo) / ((hi - lo) / 32))))"
ANALYSED = f"""(SELECT vec_id, len(v)::INT AS size, len(list_filter(v, lambda x: abs(x) < 1e-6)) / len(v) AS sparsity,
list_sum(list_transform(range(32), lambda b: CASE WHEN len(list_filter(bins, lambda x: x = b)) > 0 THEN -(len(list_filter(bins, lambda x: x = b)) / len(v)) * log2(len(list_filter(bins, lambda x: x = b)) / len(v)) ELSE 0.0 END)) AS entropy,
len(list_filter(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]) > 1e-6)) / (len(v) - 1) AS complexity,
1 + len(list_filter(range(2, len(u) + 1), lambda i: u[i] - u[i - 1] > (hi - lo) / 10)) AS clusters, len(u) AS uniques, hi - lo AS span
FROM (SELECT *, {BINS} AS bins FROM (SELECT vec_id, v, list_sort(list_distinct(v)) AS u, list_min(v) AS lo, list_max(v) AS hi FROM e)))"""


@query("k12_analysis", f"SELECT vec_id, size, {r6_sql('sparsity')} AS sparsity, {r6_sql('entropy')} AS entropy, {r6_sql('complexity')} AS complexity, clusters::INT AS clusters, uniques::INT AS uniques, uniques <= 3 AS is_binary, {r6_sql('span')} AS span FROM {ANALYSED}")
def k12(spark, sf_dir):
    a = Z.analysis(F.col("embedding"))
    return embeddings(spark, sf_dir).select("vec_id", "embedding").select(
        "vec_id", a["size"].alias("size"), *[r6(a[c]).alias(c) for c in ("sparsity", "entropy", "complexity")], a["clusters"].alias("clusters"), a["distinct"].alias("uniques"), a["binary"].alias("is_binary"), r6(a["span"]).alias("span"),
    )


SCORED = f"""(SELECT vec_id, least(1.0, 0.7 + 0.1 + CASE WHEN complexity <= 0.5 THEN 0.1 ELSE 0.0 END + CASE WHEN sparsity < 0.3 THEN 0.05 ELSE 0.0 END) AS scalar,
least(1.0, 0.3 + CASE WHEN entropy >= 4 THEN 0.2 ELSE 0.0 END + CASE WHEN complexity > 0.5 THEN 0.2 ELSE 0.0 END + CASE WHEN clusters > 6 THEN 0.1 ELSE 0.0 END) AS product FROM {ANALYSED})"""


@query("k13_strategy", f"SELECT vec_id, {r6_sql('scalar')} AS scalar, {r6_sql('product')} AS product, CASE WHEN scalar >= product THEN 'scalar' ELSE 'product' END AS strategy FROM {SCORED}")
def k13(spark, sf_dir):
    scores = Z.strategy_scores(Z.analysis(F.col("embedding")))
    found = embeddings(spark, sf_dir).select("vec_id", *[r6(c).alias(k) for k, c in scores.items()])
    return found.withColumn("strategy", F.when(F.col("scalar") >= F.col("product"), "scalar").otherwise("product"))


@query("k14_compare", f"SELECT vec_id, {r6_sql('256 / 72')} AS scalar_ratio, 0.02::DOUBLE AS scalar_loss, {r6_sql('64 * 32 / 64')} AS product_ratio, {r6_sql('0.028')}::DOUBLE AS product_loss, 96.0::DOUBLE AS scalar_bytes, 65536.0::DOUBLE AS product_bytes FROM e")
def k14(spark, sf_dir):
    found = Z.estimates(Z.analysis(F.col("embedding")))
    return embeddings(spark, sf_dir).select("vec_id", *[r6(found[c]).alias(c) for c in ("scalar_ratio", "scalar_loss", "product_ratio", "product_loss", "scalar_bytes", "product_bytes")])


@query("k15_int8", f"SELECT vec_id, (i - 1)::INT AS pos, floor(v[i] * (127 / top) + 0.5)::INT AS code, {r6_sql('1 / (127 / top)')} AS factor FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM e))")
def k15(spark, sf_dir):
    codes, factor = Z.int8_codes(F.col("embedding"))
    return embeddings(spark, sf_dir).select("vec_id", r6(factor).alias("factor"), F.posexplode(codes).alias("pos", "code"))


# eviction, on the current records


def _measured(spark, sf_dir) -> DataFrame:
    rows = current_rows(table(spark, sf_dir, "vectors"), "vector", "metadata", "timestamp", "last_accessed", "access_count")
    # metadata is counted as its characters, which SQL can count, too
    size = 4 * F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) + F.coalesce(F.length("metadata"), F.lit(0)) * 2 + 2 * F.length("id") + 64
    return materialize(E.measured(rows.where(F.coalesce(E.last_access(), F.lit(0)) != 0), size), "measured")


CURRENT = """c AS (SELECT id, vector, metadata, "timestamp" AS t, last_accessed, access_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN "timestamp" IS NULL OR "timestamp" = 0 THEN last_accessed ELSE "timestamp" END DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n FROM vectors WHERE id IS NOT NULL) WHERE n = 1)"""
MEASURED = f"""{CURRENT},
m AS (SELECT * FROM (SELECT id, t, coalesce(access_count, 0) AS uses, metadata, (4 * coalesce(len(vector), 0) + 2 * coalesce(length(metadata), 0) + 2 * length(id) + 64)::BIGINT AS size, CASE WHEN coalesce(last_accessed, 0) = 0 THEN t ELSE last_accessed END AS accessed,
coalesce(CASE WHEN json_valid(metadata) THEN json_type(metadata, '$.permanent') = 'BOOLEAN' AND (metadata ->> '$.permanent') = 'true' END, false) AS permanent FROM c) WHERE coalesce(accessed, 0) <> 0)"""


def _running(order: str, keep: str) -> str:
    return f"WITH {MEASURED} SELECT id, size, place::BIGINT AS place FROM (SELECT id, size, row_number() OVER (ORDER BY {order}) AS place, coalesce(sum(size) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WHERE NOT permanent) WHERE {keep}"


@query("e1_size_estimate", f"""WITH {CURRENT}, n AS (SELECT c.id, x.key, x.type, x.value, x.parent, x.id AS node FROM c, json_tree(CASE WHEN json_valid(metadata) THEN metadata::JSON END) x),
b AS (SELECT n.id, sum(CASE n.type WHEN 'NULL' THEN 8 WHEN 'BOOLEAN' THEN 4 WHEN 'VARCHAR' THEN 2 * length(n.value ->> '$') WHEN 'ARRAY' THEN 24 WHEN 'OBJECT' THEN 48 ELSE 8 END + CASE WHEN p.type = 'OBJECT' THEN 2 * length(n.key) ELSE 0 END) AS size FROM n LEFT JOIN n p ON p.id = n.id AND p.node = n.parent GROUP BY n.id)
SELECT c.id, (4 * coalesce(len(vector), 0) + 2 * length(c.id) + 64 + CASE WHEN metadata IS NULL THEN 0 WHEN NOT json_valid(metadata) THEN 48 ELSE b.size END)::BIGINT AS size FROM c LEFT JOIN b USING (id)""", base=False)
def e1(spark, sf_dir):
    rows = current_rows(table(spark, sf_dir, "vectors"), "vector", "metadata")
    return rows.select("id", E.record_size(F.coalesce(F.col("vector"), F.array().cast("array<float>")), F.col("metadata"), F.col("id")).cast("bigint").alias("size"))


@query("e2_permanent", f"WITH {MEASURED} SELECT id, permanent FROM m", base=False)
def e2(spark, sf_dir):
    return _measured(spark, sf_dir).select("id", "permanent")


@query("e3_lru", _running("accessed, id", "before < 200000"), base=False)
def e3(spark, sf_dir):
    return E.lru(_measured(spark, sf_dir), target=200_000)


@query("e4_lfu", _running("uses, accessed, id", "place <= 150"), base=False)
def e4(spark, sf_dir):
    return E.lfu(_measured(spark, sf_dir), most=150)


@query("e5_ttl", f"WITH {MEASURED} SELECT id, size FROM m WHERE NOT permanent AND accessed < {NOW} - 1000::BIGINT * 3600000", base=False)
def e5(spark, sf_dir):
    return E.ttl(_measured(spark, sf_dir), NOW, 1000)


WORTH = f"""round(0.3 * ln(uses + 1.0) + 0.4 * coalesce(CASE WHEN json_valid(metadata) AND json_type(metadata, '$.priority') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND (metadata ->> '$.priority')::DOUBLE <> 0 THEN (metadata ->> '$.priority')::DOUBLE END, 0.5)
 + 0.2 * exp(-({NOW} - accessed) / 86400000.0) + 0.1 * coalesce(exp(-({NOW} - t) / 604800000.0), 0.0), 9)"""


@query("e6_score", _running(f"{WORTH}, id", "before < 100000"), base=False)
def e6(spark, sf_dir):
    return E.by_score(_measured(spark, sf_dir), NOW, target=100_000)


@query("e7_hybrid", f"""WITH {MEASURED}, x AS (SELECT id, size FROM m WHERE NOT permanent AND accessed < {NOW} - 2400::BIGINT * 3600000), f AS (SELECT coalesce(sum(size), 0) AS freed FROM x),
r AS (SELECT id, size, coalesce(sum(size) OVER (ORDER BY {WORTH}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m WHERE NOT permanent AND id NOT IN (SELECT id FROM x))
SELECT id, size, 'ttl' AS phase FROM x UNION ALL SELECT id, size, 'score' FROM r, f WHERE freed < 600000 AND before < 600000 - freed""", base=False)
def e7(spark, sf_dir):
    return E.hybrid(_measured(spark, sf_dir), NOW, target=600_000, hours=2400)


A7 = f"""SELECT count(*) AS records, sum(size)::BIGINT AS bytes, count(*) FILTER (permanent) AS permanent, least({NOW}, min(accessed)) AS oldest, avg(uses) AS mean_uses, count(*) FILTER (accessed < {NOW} - 604800000) AS expired FROM m"""


@query("a7_eviction_statistics", f"WITH {MEASURED}, a AS ({A7}) SELECT records, bytes, permanent, oldest, {r6_sql('mean_uses')} AS mean_uses, expired FROM a", base=False)
def a7(spark, sf_dir):
    return E.statistics(_measured(spark, sf_dir), NOW).withColumn("mean_uses", r6(F.col("mean_uses")))


@query("e8_suggestion", f"WITH {MEASURED}, a AS ({A7}) SELECT CASE WHEN expired > records * 0.3 THEN 'ttl' WHEN mean_uses > 2 THEN 'hybrid' ELSE 'lru' END AS strategy, CASE WHEN expired > records * 0.3 THEN 168 WHEN mean_uses > 2 THEN 336 END::INT AS hours FROM a", base=False)
def e8(spark, sf_dir):
    return E.suggestion(_measured(spark, sf_dir), NOW)


# namespaces


def _registry(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "namespaces")


@query("n1_list", "SELECT namespace FROM namespaces WHERE namespace IS NOT NULL", base=False)
def n1(spark, sf_dir):
    return N.list_names(_registry(spark, sf_dir))


@query("n1_create_delete", "SELECT namespace, config.dimension AS dimension, created FROM namespaces WHERE namespace <> 'catalog-main' UNION ALL SELECT 'fresh-one', 32, 7", base=False)
def n1_create(spark, sf_dir):
    made = N.delete(N.create(_registry(spark, sf_dir), "fresh-one", 32, now_ms=7), "catalog-main")
    return made.select("namespace", "config.dimension", "created")


@query("n2_find", "SELECT namespace FROM namespaces WHERE regexp_matches(namespace, '^image[-_]|test$')", base=False)
def n2(spark, sf_dir):
    return N.find(_registry(spark, sf_dir), "^image[-_]|test$").select("namespace")


@query("n3_update_stats", """SELECT n.namespace, coalesce(s.c, n.stats.vector_count) AS vector_count, coalesce(s.b, n.stats.storage_size) AS storage_size, coalesce(s.l, n.stats.last_accessed) AS last_accessed, n.stats.index_size AS index_size, CASE WHEN s.namespace IS NOT NULL THEN 9 ELSE n.modified END AS modified
FROM namespaces n LEFT JOIN (SELECT namespace, count(*) AS c, sum(coalesce(len(vector), 0) * 4 + coalesce(strlen(metadata), 0))::BIGINT AS b, max(last_accessed) AS l FROM vectors WHERE namespace IS NOT NULL GROUP BY namespace) s USING (namespace)""", base=False)
def n3(spark, sf_dir):
    rows = table(spark, sf_dir, "vectors").withColumn("vector", F.coalesce("vector", F.array().cast("array<float>")))
    found = N.update_stats(_registry(spark, sf_dir), N.actual_stats(rows), 9)
    return found.select("namespace", "stats.*", "modified")


@query("n4_total_storage", "SELECT coalesce(sum(stats.storage_size), 0)::BIGINT AS bytes FROM namespaces", base=False)
def n4(spark, sf_dir):
    return N.total_storage(_registry(spark, sf_dir))


QUERIES["a8_total_storage"], SQL["a8_total_storage"] = QUERIES["n4_total_storage"], SQL["n4_total_storage"]


@query("a9_estimated_usage", "SELECT namespace, count(*) * (4 * 128 + 200) AS bytes FROM vectors WHERE namespace IS NOT NULL GROUP BY namespace", base=False)
def a9(spark, sf_dir):
    rows = table(spark, sf_dir, "vectors").where(F.col("namespace").isNotNull())
    return rows.groupBy("namespace").agg(N.estimated_usage(F.count(F.lit(1)), F.lit(128)).alias("bytes"))


@query("n5_cache", "SELECT namespace, row_number() OVER (ORDER BY coalesce(stats.last_accessed, 0) DESC, namespace)::INT AS place, row_number() OVER (ORDER BY coalesce(stats.last_accessed, 0) DESC, namespace) <= 5 AS stays FROM namespaces", base=False)
def n5(spark, sf_dir):
    return N.cached(_registry(spark, sf_dir), 5)


@query("n_name_problems", "SELECT namespace, CASE WHEN NOT regexp_full_match(namespace, '[a-zA-Z0-9_-]{3,64}') THEN 'characters' WHEN lower(namespace) IN ('root', 'system', 'admin', 'registry') THEN 'reserved' WHEN contains(namespace, '-ns-') THEN 'infix' END AS problem FROM namespaces", base=False)
def n_names(spark, sf_dir):
    return _registry(spark, sf_dir).select("namespace", N.name_problem(F.col("namespace")).alias("problem"))


# storage


def _store(spark, sf_dir) -> T.VectorTable:
    """A new table that holds the embeddings."""
    rows = embeddings(spark, sf_dir)
    store = T.VectorTable(spark, shared_path(spark, "table"), 64)
    store.put(rows.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata")), 100)
    return store


def _ids(spark, sf_dir, where: str) -> DataFrame:
    return embeddings(spark, sf_dir).where(where).select(F.col("vec_id").cast("string").alias("id"))


KEPT = "SELECT vec_id::VARCHAR AS id, (label)::INT AS label FROM e"


def _labels(df: DataFrame) -> DataFrame:
    return df.select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@query("c1_upsert", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END::INT AS label FROM e UNION ALL SELECT 'new', 99")
def c1(spark, sf_dir):
    store = _store(spark, sf_dir)
    old = embeddings(spark, sf_dir).where("vec_id % 5 = 0").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    new = embeddings(spark, sf_dir).where("vec_id = 0").select(F.lit("new").alias("id"), F.col("embedding").alias("vector"))
    store.put(old.unionByName(new).withColumn("metadata", F.lit('{"label": 99}')), 200)
    return _labels(store.all())


@query("c2_batch_last_wins", "SELECT (vec_id % 50)::VARCHAR AS id, arg_max(label, vec_id)::INT AS label FROM e GROUP BY 1")
def c2(spark, sf_dir):
    store = T.VectorTable(spark, shared_path(spark, "table"), 64)
    rows = embeddings(spark, sf_dir).select((F.col("vec_id") % 50).cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"), F.col("vec_id").alias("seq"))
    store.put(rows, 100, seq="seq")
    return _labels(store.all())


@query("c3_get", f"{KEPT} WHERE vec_id = 7")
def c3(spark, sf_dir):
    return _labels(_store(spark, sf_dir).where(F.col("id") == "7"))


@query("c3_access_log", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 4 = 0 THEN 300 ELSE CASE WHEN vec_id % 2 = 0 THEN 200 ELSE 100 END END::BIGINT AS last_accessed, CASE WHEN vec_id % 4 = 0 THEN 2 WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS access_count FROM e")
def c3_log(spark, sf_dir):
    store, log = _store(spark, sf_dir), shared_path(spark, "log")
    store.touch(_ids(spark, sf_dir, "vec_id % 2 = 0"), 200, log)
    store.touch(_ids(spark, sf_dir, "vec_id % 4 = 0"), 300, log)
    store.fold_accesses(log)
    return store.all().select("id", "last_accessed", "access_count")


@query("c4_get_many", f"{KEPT} WHERE vec_id % 10 = 3")
def c4(spark, sf_dir):
    ids = _ids(spark, sf_dir, "vec_id % 10 = 3").unionByName(spark.createDataFrame([("missing",)], "id string"))
    return _labels(_store(spark, sf_dir).get_many(ids))


@query("c5_exists", "SELECT '7' AS id, true AS found UNION ALL SELECT 'missing', false", base=False)
def c5(spark, sf_dir):
    store = _store(spark, sf_dir)
    return spark.createDataFrame([(i, store.exists(i)) for i in ("7", "missing")], "id string, found boolean")


@query("c6_get_all", f"SELECT vec_id::VARCHAR AS id, {r6_sql('sqrt(' + total('v[i] * v[i]') + ')')} AS magnitude, 'float32' AS format FROM e")
def c6(spark, sf_dir):
    return _store(spark, sf_dir).all().select("id", r6(F.col("magnitude")).alias("magnitude"), "format")


@query("c7_scan", "SELECT vec_id::VARCHAR AS id, ((row_number() OVER (ORDER BY vec_id::VARCHAR) - 1) // 64)::INT AS page FROM e")
def c7(spark, sf_dir):
    return T.ranked_pages(_store(spark, sf_dir).all(), 64)


@query("c8_filtered_scan", f"{KEPT} WHERE label >= 5 AND label <> 7")
def c8(spark, sf_dir):
    return _labels(_store(spark, sf_dir).where({"label": {"$gte": 5, "$ne": 7}}))


@query("c9_delete", f"{KEPT} WHERE vec_id <> 7")
def c9(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete(spark.createDataFrame([("7",), ("missing",)], "id string"))
    return _labels(store.all())


@query("c10_delete_many", "SELECT count(*) FILTER (vec_id % 3 = 0) AS removed, count(*) FILTER (vec_id % 3 <> 0) AS kept FROM e")
def c10(spark, sf_dir):
    store = _store(spark, sf_dir)
    removed = store.delete(_ids(spark, sf_dir, "vec_id % 3 = 0"))
    store.compact()
    return store.all().agg(F.lit(removed).cast("bigint").alias("removed"), F.count(F.lit(1)).alias("kept"))


@query("c11_clear", "SELECT 0::BIGINT AS kept", base=False)
def c11(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.clear()
    return store.all().agg(F.count(F.lit(1)).alias("kept"))


@query("c12_update_vector", f"SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id = 7 THEN 16.0 ELSE round(sqrt({total('v[i] * v[i]')}), 4) END::DOUBLE AS magnitude, CASE WHEN vec_id = 7 THEN 500 ELSE 100 END::BIGINT AS \"timestamp\" FROM e")
def c12(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update_vector("7", [2.0] * 64, 500)
    return store.all().select("id", F.round("magnitude", 4).alias("magnitude"), "timestamp")


@query("c13_update_metadata", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id = 9 THEN NULL ELSE label END::INT AS label, CASE WHEN vec_id IN (8, 9) THEN 'x' END AS note FROM e")
def c13(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.update_metadata("8", {"note": "x"})
    store.update_metadata("9", {"note": "x"}, merge=False)
    return store.all().select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), F.get_json_object("metadata", "$.note").alias("note"))


@query("c14_update_batch", "SELECT count(*) FILTER (vec_id % 5 = 0) AS succeeded, 1::BIGINT AS failed, count(*) FILTER (vec_id % 5 = 0) AS marked FROM e")
def c14(spark, sf_dir):
    store = _store(spark, sf_dir)
    ids = _ids(spark, sf_dir, "vec_id % 5 = 0").unionByName(spark.createDataFrame([("missing",)], "id string"))
    told = store.update_batch(ids.withColumn("metadata", F.lit('{"mark": true}')), 600)
    return store.where({"mark": True}).agg(F.lit(told["succeeded"]).cast("bigint").alias("succeeded"), F.lit(told["failed"]).cast("bigint").alias("failed"), F.count(F.lit(1)).alias("marked"))


@query("c16_batches", "SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 128)::INT AS batch_no FROM e")
def c16(spark, sf_dir):
    """Batches of as many rows as 64 KiB hold."""
    return T.batch_numbers(embeddings(spark, sf_dir).select("vec_id"), "vec_id", T.rows_in_budget(64, 64 * 2**10))


CODED = f"SELECT vec_id::VARCHAR AS id, label::INT AS label, {r6_sql(total('v[i]'))} AS total FROM e"


def _through(form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_path(spark, "export")
        C.write_files(_store(spark, sf_dir).all(), path, form)
        back = C.read_files(spark, path, form)
        total_ = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
        return back.select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"), r6(total_).alias("total"))

    return run


for number, form_ in (("c17_parquet", "parquet"), ("c27_json_codec", "json"), ("c28_binary_codec", "vecf")):
    QUERIES[number], SQL[number] = _through(form_), f"WITH {BASE} {CODED}"


@query("c26_capabilities", "SELECT * FROM (VALUES ('parquet', 'core'), ('memory', 'core')) t(kind, tier)", base=False)
def c26(spark, sf_dir):
    return M.capabilities(spark).where("tier = 'core'").select("kind", "tier")


@query("r1_quota_levels", """SELECT day, CASE WHEN r >= 0.95 THEN 'emergency' WHEN r >= 0.9 THEN 'critical' WHEN r >= 0.85 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN r > 0.9 THEN 10 WHEN r > 0.8 THEN 50 WHEN r > 0.7 THEN 100 WHEN r > 0.5 THEN 500 ELSE 1000 END::INT AS interval
FROM (SELECT day, sum(n) OVER (ORDER BY day) / sum(n) OVER () AS r FROM (SELECT epoch_ms(date_trunc('day', ts)) AS day, count(*) AS n FROM events GROUP BY 1))""", base=False)
def r1(spark, sf_dir):
    """Levels of a store that fills with the events, day by day, up to its quota."""
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    days = table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ratio = F.sum("n").over(Window.orderBy("day")) / F.sum("n").over(Window.partitionBy())  # a row for each day
    return days.withColumn("r", ratio).select("day", M.quota_level(F.col("r")).alias("level"), M.check_interval(F.col("r")).alias("interval"))


@query("x1_execution_path", "SELECT vec_id, CASE WHEN vec_id >= 1000 THEN 'workers' WHEN vec_id >= 200 THEN 'plain' WHEN vec_id >= 100 THEN 'simd' ELSE 'sequential' END AS path FROM e")
def x1(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", M.execution_path(F.col("vec_id")).alias("path"))


@query("x3_targets", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN vec_id >= 100 * (1 - 0.3) ELSE vec_id <= 100 * (1 + 0.3) END AS met FROM e")
def x3(spark, sf_dir):
    met = M.meets_target(F.col("vec_id"), F.lit(100.0), F.lit(0.3), F.col("vec_id") % 2 == 0)
    return embeddings(spark, sf_dir).select("vec_id", met.alias("met"))


# validation, compression, streams


@query("w1_validation", """SELECT id, file_no, epoch_us(ingested_at) AS arrived, code, message FROM (
SELECT id, file_no, ingested_at, 'id' AS code, CASE WHEN id IS NULL THEN 'missing' WHEN length(id) = 0 THEN 'empty' WHEN length(id) > 255 THEN 'too long' WHEN regexp_matches(id, '[<>:"/\\\\|?*\\x00-\\x1f]') THEN 'characters' END AS message FROM vectors
UNION ALL SELECT id, file_no, ingested_at, 'vector', CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) = 0 THEN 'empty' WHEN len(vector) <> 128 THEN 'dimension' WHEN len(list_filter(vector, lambda x: NOT coalesce(isfinite(x), false))) > 0 THEN 'not finite' END FROM vectors) WHERE message IS NOT NULL""", base=False)
def w1(spark, sf_dir):
    """Rows that break the rules of ids and vectors; those of metadata are tested against brute force."""
    from vectrine.functions.vectors import problem
    from vectrine.operators.validate import id_problem

    found = F.array(F.struct(F.lit("id").alias("code"), id_problem(F.col("id")).alias("message")), F.struct(F.lit("vector").alias("code"), problem(F.col("vector"), 128).alias("message")))
    rows = table(spark, sf_dir, "vectors").select("id", "file_no", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("arrived"), F.explode(found).alias("x"))
    return rows.select("id", "file_no", "arrived", "x.code", "x.message").where(F.col("message").isNotNull())


@query("w1_validation_report")
def w1_report(spark, sf_dir):
    from vectrine.operators.validate import report

    return report(table(spark, sf_dir, "vectors"), 128)


@query("k16_compress", f"SELECT vec_id, {r6_sql('list_min(v)')} AS low, {r6_sql('list_max(v)')} AS high, 8::INT AS bits, 'scalar' AS strategy FROM e")
def k16(spark, sf_dir):
    """Product quantization is asked for without a codebook, so scalar codes come out."""
    from vectrine.operators.compress import compress

    strategy, codes = compress(embeddings(spark, sf_dir), "product", vector="embedding", key="vec_id")
    return codes.select("vec_id", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "bits", F.lit(strategy).alias("strategy"))


@query("st1_stream_upsert", "SELECT vec_id::VARCHAR AS id, label::INT AS label FROM e")
def st1(spark, sf_dir):
    """A stream of records put into a table, read after its end."""
    from vectrine.streaming.ingest import upsert_stream

    source = shared_path(spark, "source")
    rows = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.to_json(F.struct("label")).alias("metadata"))
    rows.write.parquet(source)
    store = T.VectorTable(spark, shared_path(spark, "table"), 64)
    upsert_stream(spark.readStream.schema(rows.schema).parquet(source), store, shared_path(spark, "stream"), 100).awaitTermination()
    return _labels(store.all())

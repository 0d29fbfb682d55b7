"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.session import table

#: Instant at which queries on use and age are asked, epoch milliseconds.
NOW = 1_751_000_000_000


def r6(c: Column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).first().embedding


def scaled(df: DataFrame) -> DataFrame:
    """Embeddings stretched by a factor of 1 to 7, so that they aren't all of length 1."""
    return df.withColumn("embedding", F.transform("embedding", lambda x: (x.cast("double") * (F.col("vec_id") % 7 + 1))))


#: SQL of the tables e (vec_id, v, label), q (the query) and s (stretched vectors).
BASE = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 7 + 1)) AS v, label FROM embeddings)"""


def total(expr: str, a: str = "v") -> str:
    """SQL sum of an expression in ``i`` over the positions of ``a``."""
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {expr}))"


#: SQL of each metric between v and q.
METRIC = {
    "cosine": f"(1 - {total('v[i] * q[i]')} / (sqrt({total('v[i] * v[i]')}) * sqrt({total('q[i] * q[i]')})))",
    "euclidean": f"sqrt({total('(v[i] - q[i]) * (v[i] - q[i])')})",
    "manhattan": total("abs(v[i] - q[i])"),
    "hamming": total("((v[i] > 0) <> (q[i] > 0))::INT::DOUBLE"),
    "jaccard": f"(1 - {total('(v[i] > 0 AND q[i] > 0)::INT::DOUBLE')} / {total('(v[i] > 0 OR q[i] > 0)::INT::DOUBLE')})",
    "dot": f"(-{total('v[i] * q[i]')})",
    "hamming_exact_frac": f"({total('(v[i] <> q[i])::INT::DOUBLE')} / len(v))",
    "weighted_jaccard": f"(1 - {total('least(v[i], q[i])')} / {total('greatest(v[i], q[i])')})",
}


def r6_sql(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"

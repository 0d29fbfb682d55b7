"""Compression of whole collections by a chosen strategy, with a check of the quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.errors import InvalidInput
from vectrine.operators import pq
from vectrine.operators import quantize as Z

#: Fewest dimensions that are worth compressing.
LEAST_DIMENSIONS = 64


def scalar(df: DataFrame, bits: int = 8, vector: str = "vector", key: str = "id", loss: float | None = None) -> DataFrame:
    """``(key, codes, low, high, bits, quality)`` with each vector's own bounds.

    With ``loss``, rows whose quality is below ``1 - loss`` are an error.
    """
    v = F.col(vector)
    made = df.select(key, vector, F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"), F.lit(bits).alias("bits"))
    made = made.withColumn("codes", Z.quantize(v, F.col("low"), F.col("high"), bits))
    back = Z.dequantize(F.col("codes"), F.col("low"), F.col("high"), bits)
    made = made.withColumn("_sums", Z.quality_sums(v, back)).withColumn("quality", Z.quality_of(F.col("_sums"))["score"])
    if loss is not None:
        fine = F.assert_true(F.col("quality") >= 1 - loss, F.lit("compression loses too much"))
        made = made.withColumn("quality", F.when(fine.isNull(), F.col("quality")))
    return made.select(key, "codes", "low", "high", "bits", "quality")


def restored(codes: DataFrame, key: str = "id") -> DataFrame:
    """``(key, vector)`` of scalar codes."""
    return codes.select(key, F.transform(Z.dequantize(F.col("codes"), F.col("low"), F.col("high"), F.col("bits")), lambda x: x.cast("float")).alias("vector"))


def compress(df: DataFrame, strategy: str = "scalar", book: pq.Codebook | None = None, vector: str = "vector", key: str = "id") -> tuple[str, DataFrame]:
    """The strategy that was used and its codes.

    Product quantization without a trained codebook falls back to scalar.
    Vectors of fewer than 64 dimensions are an error, as compression would cost more than it saves.
    """
    least = df.select(F.min(F.size(vector))).first()[0]
    if least is not None and least < LEAST_DIMENSIONS:
        raise InvalidInput(f"vectors of fewer than {LEAST_DIMENSIONS} dimensions aren't compressed", dimension=least)
    if strategy == "product" and book is not None:
        return "product", pq.encode(df, book, vector, key)
    if strategy not in ("scalar", "product"):
        raise InvalidInput("unknown strategy", strategy=strategy)
    return "scalar", scalar(df, vector=vector, key=key)

"""Limits of arguments, and a report of rows that break the rules of a collection.

Arguments are checked before a plan is built. Rows are never an error: a batch
gets a report ``(id, code, message)`` of them instead.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vectrine.errors import InvalidInput
from vectrine.functions.vectors import problem

# Limits of records, searches and names.
LONGEST_ID, ID_CHARACTERS = 255, r'[<>:"/\\|?*\x00-\x1f]'
MOST_DIMENSIONS, MOST_K, MOST_RESULTS, MOST_IDS = 100_000, 10_000, 50_000, 10_000
MOST_PROPERTIES, DEEPEST, LONGEST_STRING, LONGEST_ARRAY, LONGEST_KEY = 1000, 10, 10_000, 10_000, 100
DATABASE_NAME = r"[a-zA-Z][a-zA-Z0-9_-]{0,63}"


def whole(value: object, least: int, most: int, name: str) -> int:
    """The value, if it is a whole number within the limits."""
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise InvalidInput(f"{name} must be a whole number from {least} to {most}", value=value)
    return value


def options(given: dict, known: set[str]) -> dict:
    """The options, if all of them are known."""
    if strange := sorted(set(given) - known):
        raise InvalidInput(f"unknown options: {', '.join(strange)}")
    return given


def greatest_distance(metric: str, dimension: int) -> float:
    """Largest distance that a range search accepts."""
    return {"cosine": 4.0, "jaccard": 2.0, "hamming": float(dimension), "euclidean": 100 * dimension**0.5, "manhattan": 100.0 * dimension, "dot": 100.0 * dimension}.get(metric, 1000.0)


def check_range(distance: float, metric: str, dimension: int) -> float:
    """The distance of a range search, if it is within the limits."""
    top = greatest_distance(metric, dimension)
    low = -top if metric == "dot" else 0.0
    if not isinstance(distance, (int, float)) or isinstance(distance, bool) or not low <= distance <= top:
        raise InvalidInput(f"the distance must be from {low} to {top}", distance=distance)
    return float(distance)


def database_name(name: str) -> str:
    if not isinstance(name, str) or not re.fullmatch(DATABASE_NAME, name):
        raise InvalidInput("not allowed as the name of a database", name=name)
    return name


def ids_of_batch(ids: list[str], most: int = MOST_IDS) -> list[str]:
    """The ids, if there are some, not too many, and none twice."""
    if not 1 <= len(ids) <= most or len(set(ids)) != len(ids):
        raise InvalidInput(f"1 to {most} different ids are needed", count=len(ids))
    return ids


def sanitized(text: str) -> str:
    """The text without control characters, spaces cut off at both ends."""
    return re.sub(r"[\x00-\x1f\x7f]", "", text).strip()


def id_problem(key: Column) -> Column:
    """Why an id isn't allowed, or null."""
    return F.when(key.isNull(), "missing").when(F.length(key) == 0, "empty").when(F.length(key) > LONGEST_ID, "too long").when(key.rlike(ID_CHARACTERS), "characters")


def _metadata(value: object, depth: int = 1) -> str | None:
    if depth > DEEPEST:
        return "too deep"
    if isinstance(value, str):
        return "long string" if len(value) > LONGEST_STRING else None
    if isinstance(value, list):
        return "long array" if len(value) > LONGEST_ARRAY else next((p for x in value if (p := _metadata(x, depth + 1))), None)
    if isinstance(value, dict):
        for k, v in value.items():
            if len(k) > LONGEST_KEY or k.startswith("__") or ".." in k or "/" in k:
                return "key"
            if p := _metadata(v, depth + 1):
                return p
    return None


@F.pandas_udf(StringType())
def metadata_problem(texts: pd.Series) -> pd.Series:
    """Why metadata isn't allowed, or null; missing metadata is."""

    def why(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            found = json.loads(t)
        except (ValueError, RecursionError):
            return "no JSON"
        if not isinstance(found, dict):
            return "no object"
        return "many properties" if len(found) > MOST_PROPERTIES else _metadata(found)

    return texts.map(why)


def report(df: DataFrame, dimension: int) -> DataFrame:
    """``(id, code, message)`` for each rule that a row (id, vector, metadata) breaks."""
    found = F.array(
        F.struct(F.lit("id").alias("code"), id_problem(F.col("id")).alias("message")),
        F.struct(F.lit("vector").alias("code"), problem(F.col("vector"), dimension).alias("message")),
        F.struct(F.lit("metadata").alias("code"), metadata_problem(F.col("metadata")).alias("message")),
    )
    return df.select("id", F.explode(found).alias("x")).select("id", "x.code", "x.message").where(F.col("message").isNotNull())

"""Codecs of records and codes: JSON, the VECF binary form, bit packing."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the binary form, little-endian: magic number, version and three bytes
# of zeros, dimension, bytes of the tail, CRC-32 of the whole with this field as 0;
# then the elements as float32, and as the tail the other fields as UTF-8 JSON.
MAGIC, VERSION = 0x56454346, 1
HEADER = "<IB3xIII"
CHECKSUM_AT, LARGEST_DIMENSION = 16, 100_000
#: JSON names of a record's fields.
NAMES = {
    "id": "id", "metadata": "metadata", "magnitude": "magnitude", "format": "format", "normalized": "normalized",
    "timestamp": "timestamp", "last_accessed": "lastAccessed", "access_count": "accessCount",
}
RECORD = "id string, vector array<float>, metadata string, magnitude double, format string, normalized boolean, timestamp bigint, last_accessed bigint, access_count bigint"


class Corrupt(ValueError):
    """Bytes that are no whole record."""


def encode(record: dict) -> bytes:
    """One record in binary form."""
    vector = np.asarray(record["vector"], "<f4")
    rest = {NAMES[k]: v for k, v in record.items() if k in NAMES and v is not None}
    if isinstance(rest.get("metadata"), str):
        rest["metadata"] = json.loads(rest["metadata"])
    tail = json.dumps(rest, separators=(",", ":")).encode()
    body = vector.tobytes() + tail
    crc = zlib.crc32(struct.pack(HEADER, MAGIC, VERSION, len(vector), len(tail), 0) + body)
    return struct.pack(HEADER, MAGIC, VERSION, len(vector), len(tail), crc) + body


def decode(data: bytes) -> dict:
    """The record in ``data``; :class:`Corrupt` if a length, the checksum or the form is wrong."""
    if len(data) < struct.calcsize(HEADER):
        raise Corrupt("too short")
    magic, version, n, tail, crc = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise Corrupt("another format")
    body = data[struct.calcsize(HEADER) :]
    if n > LARGEST_DIMENSION or len(body) != 4 * n + tail:
        raise Corrupt("wrong length")
    if zlib.crc32(data[:CHECKSUM_AT] + bytes(4) + body) != crc:
        raise Corrupt("wrong checksum")
    try:
        rest = json.loads(body[4 * n :])
    except ValueError as e:
        raise Corrupt("no JSON") from e
    return {"vector": np.frombuffer(body, "<f4", n).tolist(), **_named(rest)}


def _named(found: dict) -> dict:
    out = {k: found.get(j) for k, j in NAMES.items()}
    if out["metadata"] is not None:
        out["metadata"] = json.dumps(out["metadata"])
    return out


def _frame(records: list[dict]) -> pd.DataFrame:
    columns = [c.split()[0] for c in RECORD.split(", ")]
    return pd.DataFrame([[r.get(c) for c in columns] for r in records], columns=columns).astype(object).where(lambda x: x.notna(), None)


def to_binary(df: DataFrame) -> DataFrame:
    """``(id, data)`` of records."""
    columns = [c for c in df.columns if c in NAMES or c == "vector"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "data": [encode({k: _plain(v) for k, v in zip(columns, r)}) for r in b[columns].itertuples(index=False, name=None)]})

    return df.select(*columns).mapInPandas(run, "id string, data binary")


def _plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    return None if isinstance(v, float) and v != v else v


def from_binary(df: DataFrame, data: str = "data", skip_corrupt: bool = False) -> DataFrame:
    """Records in a binary column; corrupt ones fail the task, or are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["d"]:
                try:
                    out.append(decode(bytes(x)))
                except Corrupt:
                    if not skip_corrupt:
                        raise
            if out:
                yield _frame(out)

    return df.where(F.col(data).isNotNull()).select(F.col(data).alias("d")).mapInPandas(run, RECORD)


def to_json(df: DataFrame) -> DataFrame:
    """``(id, value)``: records as JSON texts."""
    known = [c for c in NAMES if c in df.columns and c not in ("metadata",)]
    fields = [F.col(c).alias(NAMES[c]) for c in known] + [F.col("vector")]
    if "metadata" in df.columns:
        fields.append(F.try_parse_json("metadata").alias("metadata"))
    return df.select("id", F.to_json(F.struct(*fields)).alias("value"))


def from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Records in JSON texts; a text that isn't a record is left out."""
    schema = "id string, vector array<float>, magnitude double, format string, normalized boolean, timestamp bigint, lastAccessed bigint, accessCount bigint, metadata string"
    r = F.from_json(F.col(value), schema)
    found = df.select(r.alias("r"), F.get_json_object(value, "$.metadata").alias("m")).where(F.col("r.id").isNotNull())
    return found.select("r.id", "r.vector", F.col("m").alias("metadata"), "r.magnitude", "r.format", "r.normalized", "r.timestamp", F.col("r.lastAccessed").alias("last_accessed"), F.col("r.accessCount").alias("access_count"))


def write_files(df: DataFrame, path: str, form: str) -> None:
    """Export: 'parquet', 'json' (lines) or 'vecf' (Parquet of binary records)."""
    if form == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif form == "json":
        to_json(df).select("value").write.mode("overwrite").text(path)
    elif form == "vecf":
        to_binary(df).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def read_files(spark: SparkSession, path: str, form: str, skip_corrupt: bool = False) -> DataFrame:
    """Import of what :func:`write_files` wrote; 'vec' reads single binary files, one record in each."""
    if form == "parquet":
        return spark.read.parquet(path)
    if form == "json":
        return from_json(spark.read.text(path))
    if form == "vecf":
        return from_binary(spark.read.parquet(path), skip_corrupt=skip_corrupt)
    if form == "vec":
        return from_binary(spark.read.format("binaryFile").load(path), "content", skip_corrupt)
    raise ValueError(f"unknown form {form!r}")


def write_jdbc(df: DataFrame, url: str, table: str, parts: int = 16, options: dict | None = None) -> None:
    """Export to a relational table ``(part, id, value)`` of JSON texts, replacing it; ``part`` is what :func:`read_jdbc` reads it by."""
    rows = to_json(df).select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "value")
    rows.write.jdbc(url, table, "overwrite", options or {})


def read_jdbc(spark: SparkSession, url: str, table: str, parts: int = 16, options: dict | None = None) -> DataFrame:
    """Records of a table that :func:`write_jdbc` made, read by ``parts`` tasks; needs the database's driver on the class path."""
    return from_json(spark.read.jdbc(url, table, column="part", lowerBound=0, upperBound=parts, numPartitions=parts, properties=options or {}))


def keep_in_memory(df: DataFrame, name: str) -> None:
    """Records of this session under a name, cached over the executors; lost blocks are made again."""
    df.cache().createOrReplaceTempView(name)


def open_source(spark: SparkSession, address: str) -> DataFrame:
    """Reads ``form:path``, such as ``json:/data/export`` or ``memory:name``; an unknown form is an error, there is no silent fallback."""
    form, _, path = address.partition(":")
    if not path:
        raise ValueError(f"no form and path: {address!r}")
    return spark.table(path) if form == "memory" else read_files(spark, path, form)


# bit packing


def pack(codes: list[int], bits: int) -> bytes:
    """Codes in ``bits`` bits each, the highest bit first."""
    x = np.asarray(codes, np.int64)
    if not 1 <= bits <= 16 or (len(x) and (x.min() < 0 or x.max() >= 1 << bits)):
        raise ValueError("a code doesn't fit")
    return np.packbits((x[:, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> list[int]:
    """The first ``n`` codes."""
    x = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return (x @ (1 << np.arange(bits - 1, -1, -1))).tolist()


def packed(codes: str, bits: int):
    """Column of packed codes."""

    @F.pandas_udf("binary")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: pack(x, bits))

    return run(F.col(codes))


def unpacked(data: str, size: str, bits: int):
    """Column of codes from packed ones and their number."""

    @F.pandas_udf("array<int>")
    def run(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([unpack(bytes(x), bits, int(m)) for x, m in zip(d, n)])

    return run(F.col(data), F.col(size))

"""Record deltas of a log of synchronisation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.operators.records import change_time
from vectrine.session import shared_path
from vectrine.sources.versioned import VersionedTable, changed_keys, process_new

#: A log of more runs than this is refused: their manifests are made on the driver.
MOST_RUNS = 100_000


def run_deltas(vectors: DataFrame, runs: DataFrame) -> DataFrame:
    """``(run_id, id)``: the ids that are new or changed for each successful run.

    Every successful run, in the order of ``started_at`` (equal ones: of
    ``run_id``), is a version of the table of arrivals: the rows that had come
    by its start. What the manifests say to have changed in each version is handled
    by :func:`process_new`; the greatest change times that earlier calls have
    handled lie in its output. Failed runs make no version, so what they saw
    goes to the next success. Rows with a null id or a null ``ingested_at`` are
    seen by no run; runs without ``started_at`` see nothing and are left out,
    repeated rows of a run count once. Without any successful run the result is
    empty.
    """
    spark = vectors.sparkSession
    log = runs.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull()).select("run_id", "started_at").distinct()
    log = log.orderBy("started_at", "run_id").limit(MOST_RUNS + 1).collect()
    if len(log) > MOST_RUNS:
        raise ValueError(f"more than {MOST_RUNS} runs")
    empty = spark.createDataFrame([], "run_id bigint, id string")
    if not log:
        return empty
    source, sink = VersionedTable(spark, shared_path(spark, "arrivals")), VersionedTable(spark, shared_path(spark, "handled"))
    arrived = vectors.where(F.col("id").isNotNull()).select("id", change_time().alias("changed"), "ingested_at")
    source.commit_each(seen_by(arrived, "ingested_at", [r.started_at for r in log], dict(runs.dtypes)["started_at"]), "_version", len(log), lambda v: {"run_id": log[v - 1].run_id})
    handle_runs(source, sink)
    return sink.read().select("run_id", "id")


def handle_runs(source: VersionedTable, sink: VersionedTable) -> int | None:
    """Adds ``(run_id, id, top)`` of the versions of ``source`` that ``sink`` hasn't handled; see :func:`run_deltas`.

    ``source`` holds ``(id, changed)``; the run of a version is named in its
    manifest. ``top`` is the greatest change time of the id. Rows that a
    version takes away change nothing.
    """
    spark = source.spark

    def handle(delta: DataFrame) -> DataFrame:
        added = delta.where("_change = 'added'").select("id", "_version", "changed")
        if sink.versions():  # what earlier runs handled
            added = added.unionByName(sink.read().select("id", F.lit(0).alias("_version"), F.col("top").alias("changed")))
        names = spark.createDataFrame([(v, source.step(v)["about"]["run_id"]) for v in source.versions()], "_version int, run_id bigint")
        return changed_keys(added, "id", "_version", "changed").join(F.broadcast(names), "_version").select("run_id", "id", "top")

    return process_new(source, sink, handle, "runs", each=True)


def seen_by(rows: DataFrame, at: str, starts: list, kind: str) -> DataFrame:
    """Adds ``_version``: the number, from 1, of the first of the sorted ``starts`` that isn't before ``at``; rows after all of them are left out.

    The spans between starts are cut by days, and a row is compared with those
    of its own day only.
    """
    spark = rows.sparkSession
    spans, last = [], None
    for n, start in enumerate(starts, 1):
        if start != last:  # a run that starts with another one sees nothing more
            spans.append((n, last, start))
        last = start
    first, rest = spans[0], spark.createDataFrame(spans[1:], f"_version int, after {kind}, until {kind}")
    days = rest.withColumn("_day", F.explode(F.sequence(F.to_date("after"), F.to_date("until"))))
    until = spark.createDataFrame([(first[2],)], f"until {kind}")
    early = rows.join(F.broadcast(until), F.col(at) <= F.col("until")).withColumn("_version", F.lit(first[0])).drop("until")
    late = rows.withColumn("_day", F.to_date(at)).join(F.broadcast(days), "_day").where((F.col(at) > F.col("after")) & (F.col(at) <= F.col("until"))).drop("_day", "after", "until")
    return early.unionByName(late).drop(at)

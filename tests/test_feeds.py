"""Versioned tables, run deltas, schema drift, current records."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vectrine.operators.records import current_rows, is_usable, usable_records
from vectrine.operators import schema_drift as drift
from vectrine.operators.schema_drift import SEP, assign, canonical, column_names, drift_report, edit_script, one_table, parse_object, told
from vectrine.session import shared_path
from vectrine.sources import versioned
from vectrine.sources.sync import handle_runs, run_deltas, seen_by
from vectrine.sources.versioned import FILE, POSITION, CommitConflict, VersionedTable, changed_keys, process_new

VECTORS = "id string, vector array<float>, metadata string, timestamp bigint, last_accessed bigint, access_count bigint, file_no bigint, ingested_at timestamp, extra int"
T0 = dt.datetime(2025, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_diff_and_deletion_vectors(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    assert t.versions() == []
    t.commit(add=spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    t.commit(add=spark.createDataFrame([(3, "c")], "k int, v string"), delete=t.read(positions=True).where("k = 1").select(FILE, POSITION))
    assert rows_of(t.read()) == [(2, "b"), (3, "c")]
    assert rows_of(t.read(1)) == [(1, "a"), (2, "b")]
    assert rows_of(t.diff(1, 2)) == [(1, "a", "removed"), (3, "c", "added")]
    assert rows_of(t.diff(0, 2)) == [(2, "b", "added"), (3, "c", "added")]
    t.compact()
    assert rows_of(t.read()) == [(2, "b"), (3, "c")]
    assert rows_of(t.diff(2, 3)) == []
    t.commit(add=spark.createDataFrame([(4, "d")], "k int, v string"))
    assert rows_of(t.diff(2, 4)) == [(4, "d", "added")]
    assert t.diff(3, 3).isEmpty()


def test_a_version_is_committed_once(spark):
    t = VersionedTable(spark, shared_path(spark, "t"))
    t.commit(add=spark.range(1))
    with pytest.raises(CommitConflict):
        t._publish({"version": 1, "files": [], "deleted": {}, "schema": None, "about": {}})


def test_manifests_between_full_lists(spark, monkeypatch):
    monkeypatch.setattr(versioned, "SNAPSHOT", 3)
    t = VersionedTable(spark, shared_path(spark, "t"))
    for i in range(5):
        t.commit(add=spark.createDataFrame([(i,)], "k int").coalesce(1), delete=t.read(positions=True).where(f"k = {i} - 2").select(FILE, POSITION) if i > 1 else None)
    assert rows_of(VersionedTable(spark, t.path).read()) == [(3,), (4,)]
    assert [rows_of(t.read(v)) for v in (1, 3, 4)] == [[(0,)], [(1,), (2,)], [(2,), (3,)]]
    assert [len(t.manifest(v)["files"]) for v in range(6)] == list(range(6))
    told = rows_of(t.changes(0, 5))
    assert told == sorted([(i, i + 1, "added") for i in range(5)] + [(i, i + 3, "removed") for i in range(3)])
    assert rows_of(t.changes(3, 5)) == [(1, 4, "removed"), (2, 5, "removed"), (3, 4, "added"), (4, 5, "added")]
    t.commit(remove_files=tuple(t.latest()["files"]))
    t.compact()
    assert rows_of(t.changes(5, 7)) == [(3, 6, "removed"), (4, 6, "removed")]
    assert t.read().isEmpty()


def test_two_workers_of_a_consumer_handle_a_record_once(spark):
    source, sink = VersionedTable(spark, shared_path(spark, "s")), VersionedTable(spark, shared_path(spark, "k"))
    source.commit(add=spark.range(5))
    plain = lambda d: d.select("id")
    other = []

    def slow(d):
        if not other:  # the second worker commits while the first is at work
            other.append(process_new(source, VersionedTable(spark, sink.path), plain))
        return d.select("id")

    assert process_new(source, sink, slow) is None and other == [1]
    assert rows_of(sink.read()) == [(i,) for i in range(5)] and sink.versions() == [1]
    base = sink.latest()
    sink.commit(add=spark.range(1))
    with pytest.raises(CommitConflict):
        sink.commit(add=spark.range(1), base=base)
    assert len(sink._files("data")) == len(sink.latest()["files"])  # what the lost commit wrote is gone


def test_each_record_is_processed_once_in_spite_of_failures(spark):
    source, sink = VersionedTable(spark, shared_path(spark, "s")), VersionedTable(spark, shared_path(spark, "k"))
    source.commit(add=spark.range(3))
    double = lambda d: d.where("_change = 'added'").select((F.col("id") * 2).alias("id"))

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        process_new(source, sink, broken)
    assert process_new(source, sink, double) == 1
    assert process_new(source, sink, double) is None
    source.commit(add=spark.range(3, 5))
    with pytest.raises(RuntimeError):
        process_new(source, sink, broken)
    source.commit(add=spark.range(5, 6))
    process_new(source, sink, double)
    assert rows_of(sink.read()) == [(2 * i,) for i in range(6)]


def test_changed_keys(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "b", None), (2, "a", 5), (2, "b", 1), (3, "a", 6), (3, None, 9), (3, "b", 1)], "v int, k string, o bigint")
    assert rows_of(changed_keys(d, "k", "v", "o")) == [(1, "a", 5), (1, "b", -(2**63)), (2, "b", 1), (3, "a", 6)]


def vector_rows(spark, rows):
    full = [(i, None, None, ts, la, 0, 1, None if h is None else at(h), 1) for i, ts, la, h in rows]
    return spark.createDataFrame(full, VECTORS)


def test_run_deltas(spark):
    v = vector_rows(spark, [("a", 10, 5, 1), ("a", 10, 5, 3), ("b", 0, 7, 1), ("b", None, 9, 5), (None, 1, 1, 1), ("c", None, None, 1), ("d", 1, 1, None), ("e", 4, 1, 9), ("a", 11, 1, 5)])
    runs = spark.createDataFrame(
        [(7, at(2), "succeeded", "x"), (7, at(2), "succeeded", "x"), (5, at(4), "failed", "y"), (3, at(6), "succeeded", "x"), (9, at(6), "succeeded", "x"), (1, None, "succeeded", "x"), (2, at(10), "succeeded", "x")],
        "run_id bigint, started_at timestamp, status string, extra string",
    )
    assert rows_of(run_deltas(v, runs)) == [(2, "e"), (3, "a"), (3, "b"), (7, "a"), (7, "b"), (7, "c")]
    assert run_deltas(v, runs.limit(0)).isEmpty()
    assert run_deltas(v.limit(0), runs).isEmpty()


def test_runs_are_handled_as_they_come(spark):
    source, sink = VersionedTable(spark, shared_path(spark, "s")), VersionedTable(spark, shared_path(spark, "k"))
    arrive = lambda run, rows: source.commit(add=spark.createDataFrame(rows, "id string, changed bigint"), about={"run_id": run})
    arrive(7, [("a", 1), ("b", None), ("b", 2), (None, 1)])
    assert handle_runs(source, sink) == 1 and handle_runs(source, sink) is None
    arrive(3, [("a", 1), ("b", 3)])
    arrive(9, [("a", 2), ("b", 3), ("c", None)])
    source.commit(delete=source.read(positions=True).where("id = 'a'").select(FILE, POSITION), about={"run_id": 11})
    handle_runs(source, sink)
    assert rows_of(sink.read().select("run_id", "id")) == [(3, "b"), (7, "a"), (7, "b"), (9, "a"), (9, "c")]


def test_the_run_that_sees_a_row(spark):
    hours = [2, 2, 30, 31, 100]
    rows = spark.createDataFrame([(i, None if h is None else at(h)) for i, h in enumerate([-9000, 2, 2.5, 30, 30.5, 75, 100, 101, None])], "i int, t timestamp")
    found = dict(rows_of(seen_by(rows, "t", [at(h) for h in hours], "timestamp")))
    assert found == {0: 1, 1: 1, 2: 3, 3: 3, 4: 4, 5: 5, 6: 5}


def test_current_rows(spark):
    v = vector_rows(spark, [("a", 1, 9, 1), ("a", 2, 0, 0), ("a", 2, 5, 2), ("b", None, None, None), (None, 5, 5, 5), ("c", 0, 3, 1), ("c", 2, 9, 1)])
    assert rows_of(current_rows(v, "timestamp", "last_accessed")) == [("a", 2, 5), ("b", None, None), ("c", 0, 3)]
    assert current_rows(v.limit(0), "vector").isEmpty()


def test_usable(spark):
    nan, inf = float("nan"), float("inf")
    cases = [([1.0, 0.0], True), ([0.0, 0.0], False), ([nan, 1.0], False), ([inf, 1.0], False), ([-inf, 1.0], False), ([1.0], False), ([], False), (None, False), ([None, 1.0], False)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "n int, vector array<float>")
    assert [r[1] for r in sorted(df.select("n", is_usable("vector", 2)).collect())] == [ok for _, ok in cases]


def test_an_older_version_never_stands_in(spark):
    rows = [("a", [1.0, 1.0], None, 1, 1, 0, 1, at(1), 1), ("a", None, None, 2, 1, 0, 1, at(2), 1)]
    assert usable_records(spark.createDataFrame(rows, VECTORS), dimension=2).isEmpty()


def test_json_objects():
    assert parse_object('{"a": 1, "a": 2}') == {"a": 2}
    for bad in (None, "", "{", "[1]", "5", '{"a": NaN}', '{"a": Infinity}', "[" * 100_000):
        assert parse_object(bad) is None
    assert canonical({"b": 1.0, "a": [2.0]}) == canonical({"a": [2], "b": 1})
    assert canonical(True) != canonical(1) and canonical("1") != canonical(1)


def test_assignment_is_of_least_cost():
    assert assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]
    assert assign([]) == []


def test_edit_script():
    script = edit_script({"metadata.a": "string", "b": "number", "c": "string", "k": "array"}, {"metadata.a": "number", "metadata.b": "number", "d": "string", "k": "array"}, {("metadata.b", "b")})
    assert {x[:3] for x in script} == {("retype", "metadata.a", "metadata.a"), ("move", "metadata.b", "b"), ("delete", "c", ""), ("add", "d", ""), ("keep", "k", "k")}


def script_of(former, later, agreed):
    return {x[:3] for x in edit_script(former, later, agreed)}


def n(*keys):
    return SEP.join(keys)


def test_edit_script_of_nested_trees():
    former = {"a": "object", n("a", "x"): "number", n("a", "y"): "string", "l": "array", n("l", "[]"): "object", n("l", "[]", "u"): "number"}
    later = {"b": "object", n("b", "x"): "number", n("b", "z"): "string", "l": "array", n("l", "[]"): "object", n("l", "[]", "v"): "number"}
    agreed = {("b", "a"), (n("b", "z"), n("a", "y")), (n("l", "[]", "v"), n("l", "[]", "u"))}
    assert script_of(former, later, agreed) == {
        ("rename", "b", "a"), ("keep", n("b", "x"), n("a", "x")), ("rename", n("b", "z"), n("a", "y")), ("keep", "l", "l"), ("keep", n("l", "[]"), n("l", "[]")), ("rename", n("l", "[]", "v"), n("l", "[]", "u")),
    }
    # out of an object that goes, into one that comes
    flat, deep = {"price": "number", "k": "string"}, {"p": "object", n("p", "amount"): "number", "k": "string"}
    pair = (n("p", "amount"), "price")
    assert script_of(flat, deep, {pair}) == {("keep", "k", "k"), ("move", *pair), ("add", "p", "")}
    assert script_of(deep, flat, {pair[::-1]}) == {("keep", "k", "k"), ("move", *pair[::-1]), ("delete", "p", "")}
    assert {x[4:] for x in told(edit_script(deep, flat, {pair[::-1]}), {pair[::-1]}) if x[4]} == {("added", "price"), ("removed", "p")}


@pytest.mark.parametrize("former, later", [({"a": "number", "metadata.b": "number"}, {"metadata.c": "number", "d": "number"}), ({"a": "number", "b": "number"}, {"c": "number", "d": "string", "e": "number"})])
def test_edit_script_is_of_least_cost(former, later):
    """Against all ways to pair the fields."""
    from itertools import chain, combinations, permutations

    agreed = {(y, x) for x in former for y in later}
    best = min(
        sum(drift.COST["rename" if drift.parent(x) == drift.parent(y) else "move"] + drift.COST["retype"] * (former[x] != later[y]) for x, y in zip(xs, ys)) + (len(former) - k) * drift.COST["delete"] + (len(later) - k) * drift.COST["add"]
        for k in range(len(former) + 1) for xs in combinations(former, k) for ys in chain(permutations(later, k))
    )
    assert sum(c for *_, c in edit_script(former, later, agreed)) == best


def test_the_script_decides_the_report(monkeypatch):
    """A field that agrees with two is told of both, as long as a rename is cheaper than to delete and add."""
    former, later, agreed = {"a": "number"}, {"b": "number", "c": "number"}, {("b", "a"), ("c", "a")}
    report = lambda: sorted((x[4], x[5]) for x in told(edit_script(former, later, agreed), agreed) if x[4])
    assert report() == [("renamed", "b"), ("renamed", "c")]
    monkeypatch.setitem(drift.COST, "rename", 50.0)
    assert report() == [("added", "b"), ("added", "c"), ("removed", "a")]


def test_nested_values():
    found = {f: (t, v) for f, t, v in drift.nested("m", {"a": {"b": 1, "c": None}, "l": [{"u": 1}, {"u": "x"}, 3, None]})}
    assert found[n("m", "a", "b")] == ("number", 1) and n("m", "a", "c") not in found and found[n("m", "l", "[]", "u")] == ("number", [1, "x"]) and found[n("m", "l", "[]")][0] == "object"
    deep = {}
    for _ in range(100):
        deep = {"k": deep}
    assert max(f.count(SEP) for f, _, _ in drift.nested("m", deep)) == drift.DEEPEST


def drift_tables(spark, files, rows, payloads=()):
    f = spark.createDataFrame([(n, s, q, k, "x") for n, s, q, k in files], "file_no bigint, stream string, seq_no int, kind string, extra string")
    v = spark.createDataFrame([(n, i, json.dumps(m) if isinstance(m, dict) else m, 1) for n, i, m in rows], "file_no bigint, id string, metadata string, kind int")
    p = spark.createDataFrame([(i, n, json.dumps(m) if isinstance(m, dict) else m) for i, (n, m) in enumerate(payloads)], "record_no bigint, file_no bigint, payload string")
    return v, p, f


def test_drift_report(spark):
    v, p, f = drift_tables(
        spark,
        [(1, "s", 1, "rows"), (2, "s", 3, "rows"), (3, "s", 7, "rows"), (4, "o", 1, "rows"), (5, None, 1, "rows"), (8, "j", 1, "json"), (9, "j", 2, "json")],
        [
            (1, "a", {"x": 1, "t": "5", "r": 1}), (1, "b", {"x": 2, "t": "6"}), (1, "b", {"x": 3, "t": "6"}), (1, None, {"x": 4, "t": "6"}), (1, "c", {"x": 4, "t": "6"}), (1, "c", "broken"), (1, "d", None), (1, "e", "[1]"),
            (2, "a", {"y": 1.0, "t": 5}), (2, "b", {"y": 3, "t": 6}), (2, "b", {"y": 2, "t": None}), (2, "q", {"y": 9, "n": None}),
            (99, "a", {"z": 1}),
        ],
        [(8, {"id": "a", "w": 1, "metadata": {"k": True}}), (9, {"id": "a", "metadata": {"w": 1, "k": True}}), (9, "x"), (1, {"id": "a", "u": 1})],
    )
    assert rows_of(drift_report(v, p, f)) == [
        (2, "renamed", "metadata.y", "metadata.x"), (2, "retyped", "metadata.t", ""), (3, "removed", "metadata.t", ""), (3, "removed", "metadata.y", ""), (9, "renamed", "metadata.w", "w"),
    ]


def test_drift_of_empty_tables(spark):
    v, p, f = drift_tables(spark, [(1, "s", 1, "rows")], [(1, "a", {"x": 1})], [(1, {"id": 1})])
    assert drift_report(v.limit(0), p.limit(0), f).isEmpty()
    assert drift_report(v, p, f.limit(0)).isEmpty()
    assert one_table(v.limit(0), p.limit(0), f).isEmpty()


def test_one_table_follows_renames(spark):
    v, p, f = drift_tables(spark, [(1, "s", 1, "rows"), (2, "s", 2, "rows")], [(1, "a", {"x": 1}), (2, "a", {"y": 1, "z": [2]})])
    found = one_table(v, p, f)
    assert found.columns == ["file_no", "kind", "id", "metadata_x", "metadata_z", "other"]
    assert sorted((r.file_no, r.metadata_x, r.metadata_z) for r in found.collect()) == [(1, "1", None), (2, "1", "[2]")]


def test_one_table_follows_nested_nodes(spark):
    v, p, f = drift_tables(spark, [(1, "s", 1, "rows"), (2, "s", 2, "rows"), (3, "s", 3, "rows")], [(1, "a", {"p": {"amount": 5, "unit": "kg"}}), (2, "a", {"price": 5, "q": {"unit": "kg"}, "l": [{"x": 1}]}), (3, "a", {"cost": 5, "q": {"unit": "kg", "new": {}}})])
    found = one_table(v, p, f)
    assert {r.file_no: r[3:-1] for r in found.collect()} == {1: (None, "5", "kg"), 2: ('[{"x": 1}]', "5", "kg"), 3: (None, "5", "kg")}
    assert found.columns[3:] == ["metadata_l", "metadata_p_amount", "metadata_p_unit", "other"]
    assert {r.file_no: r.other for r in found.collect()}[3] == {n("metadata.q", "new"): "{}"}  # an object that holds nothing has no column


def test_column_names():
    assert column_names(["a.b", "A_b", "id"]) == ["a_b", "A_b_", "id_"]

"""Every core query beside its SQL, on the smallest tables."""

import pytest
from verify import differences, tables

from vectrine.plans import records, search, vectors
from vectrine.plans import tables as feeds

SMALL = "/root/testdata/sf0.001"
MODULES = (feeds, vectors, search, records)
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert differences(QUERIES[name](spark, SMALL), duck, SQL[name])[2] == ""


def one(duck, sql):
    return duck.execute(sql).fetchone()


def graph_search(rows, duck):
    """Places run from 1, distances grow, and the distances are those of the pairs."""
    n, asked = one(duck, "SELECT count(*), count(*) FILTER (vec_id % 100 = 0) FROM embeddings")
    assert n > 100 and len(rows) == 10 * asked
    true = dict(((a, b), d) for a, b, d in duck.execute("SELECT a.vec_id, b.vec_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0").fetchall())
    for r in rows:
        assert r.distance == pytest.approx(true[r.qid, r.id], abs=2e-6)
    for q in {r.qid for r in rows}:
        mine = sorted((r.place, r.distance) for r in rows if r.qid == q)
        assert [p for p, _ in mine] == list(range(1, 11)) and [d for _, d in mine] == sorted(d for _, d in mine) and mine[0][1] == pytest.approx(0, abs=1e-6)


def graph_statistics(rows, duck):
    assert rows[0].nodes == one(duck, "SELECT count(*) FROM embeddings")[0] and 1 <= rows[0].top <= 5 and 16 <= rows[0].mean_links <= 64


def index_storage(rows, duck):
    assert len(rows) >= 1 and all(v is not None and v > 0 for r in rows for v in r if isinstance(v, (int, float)))


def product_training(rows, duck):
    assert rows and all(v is not None for r in rows for v in r)


def random_vectors(rows, duck):
    assert len(rows) == one(duck, "SELECT count(*) FROM embeddings")[0]
    values = [x for r in rows for v in r if isinstance(v, list) for x in v]
    assert all(-1 <= x <= 1 for x in values) and (not values or len(set(values)) > len(values) / 2)


def validation_report(rows, duck):
    told = {r.id for r in rows if r.code == "vector"} if rows and "code" in rows[0] else None
    bad = {x for x, in duck.execute("SELECT id FROM vectors WHERE vector IS NULL OR len(vector) <> 128").fetchall()}
    assert told is None or bad <= told


def consistent_table(rows, duck):
    """A row for each record that is an object, and each text of each field in some column or among the others."""
    rows_, payloads = one(duck, """SELECT (SELECT count(*) FROM vectors v JOIN export_files f USING (file_no) WHERE f.kind = 'rows' AND json_valid(metadata) AND json_type(metadata) = 'OBJECT'),
      (SELECT count(*) FROM serialized_records s JOIN export_files f USING (file_no) WHERE f.kind = 'json' AND json_valid(payload) AND json_type(payload) = 'OBJECT')""")
    assert len([r for r in rows if r.kind == "rows"]) == rows_ and len([r for r in rows if r.kind == "json"]) == payloads
    held = sum(v is not None for r in rows for v in r[3:-1]) + sum(len(r.other or {}) for r in rows)
    assert held > len(rows)


#: What holds for queries that have no SQL.
CHECKS = {"i2_graph_search": graph_search, "a11_graph_statistics": graph_statistics, "p2_table": consistent_table}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql(spark, duck, name):
    rows = QUERIES[name](spark, SMALL).collect()
    check = next((f for prefix, f in {**CHECKS, "a15": index_storage, "k8": product_training, "v12": random_vectors, "w1": validation_report}.items() if name.startswith(prefix)), None)
    assert check is not None, "write a check for this query"
    check(rows, duck)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["run_id", "id"]

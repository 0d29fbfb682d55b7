"""The metadata filter language against a plain evaluation."""

import json

import pytest

from vectrine.operators.filters import FilterBuilder, FilterError, compile_filter, is_dangerous

DOCS = [
    {"n": 5, "s": "apple", "b": True, "z": None, "a": [1, 2, 3], "o": {"x": 1, "y": [2]}},
    {"n": 5.0, "s": "APPLE pie", "b": False, "a": [], "o": {}},
    {"n": "5", "s": 5, "a": ["1", "x"], "o": {"y": [2], "x": 1.0}},
    {"n": -1.5, "a": [{"k": 1, "v": "p"}, {"k": 2}], "k.d": 1},
    {"a": [[1], None, True], "s": ""},
    {},
]

CASES = [
    ({}, [0, 1, 2, 3, 4, 5]),
    ({"n": 5}, [0, 1]),
    ({"n": "5"}, [2]),
    ({"b": True}, [0]),
    ({"z": None}, [0]),
    ({"a": []}, [1]),
    ({"a": [1, 2, 3]}, [0]),
    ({"o": {"x": 1, "y": [2]}}, [0, 2]),
    ({"n": 5, "b": True}, [0]),
    ({"k.d": 1}, [3]),
    ({"n": {"$eq": 5}}, [0, 1]),
    ({"n": {"$ne": 5}}, [2, 3, 4, 5]),
    ({"n": {"$gt": 0}}, [0, 1]),
    ({"n": {"$gte": -1.5}}, [0, 1, 3]),
    ({"n": {"$lt": 5}}, [3]),
    ({"n": {"$lte": "9"}}, []),
    ({"n": {"$in": [5, "5"]}}, [0, 1, 2]),
    ({"n": {"$nin": [5, "5"]}}, [3, 4, 5]),
    ({"n": {"$in": 5}}, []),
    ({"n": {"$nin": 5}}, []),
    ({"s": {"$contains": "app"}}, [0]),
    ({"s": {"$contains": ""}}, [0, 1, 4]),
    ({"n": {"$between": [-2, 5]}}, [0, 1, 3]),
    ({"n": {"$between": [1]}}, []),
    ({"z": {"$exists": True}}, [0]),
    ({"z": {"$exists": False}}, [1, 2, 3, 4, 5]),
    ({"z": {"$exists": 1}}, []),
    ({"n": {"$type": "number"}}, [0, 1, 3]),
    ({"n": {"$type": "string"}}, [2]),
    ({"b": {"$type": "boolean"}}, [0, 1]),
    ({"z": {"$type": "null"}}, [0]),
    ({"a": {"$type": "array"}}, [0, 1, 2, 3, 4]),
    ({"o": {"$type": "object"}}, [0, 1, 2]),
    ({"o": {"$type": "date"}}, []),
    ({"s": {"$regex": "^app"}}, [0]),
    ({"s": {"$regex": {"pattern": "^app", "flags": "i"}}}, [0, 1]),
    ({"s": {"$regex": {"pattern": "^app", "flags": "q"}}}, []),
    ({"s": {"$regex": "(a+)+"}}, []),
    ({"s": {"$regex": "("}}, []),
    ({"a": {"$size": 3}}, [0, 4]),
    ({"a": {"$size": {"$gte": 1, "$lt": 3}}}, [2, 3]),
    ({"a": {"$all": [1, 3]}}, [0]),
    ({"a": {"$all": []}}, [0, 1, 2, 3, 4]),
    ({"a": {"$elemMatch": {"k": {"$gt": 1}}}}, [3]),
    ({"a": {"$elemMatch": {"value": {"$gte": 3}}}}, [0]),
    ({"a": {"$elemMatch": "x"}}, [2]),
    ({"$and": [{"n": 5}, {"b": {"$ne": True}}]}, [1]),
    ({"$or": [{"n": "5"}, {"n": {"$lt": 0}}]}, [2, 3]),
    ({"$and": []}, [0, 1, 2, 3, 4, 5]),
    ({"$or": []}, []),
    ({"$not": {"n": {"$gt": 0}}}, [2, 3, 4, 5]),
    ({"$or": [{"n": 5}], "b": True}, [0]),
    ({"n": {"$gt": 0, "$ne": 5}}, []),
    (FilterBuilder().range("n", 1, 6).exists("z").build(), [0]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCS)]
    return spark.createDataFrame(rows, "i int, metadata string").cache()


@pytest.mark.parametrize("condition, expected", CASES, ids=[json.dumps(c) for c, _ in CASES])
def test_filter(docs, condition, expected):
    assert sorted(r.i for r in docs.where(compile_filter(condition)).collect()) == expected


@pytest.mark.parametrize("bad", [{"n": {"$near": 1}}, {"$xor": []}, {"$and": {}}, {"$and": [{"a": [1]}]}, {"a": {"$size": {"$regex": "x"}}}, 5])
def test_bad_filters(bad):
    with pytest.raises(FilterError):
        compile_filter(bad)


def test_missing_and_broken_metadata(spark):
    df = spark.createDataFrame([(0, None), (1, "{"), (2, "[1]"), (3, '{"a": 1}')], "i int, metadata string")
    assert [r.i for r in df.where(compile_filter({"a": 1})).collect()] == [3]
    assert sorted(r.i for r in df.where(compile_filter({"a": {"$ne": 1}})).collect()) == [0, 1, 2]


def test_keys_with_quotes_and_java_patterns(spark):
    df = spark.createDataFrame([(0, json.dumps({"it's": 1, 'say "x"': 2, "both '\"": 3, "": 4, "a.b": 5, "y": "in 1999"})), (1, "{}")], "i int, metadata string")
    for key, value in (("it's", 1), ('say "x"', 2), ("both '\"", 3), ("", 4), ("a.b", 5)):
        assert [r.i for r in df.where(compile_filter({key: {"$eq": value}})).collect()] == [0]
    assert [r.i for r in df.where(compile_filter({"y": {"$regex": r"(?<year>\d{4})"}})).collect()] == [0]
    assert df.where(compile_filter({"y": {"$regex": "(unclosed"}})).isEmpty()


def test_dangerous_patterns(spark):
    assert is_dangerous("(.*)+") and is_dangerous("(a|b)*") and is_dangerous("a+" * 7) and not is_dangerous("^ab.*c$")
    with pytest.raises(FilterError):
        FilterBuilder().regex("a", "(.+)+")

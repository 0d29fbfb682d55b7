"""Training-data queries beside their SQL, on the smallest tables."""

import pytest
from verify import differences, tables

from vectrine.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return tables(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert differences(QUERIES[name](spark, SMALL), duck, SQL[name])[2] == ""
    else:
        assert QUERIES[name](spark, SMALL).count() > 0


def test_nothing_else_imports_this_package():
    from pathlib import Path

    import vectrine

    root = Path(vectrine.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "vectrine.llm" not in f.read_text()

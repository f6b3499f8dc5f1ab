"""Every query of the subpackage runs on the small tables; those with SQL give what DuckDB gives."""

import pytest
from compare import assert_same

from gridloom.llm.oracle import ORACLE
from gridloom.llm.queries import QUERIES


def test_names():
    assert set(ORACLE) <= set(QUERIES)
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_containers", "p8_found"} <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"p1_found", "p1_best"}))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        assert_same(df, duck.sql(ORACLE[name]))
    else:
        assert df.columns and df.count() >= 0


def test_columns_of_found(spark, data):
    want = {"p1_found": ["result_id"], "p2_found": ["row_id_a", "row_id_b"], "p3_found": ["term", "mark"], "p4_found": ["source", "sample_id"], "p5_found": ["first_row_id"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "pii_kind", "pii_text"]}
    assert {k: QUERIES[k](spark, data).columns for k in want} == want


def test_core_never_imports_the_subpackage():
    from pathlib import Path

    import gridloom

    root = Path(gridloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "gridloom.llm" not in f.read_text(), f

"""Every registered query of the library, against DuckDB where it has a DuckDB query."""

import pytest

from lectern.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert same(df, con, ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    for name in ("token_count", "clean_lines", "bm25_okapi", "knn_exact", "hybrid_fuse", "history_last6", "paragraph_islands"):
        text = plan(QUERIES[name](spark, SF))
        assert "BatchEvalPython" not in text and "CartesianProduct" not in text, name
    assert "TakeOrderedAndProject" in plan(QUERIES["knn_exact"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["last_turns"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in QUERIES["token_count"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

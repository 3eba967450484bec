import re

import __spark_entry__


def test_every_oracle_has_a_query():
    found = __spark_entry__.queries()
    assert found and set(__spark_entry__.oracle_sql()) <= set(found)


def test_entry_returns_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_no_cross_joins_or_nested_loops_in_plans(spark):
    found = __spark_entry__.queries()
    for name in ("d1_concat_chunk", "h1_shuffle", "n10_as_of", "l1_running_sum", "f6_sample_documents"):
        plan = found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name

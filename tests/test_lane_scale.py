"""The table lane moves labels, not cells: each table is read within its row."""

import re

from tidemark.operators import tables
from tidemark.plans import lane, vocabulary

TEXT = "| | Three Months Ended June 30, | | \n| | 2023 | 2022 |\n| --- | --- | --- |\n| Net revenue | 1,000 | (900) |\n| Mystery line | 1 | 2 |\n|  |  |  |"


def test_tables_are_read_without_dealing_out_their_cells(spark):
    rows = spark.createDataFrame([(1, TEXT, "In millions."), (2, "| only | one row |", None), (3, None, None), (4, "| a | b |\n| c | d |", None), (5, TEXT.replace("2022", "2023"), None)], "table_id long, text string, preceding string")
    claims, issues = tables.read_tables(rows, vocabulary.frame(spark, "metric"), vocabulary.frame(spark, "surface"))
    for frame in (claims, issues):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning|SortMergeJoin|Window", plan)
    assert sorted((r["table_id"], r["row"], r["col"], r["value"], r["period_key"]) for r in claims.collect()) == [(1, 3, 1, 1e9, "2023-04-01..2023-06-30"), (1, 3, 2, -9e8, "2022-04-01..2022-06-30")]
    found = sorted((r["table_id"], r["code"], r["row"] is None, r["col"]) for r in issues.collect())
    assert found == [
        (1, "UNRESOLVED_METRIC", False, None), (2, "UNSUPPORTED_TABLE_SHAPE", True, None), (3, "UNSUPPORTED_TABLE_SHAPE", True, None), (4, "MISSING_PERIOD", True, None),
        (5, "AMBIGUOUS_COLUMN_ALIGNMENT", False, 1), (5, "UNRESOLVED_METRIC", False, None),
    ]


def test_many_labels_are_joined_with_the_same_result(spark, tmp_path):
    spark.createDataFrame([(i, 10.5 * i - 40) for i in range(60)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    few = sorted(map(tuple, lane.table_claims(spark, str(tmp_path)).collect()), key=str)
    old, tables.BROADCAST_LABELS = tables.BROADCAST_LABELS, 0
    try:
        assert sorted(map(tuple, lane.table_claims(spark, str(tmp_path)).collect()), key=str) == few and len(few) > 100
    finally:
        tables.BROADCAST_LABELS = old

"""Operators on small frames with nulls, repeats, ties and empty tables."""

import datetime

from pyspark.sql import functions as F

from tidemark.functions import numbers, periods, text
from tidemark.operators import answers, graph, package, tables, vocabulary
from tidemark.sources import catalogs

D = datetime.date


def _values(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_printed_numbers(spark):
    cells = {"$ 1,234": 1234.0, "(56.7)": -56.7, "-": None, "—": None, "12%": 12.0, "n/a": None, "": None, "( )": None, "()": None, "1,23": None, "-7": -7.0, None: None}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", numbers.magnitude(F.col("c")).alias("v"), numbers.is_nil(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["v"] for r in rows} == cells and {r["c"] for r in rows if r["n"]} == {"-", "—"}
    found = spark.createDataFrame([("fell 5% (to $3.20 million)",), ("",), (None,)], "s string").select(numbers.numerals(F.col("s")).alias("t")).collect()
    assert [(t["value"], t["unit"]) for t in found[0]["t"]] == [(5.0, "percent"), (3.2e6, "USD")] and found[1]["t"] == []


def test_periods(spark):
    rows = spark.createDataFrame([("2023", "Three Months Ended June 30,", ""), ("2023", "", ""), ("June 30, 2023", "", "Homes (at period end)"), ("February 30, 2023", "Year Ended", ""), (None, None, None)], "l string, h string, r string")
    out = [r["p"] for r in rows.select(periods.resolve(F.col("l"), F.col("h"), F.col("r")).alias("p")).collect()]
    assert (out[0]["start"], out[0]["end"]) == (D(2023, 4, 1), D(2023, 6, 30)) and out[1] is None and out[2]["instant"] == D(2023, 6, 30) and out[3] is None and out[4] is None


def test_texts(spark):
    row = spark.createDataFrame([("The cat. A Cat, cat-like concat",)], "t string").select(
        text.phrase_at(F.col("t"), F.lit("cat")).alias("at"), text.phrase_at(F.col("t"), F.lit("c.t")).alias("no"), text.occurrences(F.col("t"), F.lit("cat")).alias("all"), text.digest(F.lit(None), F.lit(" ")).alias("blank"),
    ).first()
    assert row["at"] == 5 and row["no"] == 0 and row["all"] == [4, 11, 16, 28] and row["blank"] is None


def test_collapsed_columns_and_cell_spans(spark):
    grid = tables.addressed(tables.cells(spark.createDataFrame([(1, "| a |  | b |\n\n| --- | --- | --- |\n|  |  | c |"), (2, None), (3, "")], "table_id long, text string")))
    assert _values(grid.where("cell <> ''").select("table_id", "row", "col", "collapsed", "cell")) == [(1, 0, 0, 0, "a"), (1, 0, 2, 1, "b"), (1, 2, 2, 1, "c")]
    body = "| a | b |\n| cc |  d |"
    found = spark.createDataFrame([(1, 1), (1, 2), (5, 0)], "r int, c int").select(answers.cell_span(F.lit(body), F.col("r"), F.col("c")).alias("s")).collect()
    assert body[found[0]["s"]["start"] : found[0]["s"]["end"]] == "d" and found[1]["s"] is None and found[2]["s"] is None


def test_versions_and_closure(spark):
    facts = spark.createDataFrame([("k", D(2020, 1, 5), 1), ("k", D(2019, 1, 1), 2), ("k", None, 3), (None, D(2020, 1, 1), 4), ("z", D(2020, 1, 1), 5)], "key string, day date, _day int")
    versions = spark.createDataFrame([("k", D(2020, 1, 1), "a"), ("k", D(2020, 1, 5), "b"), ("k", D(2020, 1, 5), "c"), ("k", None, "x")], "key string, since date, v string")
    assert {r["_day"]: r["v_in_force"] for r in vocabulary.in_force(facts, versions, "key", "day", "since", "v").collect()} == {1: "c", 2: None, 3: None, 4: None, 5: None}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)] + [("9", "7"), (None, "1")], "child string, parent string")
    closed = {(r["child"], r["ancestor"]): r["steps"] for r in vocabulary.ancestors(chain).collect()}
    assert closed["0", "9"] == 9 and closed["8", "8"] == 3 and ("6", "6") not in closed
    assert vocabulary.ancestors(chain.limit(0)).count() == 0
    spans = spark.createDataFrame([("a", 1, D(2020, 1, 1), None), ("a", 2, D(2020, 2, 1), D(2020, 2, 2)), ("a", 3, D(2020, 3, 1), D(2020, 3, 2)), ("b", 4, D(2020, 1, 1), None)], "k string, i int, s date, u date")
    assert _values(vocabulary.overlaps(spans, "k", "i", "s", "u")) == [("a", 1, 2), ("a", 1, 3)]


def test_graph_loads(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "key string, n int")
    held = spark.createDataFrame([("b", 0), ("c", 0)], "key string, n int")
    assert _values(graph.upserted(held, rows)) == [("a", 1), ("b", 1), ("c", 0)] and _values(graph.upserted(rows.limit(0), rows)) == [("a", 1), ("b", 1)]
    one = graph.nodes(spark.createDataFrame([(1, None)], "id int, x string"), "L", F.col("id").cast("string"), "r", x=F.col("x"), y=F.col("id"))
    assert one.first()["props"] == {"y": "1", "run_id": "r", "projection": graph.PROJECTION}
    assert {r["check"]: r["n"] for r in graph.reconciled(one, one.unionByName(one)).collect()} == {"missing": 0, "unexpected": 0, "repeated": 1, "changed": 0}


def test_packages_fit(spark):
    rows = spark.createDataFrame([(1, "x", 1, 10, False, 1), (1, "x", 2, 10, False, 2), (1, "x", 3, 10, True, 3), (1, "y", 4, 10, False, 1), (2, "y", 5, 50, True, 1)], "package int, section string, row_id int, tokens int, protected boolean, rank int")
    sections = spark.createDataFrame([("x", 1, 1), ("y", 0, 0)], "section string, turn int, least int")
    assert {r["row_id"]: (r["dropped"], r["fits"]) for r in package.trimmed(rows, sections, 20).collect()} == {1: (False, True), 2: (True, True), 3: (False, True), 4: (True, True), 5: (False, False)}
    literals = spark.createDataFrame([(1, "5 and 15 and 7, 7", "a", "5"), (1, "5 and 15 and 7, 7", "b", "15"), (1, "5 and 15 and 7, 7", "c", "7"), (1, "5 and 15 and 7, 7", "d", "")], "id int, text string, handle string, literal string")
    assert {r["handle"] for r in package.anchors(literals).collect()} == {"a", "b"}
    assert package.trimmed(rows.limit(0), sections, 20).count() == 0


def test_catalogs(spark):
    arrays = spark.createDataFrame([(1, ([1, 2, 3], ["a", "b"])), (2, ([], ["x"])), (3, None)], "k int, r struct<n: array<int>, t: array<string>>")
    assert _values(catalogs.transposed(arrays, "r", "k")) == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    kept, twice, without = catalogs.catalogued(spark.createDataFrame([("a", 2), ("a", 1), (None, 3)], "k string, n int"), "k", F.col("n"))
    assert _values(kept) == [("a", 1)] and _values(twice) == [("a", 2)] and _values(without) == [(None, 3)]

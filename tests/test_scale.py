"""What only larger tables show, on a few rows."""

from pyspark.sql import functions as F

from tidemark.operators import graph, package, parse
from tidemark.plans import built

# pairs of edges whose digests agree in their first 12 digits
TWINS = [("obs:2440671", "d:16566#p14"), ("obs:7096693", "d:47323#p7"), ("obs:6307111", "d:42190#p1"), ("obs:2839441", "d:18125#p19")]


def test_edge_keys_tell_many_edges_apart(spark):
    rows = graph.edges(spark.createDataFrame(TWINS, "src string, dst string"), "EVIDENCED_BY", F.col("src"), F.col("dst"), "r")
    assert rows.select("key").distinct().count() == len(TWINS)
    assert {len(r["key"]) for r in rows.collect()} == {len("edge:evidenced_by:") + graph.DIGITS}


def test_a_literal_within_a_negative_one_does_not_stand_by_itself(spark):
    text = "It was -$5,001 then $5,001 of x $7 and $2-$9 more."
    rows = [(1, text, "{F1}", "-$5,001"), (1, text, "{F2}", "$5,001"), (1, text, "{F3}", "$7"), (1, text, "{F4}", "$9"), (2, "It was -$5", "{F1}", "$5")]
    found = package.anchors(spark.createDataFrame(rows, "id long, text string, handle string, literal string"))
    assert sorted((r["id"], r["handle"], r["end"]) for r in found.collect()) == [(1, "{F1}", 14), (1, "{F2}", 26), (1, "{F3}", 34), (1, "{F4}", 44)]


def test_a_reference_without_its_end_stays():
    assert [b[2] for b in parse.page_blocks("<h1>and&&&amp</h1><p>a &amp; b &lt;c&gt; R&D &copy &#65; &#65 &am;</p>")] == ["and&&&amp", "a & b <c> R&D &copy A &#65 &am;"]


def test_the_query_keeps_long_paragraphs_whole(spark, tmp_path):
    long = "Ten letters. " * 400
    spark.createDataFrame([(1, f"<h1>t</h1><p>a</p><p>{long}</p><p>b</p>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = built.page_passages(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["n_chars"] for r in rows] == [1, len(long) - 1, 1]
    assert len(parse.page_passages(parse.page_blocks(f"<p>{long}</p>"))) == 2

"""Graph queries over catalogs that stand in the tables: projection, loading, reconciliation and reads.

Observations are orders, their evidence the lines, documents and passages the suppliers, events the events,
entities come from customers, users and nations, issues are returned lines. Faults are planted by a stated
rule where a check must find some. The SQL tells counts and digests from the tables, without a graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..sources.shared import cut
from ..sources.tables import read
from . import vocabulary

RUN = "run-0001"
METRICS = ("net_revenue", "open_orders", "return_rate", "refund_total")


def _pick(c: Column, *v: object) -> Column:
    return F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, metric_id, subject, period_key, period_end, value, document_id, warnings."""
    rows = read(spark, sf_dir, "orders")
    return rows.select(
        F.concat(F.lit("obs:"), F.col("o_orderkey")).alias("claim_id"), _pick(F.col("o_custkey") % 4, *METRICS).alias("metric_id"), F.concat(F.lit("c:"), F.col("o_custkey")).alias("subject"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("period_key"), F.col("o_orderdate").cast("date").alias("period_end"), F.floor("o_totalprice").cast("long").alias("value"),
        F.when(F.col("o_orderpriority").startswith("5"), F.array(F.lit("low_priority"))).otherwise(F.array().cast("array<string>")).alias("warnings"), "o_orderkey", "o_custkey",
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, kind, target (passage or other source), document_id, ordinal, evidence_index, quote."""
    rows = read(spark, sf_dir, "lineitem")
    passage = F.concat(F.lit("d:"), F.col("l_suppkey"), F.lit("#p"), F.col("l_partkey") % 20)
    other = F.col("l_linenumber") == 4
    return rows.select(
        F.concat(F.lit("obs:"), F.col("l_orderkey")).alias("claim_id"), F.when(other, "xbrl").otherwise("passage").alias("kind"), F.when(other, F.concat(F.lit("x:"), F.col("l_partkey") % 100)).otherwise(passage).alias("target"),
        F.concat(F.lit("d:"), F.col("l_suppkey")).alias("document_id"), (F.col("l_partkey") % 20).alias("ordinal"), F.col("l_linenumber").alias("evidence_index"), F.col("l_quantity").cast("string").alias("quote"), "l_orderkey", "l_suppkey",
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return rows.select(F.concat(F.lit("d:"), F.col("s_suppkey"), F.lit("#p"), "ordinal").alias("passage_id"), F.concat(F.lit("d:"), F.col("s_suppkey")).alias("document_id"), "ordinal", F.col("s_nationkey").alias("nation"))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of four sources with attributes that may disagree."""
    customers, users = read(spark, sf_dir, "customer"), read(spark, sf_dir, "events").where("user_id IS NOT NULL")
    row = lambda frame, source, key, kind, name: frame.select(F.lit(source).alias("source"), key.alias("key"), kind.alias("kind"), name.alias("name"))
    key = F.concat(F.lit("c:"), F.col("c_custkey"))
    return (
        row(customers, "subjects", key, F.lit("company"), F.col("c_name")).unionByName(row(customers.where("c_custkey % 7 = 0"), "registry", key, F.lit("company"), F.upper("c_name")))
        .unionByName(row(users, "participants", F.concat(F.lit("c:"), F.col("user_id")), F.when(F.col("user_id") % 5 == 0, "person").otherwise("company"), F.lit(None).cast("string")))
        .unionByName(row(read(spark, sf_dir, "nation"), "vocabulary", F.concat(F.lit("n:"), F.col("n_nationkey")), F.lit("place"), F.col("n_name")))
    )


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_cited(evidence(spark, sf_dir), "claim_id", "target", "evidence_index")


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All nodes and all edges of the projection, written once."""
    seen, cited, held = observations(spark, sf_dir), cut(_cited(spark, sf_dir)), passages(spark, sf_dir)
    by_passage = cited.where("kind = 'passage'").select(F.col("target").alias("passage_id")).distinct()
    used = held.join(by_passage, "passage_id", "left_semi")
    happened = read(spark, sf_dir, "events")
    event = F.concat(F.lit("e:"), F.col("event_id"))
    merged = graph.variants(_entities(spark, sf_dir), "key", "kind", "name")
    # line numbers may repeat within an order: an issue is one line number, told by its least line
    line = F.struct("l_partkey", "l_suppkey", "l_linestatus")
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.min(line).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    issue = F.concat(F.lit("i:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"))
    metrics = vocabulary.frame(spark, "metric")
    made = [
        graph.nodes(metrics, "Metric", F.col("metric_id"), RUN, label=F.col("label"), unit=F.col("unit")),
        graph.nodes(seen, "Observation", F.col("claim_id"), RUN, F.when(F.size("warnings") > 0, F.array(F.lit("Warned"))), metric=F.col("metric_id"), period=F.col("period_key"), value=F.col("value")),
        graph.nodes(happened, "Event", event, RUN, type=F.col("event_type"), occurred_on=F.col("ts").cast("date"), announced_on=F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 5).cast("int")), prop_k=F.get_json_object("props", "$.k")),
        graph.nodes(merged, "Entity", F.col("key"), RUN, F.when(F.col("kind_conflict") | F.col("name_conflict"), F.array(F.lit("Conflict"))), kind=F.col("kind"), kind_variants=F.col("kind_variants"), name=F.col("name"), name_variants=F.col("name_variants")),
        graph.nodes(happened.where("event_id % 10 = 0"), "Entity", F.concat(F.lit("unnamed:"), F.col("event_id")), RUN, F.array(F.lit("Unresolved")), kind=F.lit("unnamed")),
        graph.nodes(used, "Passage", F.col("passage_id"), RUN, ordinal=F.col("ordinal")),
        graph.nodes(used.select("document_id").distinct(), "Document", F.col("document_id"), RUN),
        graph.nodes(cited.where("kind = 'xbrl'").select("target").distinct(), "Source", F.col("target"), RUN),
        graph.nodes(returned, "Issue", issue, RUN, F.when(F.col("l_linestatus") == "O", F.array(F.lit("NotAttempted"))), code=F.concat(F.lit("RETURNED_"), F.col("l_linestatus"))),
    ]
    role = F.when(F.col("event_type") == "purchase", "buyer").otherwise("actor")
    joined = [
        graph.edges(seen, "HAS_OBSERVATION", F.col("metric_id"), F.col("claim_id"), RUN), graph.edges(seen, "OBSERVATION_OF_SUBJECT", F.col("claim_id"), F.col("subject"), RUN),
        graph.edges(cited.join(seen.select("claim_id"), "claim_id", "left_semi"), "EVIDENCED_BY", F.col("claim_id"), F.col("target"), RUN, quote=F.col("quote"), evidence_index=F.col("evidence_index")),
        graph.edges(happened.where("user_id IS NOT NULL"), "PARTICIPATES_IN", F.concat(F.lit("c:"), F.col("user_id")), event, RUN, (role,), 12, role=role),  # the SQL of projected_keys states 12 digits
        graph.edges(happened.where("event_id % 10 = 0"), "PLACEHOLDER_FOR", F.concat(F.lit("unnamed:"), F.col("event_id")), event, RUN),
        graph.edges(used, "PART_OF", F.col("passage_id"), F.substring_index("passage_id", "#p", 1), RUN),
        graph.edges(read(spark, sf_dir, "customer"), "LOCATED_IN", F.concat(F.lit("c:"), F.col("c_custkey")), F.concat(F.lit("n:"), F.col("c_nationkey")), RUN),
        graph.edges(returned, "FOUND_IN", issue, F.concat(F.lit("d:"), F.col("l_suppkey")), RUN), graph.edges(returned, "CONCERNS_METRIC", issue, _pick(F.col("l_partkey") % 4, *METRICS), RUN),
        graph.edges(metrics.alias("a").join(metrics.alias("b"), F.col("a.group_id") == F.col("b.group_id")).where("a.metric_id < b.metric_id"), "DISTINCT_FROM", F.col("a.metric_id"), F.col("b.metric_id"), RUN),
    ]
    all_nodes, all_edges = made[0], joined[0]
    for more in made[1:]:
        all_nodes = all_nodes.unionByName(more)
    for more in joined[1:]:
        all_edges = all_edges.unionByName(more)
    return cut(all_nodes), cut(all_edges)


def projected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label, with marks, keys and provenance."""
    found, _ = graph_parts(spark, sf_dir)
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.count_if(F.size("marks") > 0).alias("n_marked"), F.count_distinct("run").alias("n_runs"), F.count_if(F.col("props")["projection"].isNull()).alias("n_without_provenance"))


def projected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type."""
    _, found = graph_parts(spark, sf_dir)
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


def projected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of participation edges, which hold the role."""
    _, found = graph_parts(spark, sf_dir)
    return found.where("type = 'PARTICIPATES_IN'").select("src", "dst", "key")


def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q29: property names of nodes by label, and how many nodes have each."""
    found, _ = graph_parts(spark, sf_dir)
    return found.select("label", F.explode(F.map_keys("props")).alias("name")).groupBy("label", "name").agg(F.count(F.lit(1)).alias("n"))


def entity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose sources disagree, with the variants."""
    merged = graph.variants(_entities(spark, sf_dir), "key", "kind", "name")
    return merged.where("kind_conflict OR name_conflict").select("key", "kind", "kind_variants", "name", "name_variants", F.array_join("sources", ",").alias("sources"))


def unresolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges at unresolved nodes in either direction, and whether a placeholder belongs to exactly one event."""
    found, joined = graph_parts(spark, sf_dir)
    open_ = found.where(F.array_contains("marks", "Unresolved")).select("key")
    ends = joined.select("type", F.col("src").alias("key"), F.col("dst").alias("other")).unionByName(joined.select("type", F.col("dst").alias("key"), F.col("src").alias("other")))
    return ends.join(open_, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("other") == 1).alias("one_event"))


def edge_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that can't be loaded, by the end that is missing, where every fourth document is not there."""
    found, joined = graph_parts(spark, sf_dir)
    gone = (F.col("label") == "Document") & (F.substring("key", 3, 20).cast("long") % 4 == 1)
    _, lost = graph.loadable(joined, found.where(~gone))
    return lost.groupBy("type", "missing").agg(F.count(F.lit(1)).alias("n"))


def edge_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge keys that stand twice, as the same row or as two, where every ninth edge is written again and every eighteenth differs."""
    _, joined = graph_parts(spark, sf_dir)
    placed = joined.where("type = 'LOCATED_IN'").withColumn("n", F.substring("src", 3, 20).cast("long"))
    again = placed.where("n % 9 = 0").withColumn("props", F.when(F.col("n") % 18 == 0, F.map_concat("props", F.create_map(F.lit("note"), F.lit("other")))).otherwise(F.col("props")))
    return graph.collisions(placed.unionByName(again)).groupBy("identical").agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most"))


def endpoint_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between labels that their type doesn't allow."""
    found, joined = graph_parts(spark, sf_dir)
    allowed = spark.createDataFrame([("HAS_OBSERVATION", "Metric", "Observation"), ("EVIDENCED_BY", "Observation", "Passage"), ("PART_OF", "Passage", "Document"), ("LOCATED_IN", "Entity", "Entity"), ("PARTICIPATES_IN", "Entity", "Event")], "type string, src_label string, dst_label string")
    return graph.inadmissible(joined, found, allowed)


def load_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load holds against what was projected, after rows were lost, repeated, changed and added by a stated rule."""
    found, _ = graph_parts(spark, sf_dir)
    expected = found.where("label = 'Observation'").withColumn("n", F.substring("key", 5, 20).cast("long"))
    changed = F.when(F.col("n") % 13 == 0, F.map_concat(F.map_filter("props", lambda k, v: k != "value"), F.create_map(F.lit("value"), F.lit("0")))).otherwise(F.col("props"))
    loaded = expected.where("n % 11 <> 0").withColumn("props", changed)
    actual = loaded.unionByName(loaded.where("n % 17 = 0")).unionByName(expected.where("n % 101 = 0").withColumn("key", F.concat(F.lit("new:"), "key")))
    return graph.reconciled(expected, actual)


def repeated_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of new rows over held ones, twice: rows by run, the same after each time."""
    found, _ = graph_parts(spark, sf_dir)
    people = found.where("label = 'Entity'")
    held = people.where(F.pmod(F.length("key"), F.lit(2)) == 0).withColumn("run", F.lit("run-0000"))
    rows = people.where(F.col("key").startswith("c:"))
    once = cut(graph.upserted(held, rows))
    twice = graph.upserted(once, rows)
    count = lambda frame, name: frame.groupBy(F.lit(name).alias("load"), "run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("n_keys"))
    return count(once, "first").unionByName(count(twice, "second"))


def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its evidence, passage and document, and the properties of the edge."""
    found, joined = graph_parts(spark, sf_dir)
    cites = joined.where("type = 'EVIDENCED_BY'").select(F.col("src").alias("claim_id"), F.col("dst").alias("passage_id"), F.col("props")["quote"].alias("quote"), F.col("props")["evidence_index"].cast("long").alias("evidence_index"))
    within = joined.where("type = 'PART_OF'").select(F.col("src").alias("passage_id"), F.col("dst").alias("document_id"))
    seen = found.where("label = 'Observation'").select(F.col("key").alias("claim_id"), F.col("props")["metric"].alias("metric_id"), F.col("props")["period"].alias("period_key"))
    return seen.join(cites, "claim_id").join(within, "passage_id").select("claim_id", "metric_id", "period_key", "passage_id", "document_id", "quote", "evidence_index")


def period_comparison(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Q04: a metric's observations by period: counts, distinct collections, bounded handles."""
    rows = observations(spark, sf_dir)
    handles = F.array_join(F.slice(F.sort_array(F.collect_list("claim_id")), 1, most), ",")
    return rows.groupBy("metric_id", "period_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("value").alias("n_values"), F.count_if(F.size("warnings") > 0).alias("n_warned"), F.min("value").alias("low"), F.max("value").alias("high"), handles.alias("handles"),
    )


def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q08: the ten passages (documents' texts) that fit three words best, by BM25."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return graph.ranked_passages(docs, ["the", "license", "is"], 10, 500).select(F.col("id").alias("doc_id"), "score")


def events_between(spark: SparkSession, sf_dir: str, since: str = "2024-01-08", until: str = "2024-01-12") -> DataFrame:
    """Q09: events that occurred or were announced in a window, and by which date."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("occurred"), F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 5).cast("int")).alias("announced"))
    a, b = F.col("occurred").between(since, until), F.col("announced").between(since, until)
    return rows.where(a | b).select("event_id", "event_type", F.when(a & b, "both").when(a, "occurred_on").otherwise("announced_on").alias("matched"))


def counter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues on the documents that carry a metric's period, in order of severity, and whether they count against it."""
    cites = evidence(spark, sf_dir).where("kind = 'passage'").select("claim_id", "document_id").distinct()
    carried = observations(spark, sf_dir).where("metric_id = 'net_revenue' AND period_key = '1996Q2'").select("claim_id").join(cites, "claim_id").select("document_id").distinct()
    issues = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("d:"), F.col("l_suppkey")).alias("document_id"), "l_orderkey", "l_linenumber", "l_linestatus", "l_partkey")
    severity = F.when(F.col("l_linestatus") == "F", 0).when(F.col("l_partkey") % 2 == 0, 1).otherwise(2)
    rows = issues.join(carried, "document_id", "left_semi").withColumn("rank", severity)
    kind = F.when(F.col("l_partkey") % 4 != 0, "warning_only").when(F.col("rank") == 2, "warning_only").otherwise("counter_evidence")
    return rows.select("document_id", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("severity"), kind.alias("kind"))


def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: of every metric how many observations, documents and issues there are, none left out."""
    seen = observations(spark, sf_dir)
    cites = evidence(spark, sf_dir).where("kind = 'passage'").select("claim_id", "document_id").distinct()
    documents = seen.join(cites, "claim_id").groupBy("metric_id").agg(F.count_distinct("document_id").alias("n_documents"))
    issues = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(_pick(F.col("l_partkey") % 4, *METRICS).alias("metric_id")).agg(F.count(F.lit(1)).alias("n_issues"))
    counts = seen.groupBy("metric_id").agg(F.count(F.lit(1)).alias("n_observations"))
    out = vocabulary.frame(spark, "metric").select("metric_id")
    for frame in (counts, documents, issues):
        out = out.join(frame, "metric_id", "left")
    return out.select("metric_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_observations", "n_documents", "n_issues")))


def metric_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q01, Q02, Q19: metrics in order up to a limit, saying whether there are more, with their formulas."""
    metrics = vocabulary.frame(spark, "metric").join(vocabulary.frame(spark, "formula").groupBy("metric_id").agg(F.max("version").alias("formula"), F.count(F.lit(1)).alias("n_versions")), "metric_id", "left")
    seen = observations(spark, sf_dir).groupBy("metric_id").agg(F.count(F.lit(1)).alias("n"))
    rows = metrics.join(seen, "metric_id", "left").select("metric_id", "label", "unit", "formula", F.coalesce("n_versions", F.lit(0)).alias("n_versions"), F.coalesce("n", F.lit(0)).alias("n"))
    return graph.truncated(rows, [F.col("metric_id")], 5).withColumn("place", F.col("place").cast("long"))


def story_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15-Q17: nodes and edges around two metrics in three periods, each once, with evidence."""
    found, joined = graph_parts(spark, sf_dir)
    keys = found.where("label = 'Observation'").where(F.col("props")["metric"].isin("net_revenue", "open_orders") & F.col("props")["period"].isin("1996Q1", "1996Q2", "1997Q3")).select("key")
    touching = joined.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").unionByName(joined.join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi")).dropDuplicates(["key"])
    ends = touching.select(F.explode(F.array("src", "dst")).alias("key")).distinct().join(found.select("key", "label"), "key")
    return touching.groupBy(F.concat(F.lit("edge "), "type").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(ends.groupBy(F.concat(F.lit("node "), "label").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def refusals_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections joined to issues by the digest both ids end in, and refused identities that were observed all the same."""
    orders = read(spark, sf_dir, "orders")
    suffix = text.digest(F.col("o_orderkey"))
    issues = orders.where("o_orderkey % 3 = 0").select(F.concat(F.lit("issue:"), suffix).alias("issue_id"), F.concat(F.lit("refused obs:"), F.col("o_orderkey"), F.lit(" twice")).alias("detail"))
    rejections = orders.where("o_orderkey % 4 = 0").select(F.concat(F.lit("rejected:"), suffix).alias("rejection_id"))
    end = lambda c: F.element_at(F.split(c, ":"), -1)
    joined = rejections.withColumn("s", end("rejection_id")).join(issues.select(end("issue_id").alias("s"), "detail"), "s", "left")
    named = issues.select(F.regexp_extract("detail", r"(obs:\d+)", 1).alias("claim_id")).join(observations(spark, sf_dir).where("o_orderkey % 2 = 0").select("claim_id"), "claim_id", "left_semi")
    return joined.groupBy(F.when(F.col("detail").isNotNull(), "mirrored").otherwise("unmirrored").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(named.agg(F.count(F.lit(1)).alias("n")).select(F.lit("refused but observed").alias("what"), "n"))


def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs joined by id, the first field in which they differ, ids on one side only, ids that don't recompute."""
    seen = observations(spark, sf_dir)
    other = seen.where("o_orderkey % 19 <> 0").select(
        "claim_id", F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("metric_id")).alias("metric_id"), "subject", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("period_key")).alias("period_key"), (F.col("value") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).alias("value"),
    )
    fields = ("metric_id", "subject", "period_key", "value")
    both = seen.select("claim_id", *fields, "o_orderkey").alias("a").join(other.alias("b"), "claim_id", "full_outer")
    differs = F.coalesce(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in fields))
    what = F.when(F.col("b.subject").isNull(), "missing").otherwise(F.coalesce(differs, F.lit("agree")))
    return both.groupBy(what.alias("first_difference")).agg(F.count(F.lit(1)).alias("n"))


def cited_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that are cited, those that aren't, and citations without a passage, by document."""
    held, cites = passages(spark, sf_dir), evidence(spark, sf_dir).where("kind = 'passage' AND l_orderkey % 2 = 0").select(F.col("target").alias("passage_id")).distinct()
    rows = held.where("ordinal <> 3").select("passage_id", "document_id").join(cites.withColumn("cited", F.lit(True)), "passage_id", "full_outer")
    state = F.when(F.col("document_id").isNull(), "no passage").when(F.col("cited"), "cited").otherwise("uncited")
    return rows.groupBy(F.coalesce("document_id", F.substring_index("passage_id", "#p", 1)).alias("document_id"), state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a filing's header against those of its index: on one side only, alike but for case, no main document or several."""
    lines = read(spark, sf_dir, "lineitem").withColumn("name", F.concat(F.lit("f"), F.col("l_linenumber"), F.lit(".htm")))
    header = lines.where("(l_orderkey + l_linenumber) % 5 <> 0").select(F.col("l_orderkey").alias("filing"), "name", (F.col("l_partkey") % 3 == 0).alias("main")).groupBy("filing", "name").agg(F.max("main").alias("main"))
    index = lines.where("(l_orderkey + l_linenumber) % 7 <> 0").select(F.col("l_orderkey").alias("filing"), F.when(F.col("l_partkey") % 4 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.lit(True).alias("listed")).distinct()
    both = header.withColumn("named", F.lit(True)).join(index, ["filing", "name"], "full_outer")
    only = both.select("filing", F.when(F.col("listed").isNull(), "missing_in_index").when(F.col("named").isNull(), "missing_in_header").alias("anomaly")).where("anomaly IS NOT NULL")
    alike = both.groupBy("filing", F.lower("name").alias("l")).agg(F.count_distinct("name").alias("n")).where("n > 1").select("filing", F.lit("case_collision").alias("anomaly"))
    mains = header.groupBy("filing").agg(F.count_if("main").alias("n")).where("n <> 1").select("filing", F.when(F.col("n") == 0, "no_main").otherwise("several_mains").alias("anomaly"))
    return only.unionByName(alike).unionByName(mains).groupBy("filing", "anomaly").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        projected_nodes, projected_edges, projected_keys, property_keys, entity_conflicts, unresolved_edges, edge_endings, edge_collisions, endpoint_labels, load_reconciliation, repeated_load, fact_sources, period_comparison, passage_search, events_between,
        counter_evidence, evidence_scope, metric_catalog, story_subgraph, refusals_mirrored, field_agreement, cited_only, header_index,
    )
}

_OBS = "ob AS (SELECT 'obs:' || o_orderkey AS claim_id, ['net_revenue', 'open_orders', 'return_rate', 'refund_total'][o_custkey % 4 + 1] AS metric_id, 'c:' || o_custkey AS subject, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period_key, floor(o_totalprice)::BIGINT AS value, o_orderpriority LIKE '5%' AS warned, o_orderkey, o_custkey FROM orders)"
_CITE = """ev AS (SELECT 'obs:' || l_orderkey AS claim_id, l_orderkey, CASE WHEN l_linenumber = 4 THEN 'x:' || (l_partkey % 100) ELSE 'd:' || l_suppkey || '#p' || (l_partkey % 20) END AS target, l_linenumber = 4 AS x, 'd:' || l_suppkey AS document_id, l_linenumber, l_quantity FROM lineitem),
ci AS (SELECT claim_id, target, any_value(x) AS x, any_value(document_id) AS document_id, min(l_linenumber)::BIGINT AS evidence_index, min((l_linenumber, l_quantity::VARCHAR))[2] AS q FROM ev GROUP BY claim_id, target),
us AS (SELECT DISTINCT target, document_id FROM ci WHERE NOT x AND document_id IN (SELECT 'd:' || s_suppkey FROM supplier))"""
_ENT = """en AS (SELECT 'subjects' AS source, 'c:' || c_custkey AS key, 'company' AS kind, c_name AS name FROM customer UNION ALL SELECT 'registry', 'c:' || c_custkey, 'company', upper(c_name) FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'participants', 'c:' || user_id, CASE WHEN user_id % 5 = 0 THEN 'person' ELSE 'company' END, NULL FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'vocabulary', 'n:' || n_nationkey, 'place', n_name FROM nation),
em AS (SELECT key, count(DISTINCT kind) AS nk, count(DISTINCT name) AS nn, min(kind) AS k0, min(name) AS n0, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kv, string_agg(DISTINCT name, '|' ORDER BY name) AS nv, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM en GROUP BY key)"""
_ISS = "iss AS (SELECT l_orderkey, l_linenumber, min((l_partkey, l_suppkey, l_linestatus)) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"
_M = vocabulary.values("metric")

ORACLES = {
    "projected_nodes": f"""WITH {_M}, {_OBS}, {_CITE}, {_ISS}, {_ENT}, r AS (SELECT 'Metric' AS label, count(*) AS n, 0 AS m FROM metric_dim UNION ALL SELECT 'Observation', count(*), count(*) FILTER (WHERE warned) FROM ob UNION ALL SELECT 'Event', count(*), 0 FROM events
UNION ALL SELECT 'Entity', (SELECT count(*) FROM em) + (SELECT count(*) FROM events WHERE event_id % 10 = 0), (SELECT count(*) FROM em WHERE nk > 1 OR nn > 1) + (SELECT count(*) FROM events WHERE event_id % 10 = 0) UNION ALL SELECT 'Passage', count(*), 0 FROM us
UNION ALL SELECT 'Document', count(DISTINCT document_id), 0 FROM us UNION ALL SELECT 'Source', count(DISTINCT target), 0 FROM ci WHERE x UNION ALL SELECT 'Issue', count(*), count(*) FILTER (WHERE m[3] = 'O') FROM iss)
SELECT label, n, n AS n_keys, m::BIGINT AS n_marked, 1::BIGINT AS n_runs, 0::BIGINT AS n_without_provenance FROM r WHERE n > 0""",
    "projected_edges": f"""WITH {_M}, {_OBS}, {_CITE}, {_ISS}, {_ENT}, r AS (SELECT 'HAS_OBSERVATION' AS type, metric_id AS s, claim_id AS d FROM ob UNION ALL SELECT 'OBSERVATION_OF_SUBJECT', claim_id, subject FROM ob UNION ALL SELECT 'EVIDENCED_BY', claim_id, target FROM ci WHERE claim_id IN (SELECT claim_id FROM ob)
UNION ALL SELECT 'PARTICIPATES_IN', 'c:' || user_id, 'e:' || event_id FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'PLACEHOLDER_FOR', 'unnamed:' || event_id, 'e:' || event_id FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'PART_OF', target, document_id FROM us
UNION ALL SELECT 'LOCATED_IN', 'c:' || c_custkey, 'n:' || c_nationkey FROM customer UNION ALL SELECT 'FOUND_IN', l_orderkey || '-' || l_linenumber, 'd:' || m[2] FROM iss UNION ALL SELECT 'CONCERNS_METRIC', l_orderkey || '-' || l_linenumber, (m[1] % 4)::VARCHAR FROM iss
UNION ALL SELECT 'DISTINCT_FROM', a.metric_id, b.metric_id FROM metric_dim a JOIN metric_dim b ON a.group_id = b.group_id AND a.metric_id < b.metric_id)
SELECT type, count(*) AS n, count(DISTINCT s || ' ' || d) AS n_keys, count(DISTINCT s) AS n_src, count(DISTINCT d) AS n_dst FROM r GROUP BY type""",
    "projected_keys": """SELECT 'c:' || user_id AS src, 'e:' || event_id AS dst, 'edge:participates_in:' || substr(sha256('PARTICIPATES_IN' || chr(31) || 'c:' || user_id || chr(31) || 'e:' || event_id || chr(31) || CASE WHEN event_type = 'purchase' THEN 'buyer' ELSE 'actor' END), 1, 12) AS key FROM events WHERE user_id IS NOT NULL""",
    "entity_conflicts": f"WITH {_ENT} SELECT key, CASE WHEN nk = 1 THEN k0 END AS kind, CASE WHEN nk > 1 THEN kv END AS kind_variants, CASE WHEN nn = 1 THEN n0 END AS name, CASE WHEN nn > 1 THEN nv END AS name_variants, sources FROM em WHERE nk > 1 OR nn > 1",
    "unresolved_edges": "SELECT 'unnamed:' || event_id AS key, 1::BIGINT AS n, true AS one_event FROM events WHERE event_id % 10 = 0",
    "edge_endings": f"""WITH {_OBS}, {_CITE}, {_ISS}, {_ENT}, r AS (SELECT 'EVIDENCED_BY' AS type, false AS s, count(*) AS n FROM ci WHERE NOT x AND target NOT IN (SELECT target FROM us) AND claim_id IN (SELECT claim_id FROM ob) UNION ALL SELECT 'FOUND_IN', false, count(*) FROM iss WHERE m[2] % 4 = 1 OR 'd:' || m[2] NOT IN (SELECT document_id FROM us) UNION ALL SELECT 'PART_OF', false, count(*) FROM us WHERE substr(document_id, 3)::BIGINT % 4 = 1
UNION ALL SELECT 'OBSERVATION_OF_SUBJECT', false, count(*) FROM ob WHERE subject NOT IN (SELECT key FROM em) UNION ALL SELECT 'LOCATED_IN', false, count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) SELECT type, 'target' AS missing, n FROM r WHERE n > 0""",
    "edge_collisions": "SELECT c_custkey % 18 <> 0 AS identical, count(*) AS n, 2::BIGINT AS most FROM customer WHERE c_custkey % 9 = 0 GROUP BY 1",
    "endpoint_labels": f"""WITH {_M}, {_OBS}, {_CITE}, {_ISS}, {_ENT}, r AS (SELECT 'OBSERVATION_OF_SUBJECT' AS type, 'Observation' AS src_label, 'Entity' AS dst_label, count(*) AS n FROM ob WHERE subject IN (SELECT key FROM em) UNION ALL SELECT 'EVIDENCED_BY', 'Observation', 'Source', count(*) FROM ci WHERE x AND claim_id IN (SELECT claim_id FROM ob)
UNION ALL SELECT 'PLACEHOLDER_FOR', 'Entity', 'Event', count(*) FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'FOUND_IN', 'Issue', 'Document', count(*) FROM iss WHERE 'd:' || m[2] IN (SELECT document_id FROM us) UNION ALL SELECT 'CONCERNS_METRIC', 'Issue', 'Metric', count(*) FROM iss
UNION ALL SELECT 'DISTINCT_FROM', 'Metric', 'Metric', count(*) FROM metric_dim a JOIN metric_dim b ON a.group_id = b.group_id AND a.metric_id < b.metric_id) SELECT * FROM r WHERE n > 0""",
    "load_reconciliation": """SELECT 'missing' AS "check", count(*) FILTER (WHERE o_orderkey % 11 = 0) AS n FROM orders UNION ALL SELECT 'unexpected', count(*) FILTER (WHERE o_orderkey % 101 = 0) FROM orders UNION ALL SELECT 'repeated', count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 17 = 0) FROM orders
UNION ALL SELECT 'changed', count(*) FILTER (WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 = 0 AND floor(o_totalprice) <> 0) FROM orders""",
    "repeated_load": f"""WITH {_ENT}, k AS (SELECT key FROM em UNION ALL SELECT 'unnamed:' || event_id FROM events WHERE event_id % 10 = 0), r AS (SELECT key, CASE WHEN key LIKE 'c:%' THEN 'run-0001' ELSE 'run-0000' END AS run FROM k WHERE key LIKE 'c:%' OR length(key) % 2 = 0)
SELECT load, run, count(*) AS n, count(*) AS n_keys FROM r CROSS JOIN (VALUES ('first'), ('second')) l(load) GROUP BY load, run""",
    "fact_sources": f"WITH {_OBS}, {_CITE} SELECT claim_id, metric_id, period_key, ci.target AS passage_id, ci.document_id, ci.q AS quote, evidence_index FROM ob JOIN ci USING (claim_id) JOIN us ON us.target = ci.target",
    "period_comparison": f"""WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY metric_id, period_key ORDER BY claim_id) AS r FROM ob)
SELECT metric_id, period_key, count(*) AS n, count(DISTINCT subject) AS n_subjects, count(DISTINCT value) AS n_values, count(*) FILTER (WHERE warned) AS n_warned, min(value) AS low, max(value) AS high, string_agg(claim_id, ',' ORDER BY claim_id) FILTER (WHERE r <= 3) AS handles FROM r GROUP BY ALL""",
    "passage_search": r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS t FROM documents WHERE doc_id IS NOT NULL), q AS (SELECT unnest(['the', 'license', 'is']) AS w),
f AS (SELECT doc_id, len(t) AS n, w, len(list_filter(t, lambda x: x = w)) AS f FROM t CROSS JOIN q), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t), d AS (SELECT w, count(*) FILTER (WHERE f > 0) AS df FROM f GROUP BY w)
SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN d USING (w) CROSS JOIN s GROUP BY doc_id HAVING sum(f) > 0 ORDER BY score DESC, doc_id LIMIT 10""",
    "events_between": """WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS o, CAST(ts AS DATE) + (user_id % 5)::INTEGER AS a FROM events), m AS (SELECT *, coalesce(o BETWEEN DATE '2024-01-08' AND DATE '2024-01-12', false) AS x, coalesce(a BETWEEN DATE '2024-01-08' AND DATE '2024-01-12', false) AS y FROM e)
SELECT event_id, event_type, CASE WHEN x AND y THEN 'both' WHEN x THEN 'occurred_on' ELSE 'announced_on' END AS matched FROM m WHERE x OR y""",
    "counter_evidence": f"""WITH {_OBS}, {_CITE} SELECT 'd:' || l_suppkey AS document_id, l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_partkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS severity, CASE WHEN l_partkey % 4 = 0 THEN 'counter_evidence' ELSE 'warning_only' END AS kind FROM lineitem
WHERE l_returnflag = 'R' AND 'd:' || l_suppkey IN (SELECT document_id FROM ev JOIN ob USING (claim_id) WHERE NOT x AND metric_id = 'net_revenue' AND period_key = '1996Q2')""",
    "evidence_scope": f"""WITH {_M}, {_OBS}, {_CITE} SELECT m.metric_id, (SELECT count(*) FROM ob WHERE ob.metric_id = m.metric_id) AS n_observations, (SELECT count(DISTINCT document_id) FROM ob JOIN ev USING (claim_id) WHERE NOT x AND ob.metric_id = m.metric_id) AS n_documents,
(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND ['net_revenue', 'open_orders', 'return_rate', 'refund_total'][l_partkey % 4 + 1] = m.metric_id) AS n_issues FROM metric_dim m""",
    "metric_catalog": f"""WITH {_M}, {vocabulary.values('formula')}, {_OBS} SELECT metric_id, label, unit, (SELECT max(version) FROM formula_dim f WHERE f.metric_id = m.metric_id) AS formula, (SELECT count(*) FROM formula_dim f WHERE f.metric_id = m.metric_id) AS n_versions,
(SELECT count(*) FROM ob WHERE ob.metric_id = m.metric_id) AS n, row_number() OVER (ORDER BY metric_id) AS place, true AS truncated FROM metric_dim m ORDER BY metric_id LIMIT 5""",
    "story_subgraph": f"""WITH {_OBS}, {_CITE}, o AS (SELECT * FROM ob WHERE metric_id IN ('net_revenue', 'open_orders') AND period_key IN ('1996Q1', '1996Q2', '1997Q3')), c AS (SELECT ci.* FROM ci JOIN o USING (claim_id)),
r AS (SELECT 'edge HAS_OBSERVATION' AS what, count(*) AS n FROM o UNION ALL SELECT 'edge OBSERVATION_OF_SUBJECT', count(*) FROM o UNION ALL SELECT 'edge EVIDENCED_BY', count(*) FROM c UNION ALL SELECT 'node Observation', count(*) FROM o UNION ALL SELECT 'node Metric', count(DISTINCT metric_id) FROM o
UNION ALL SELECT 'node Entity', count(DISTINCT subject) FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer UNION SELECT user_id FROM events) UNION ALL SELECT 'node Passage', count(DISTINCT target) FROM c WHERE NOT x AND target IN (SELECT target FROM us) UNION ALL SELECT 'node Source', count(DISTINCT target) FROM c WHERE x) SELECT * FROM r WHERE n > 0""",
    "refusals_mirrored": """SELECT 'mirrored' AS what, count(*) AS n FROM orders WHERE o_orderkey % 12 = 0 HAVING count(*) > 0 UNION ALL SELECT 'unmirrored', count(*) FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 HAVING count(*) > 0 UNION ALL SELECT 'refused but observed', count(*) FROM orders WHERE o_orderkey % 6 = 0""",
    "field_agreement": """SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'metric_id' WHEN o_orderkey % 5 = 0 THEN 'period_key' WHEN o_orderkey % 3 = 0 THEN 'value' ELSE 'agree' END AS first_difference, count(*) AS n FROM orders GROUP BY 1""",
    "cited_only": """WITH p AS (SELECT 'd:' || s_suppkey AS d, 'd:' || s_suppkey || '#p' || o AS p FROM supplier CROSS JOIN range(20) r(o) WHERE o <> 3), c AS (SELECT DISTINCT 'd:' || l_suppkey AS d, 'd:' || l_suppkey || '#p' || (l_partkey % 20) AS p FROM lineitem WHERE l_linenumber <> 4 AND l_orderkey % 2 = 0)
SELECT d AS document_id, state, count(*) AS n FROM (SELECT d, CASE WHEN p IN (SELECT p FROM c) THEN 'cited' ELSE 'uncited' END AS state FROM p UNION ALL SELECT d, 'no passage' FROM c WHERE p NOT IN (SELECT p FROM p)) x GROUP BY ALL""",
    "header_index": """WITH l AS (SELECT l_orderkey AS filing, 'f' || l_linenumber || '.htm' AS n, (l_orderkey + l_linenumber) % 5 <> 0 AS h, (l_orderkey + l_linenumber) % 7 <> 0 AS i, l_partkey % 4 = 0 AS up, l_partkey % 3 = 0 AS main FROM lineitem),
h AS (SELECT filing, n, bool_or(main) AS main FROM l WHERE h GROUP BY ALL), i AS (SELECT DISTINCT filing, CASE WHEN up THEN upper(n) ELSE n END AS n FROM l WHERE i),
a AS (SELECT filing, 'missing_in_index' AS anomaly FROM h WHERE (filing, n) NOT IN (SELECT (filing, n) FROM i) UNION ALL SELECT filing, 'missing_in_header' FROM i WHERE (filing, n) NOT IN (SELECT (filing, n) FROM h)
UNION ALL SELECT filing, 'case_collision' FROM (SELECT filing, n FROM h UNION SELECT filing, n FROM i) u GROUP BY filing, lower(n) HAVING count(*) > 1
UNION ALL SELECT filing, CASE WHEN count(*) FILTER (WHERE main) = 0 THEN 'no_main' ELSE 'several_mains' END FROM h GROUP BY filing HAVING count(*) FILTER (WHERE main) <> 1) SELECT filing, anomaly, count(*) AS n FROM a GROUP BY ALL""",
    "property_keys": f"""WITH {_M}, {_OBS}, {_CITE}, {_ISS}, {_ENT}, x AS (SELECT 'Metric' AS label, unnest(['label', 'unit']) AS name, count(*) AS n FROM metric_dim UNION ALL SELECT 'Observation', unnest(['metric', 'period', 'value']), count(*) FROM ob UNION ALL SELECT 'Event', 'type', count(event_type) FROM events UNION ALL SELECT 'Event', 'occurred_on', count(ts) FROM events
UNION ALL SELECT 'Event', 'announced_on', count(*) FILTER (WHERE ts IS NOT NULL AND user_id IS NOT NULL) FROM events UNION ALL SELECT 'Event', 'prop_k', count(json_extract_string(props, '$.k')) FROM events UNION ALL SELECT 'Entity', 'kind', (SELECT count(*) FROM em WHERE nk = 1) + (SELECT count(*) FROM events WHERE event_id % 10 = 0)
UNION ALL SELECT 'Entity', 'kind_variants', count(*) FROM em WHERE nk > 1 UNION ALL SELECT 'Entity', 'name', count(*) FROM em WHERE nn = 1 UNION ALL SELECT 'Entity', 'name_variants', count(*) FROM em WHERE nn > 1 UNION ALL SELECT 'Passage', 'ordinal', count(*) FROM us UNION ALL SELECT 'Issue', 'code', count(*) FROM iss),
l AS (SELECT 'Metric' AS label, count(*) AS n FROM metric_dim UNION ALL SELECT 'Observation', count(*) FROM ob UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT 'Entity', (SELECT count(*) FROM em) + (SELECT count(*) FROM events WHERE event_id % 10 = 0) UNION ALL SELECT 'Passage', count(*) FROM us UNION ALL SELECT 'Document', count(DISTINCT document_id) FROM us
UNION ALL SELECT 'Source', count(DISTINCT target) FROM ci WHERE x UNION ALL SELECT 'Issue', count(*) FROM iss) SELECT * FROM x WHERE n > 0 UNION ALL SELECT label, unnest(['run_id', 'projection']), n FROM l WHERE n > 0""",
}

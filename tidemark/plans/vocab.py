"""Vocabulary queries over hierarchies, aliases, versions and claims that the tables hold.

Part types are a hierarchy by their words, nations and regions another, with a cycle planted to be found.
Artifacts are the lines of orders, claims are the orders. The SQL is told apart from the frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tables, vocabulary
from ..sources.shared import cut
from ..sources.tables import read
from . import vocabulary as dims


def _is_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_type", " ")
    types = read(spark, sf_dir, "part").where("p_type IS NOT NULL").select(words.alias("w")).distinct()
    at = F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k")
    steps = types.select("w", at).select(F.array_join(F.slice("w", 1, F.col("k")), " ").alias("child"), F.when(F.col("k") == 1, "part").otherwise(F.array_join(F.expr("slice(w, 1, k - 1)"), " ")).alias("parent"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    planted = spark.createDataFrame([("loop a", "loop b"), ("loop b", "loop c"), ("loop c", "loop a"), ("loop c", "part")], "child string, parent string")
    return steps.unionByName(nations.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))).unionByName(nations.select(F.col("r_name").alias("child"), F.lit("world").alias("parent"))).unionByName(planted).distinct()


def type_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of is_a at any depth, cycles ended."""
    return vocabulary.ancestors(_is_a(spark, sf_dir)).select("child", "ancestor", F.col("steps").cast("long").alias("steps"))


def type_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that are their own ancestors."""
    return vocabulary.ancestors(_is_a(spark, sf_dir)).where("child = ancestor").select("child")


def part_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces (labels, ids, words) of part types to their concepts, ambiguous ones told."""
    parts = read(spark, sf_dir, "part").where("p_type IS NOT NULL")
    surfaces = F.concat(F.array(F.lower("p_type"), F.lower(F.concat(F.lit("type:"), F.regexp_replace("p_type", " ", "_")))), F.split(F.lower("p_type"), " "))
    each = parts.select(F.col("p_type").alias("concept"), F.explode(F.array_distinct(surfaces)).alias("surface")).where("length(surface) >= 3")
    return each.groupBy("surface").agg(F.count_distinct("concept").alias("n_concepts"), F.min("concept").alias("first_concept")).withColumn("ambiguous", F.col("n_concepts") > 1)


def concept_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of a category and of the categories below it."""
    closure = vocabulary.ancestors(_is_a(spark, sf_dir))
    return closure.groupBy(F.col("ancestor").alias("category")).agg(F.count_distinct("child").alias("n_concepts"), F.min("child").alias("first_concept"))


def order_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every shipped line the order that its supplier's part was last ordered with by then: an as-of lookup without a range join."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("ordered"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped"))
    facts = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "shipped")
    versions = orders.select("o_custkey", F.col("ordered").alias("since"), F.col("o_orderkey").alias("version"))
    return vocabulary.in_force(facts, versions, "o_custkey", "shipped", "since", "version").select("l_orderkey", "l_linenumber", F.col("version_in_force").alias("order_in_force"))


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a customer's orders whose forty days meet; every ninth has no end."""
    rows = read(spark, sf_dir, "orders").withColumn("since", F.col("o_orderdate").cast("date")).withColumn("until", F.when(F.col("o_orderkey") % 9 != 0, F.date_add("since", 40)))
    return vocabulary.overlaps(rows, "o_custkey", "o_orderkey", "since", "until").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_overlaps"), F.min("left").alias("first_left"), F.max("right").alias("last_right"))


RULES = [
    {"id": "machine", "when": {"kind_in": ["xbrl", "asset"]}, "decision": "exclude", "reason": "NO_TEXT"},
    {"id": "media", "when": {"media_not": "text/html"}, "decision": "exclude", "reason": "NO_TEXT"},
    {"id": "certificates", "when": {"role_in": ["EX31-01", "ex32-01"]}, "decision": "exclude", "reason": "CERTIFICATE"},
    {"id": "main", "when": {"kind": "primary", "media": "text/html"}, "decision": "include", "reason": "MAIN_TEXT"},
    {"id": "people", "when": {"role_starts": "ex10-", "described_by": ["plan", "award"]}, "decision": "include", "reason": "AGREEMENT"},
    {"id": "capital", "when": {"role_starts": "ex10-", "items_any": ["1.01", "2.03"]}, "decision": "include", "reason": "AGREEMENT"},
    {"id": "small", "when": {"role_starts": "ex10-", "size_most": 4000}, "decision": "exclude", "reason": "TOO_SMALL"},
    {"id": "governance", "when": {"role_starts_any": ["ex3-", "ex4-"], "form_in": ["10-K", "8-K"]}, "decision": "include", "reason": "GOVERNANCE"},
    {"id": "rest", "when": {"kind": "exhibit"}, "decision": "needs_review", "reason": "UNCLASSIFIED"},
]


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(artifact_id, filing_id, kind, media, role, description, items, form, size): one of each order line."""
    lines = read(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_partkey") + F.col("l_linenumber")) % 10)
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    kind = pick(F.col("k"), "primary", "exhibit", "exhibit", "exhibit", "exhibit", "exhibit", "exhibit", "xbrl", "asset", "other")
    role = pick(F.col("k"), "primary", "ex31-01", "EX10-01", "ex10-02", "ex10-03", "ex3-01", "ex21-01", "ex101", None, None)
    rows = lines.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("artifact_id"), F.col("l_orderkey").alias("filing_id"), kind.alias("kind"),
        F.when(F.col("l_suppkey") % 7 != 0, "text/html").alias("media"), role.alias("role"), pick(F.col("l_suppkey") % 4, "Equity Plan", "lease", "Award letter", None).alias("description"),
        F.when(F.col("l_linenumber") != 5, F.array(pick(F.col("l_orderkey") % 3, "1.01", "2.02", "9.01"))).alias("items"), F.when(F.col("o_orderpriority").startswith("1"), "10-K").when(F.col("o_orderpriority").startswith("2"), "8-K").otherwise("4").alias("form"),
        F.floor("l_extendedprice").cast("long").alias("size"), F.col("l_linenumber").alias("sequence"),
    )


def artifact_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every artifact's first matching rule of a list given as data, with the size floor."""
    return vocabulary.decided(artifacts(spark, sf_dir), RULES, ("exclude", "NEEDS_REVIEW"), 2000).select("artifact_id", "decision", "reason", "rule")


def filing_xbrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filings with the sorted ids of their machine-read artifacts, and how many artifacts need review."""
    rows = vocabulary.decided(artifacts(spark, sf_dir), RULES, ("exclude", "NEEDS_REVIEW"), 2000)
    return rows.groupBy("filing_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == "xbrl", F.col("artifact_id")))), ",").alias("xbrl_ids"), F.count_if(F.col("decision") == "needs_review").alias("n_review"), F.count(F.lit(1)).alias("n"),
    )


def artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered list of tests on type, name, sequence and form, with roles made from the type."""
    rows = artifacts(spark, sf_dir)
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    k = (F.col("filing_id") + F.col("sequence")) % 9
    printed, name = pick(k, "EX-10.1", "EX-31.02", "EX-101.INS", "GRAPHIC", "10-K/A", "EX-99", "ex-3.i ", "XML", " "), pick(k, "a.htm", "b.htm", "c.xml", "d.jpg", "e.htm", "R4.htm", "f.htm", "g_cal.xml", "h.htm")
    form = F.concat(F.col("form"), F.when(F.col("filing_id") % 2 == 0, "/A").otherwise(""))
    kind, role, low = classified(printed, name, F.col("sequence"), form)
    return rows.select("artifact_id", kind.alias("kind"), role.alias("role"), low.alias("low_priority"), in_forms(form, ["10-K"], True).alias("a_report"), in_forms(form, ["10-K"], False).alias("an_original"))


def in_forms(form: Column, forms: list[str], amendments: bool) -> Column:
    """Whether a form is one of a list, case and space aside; amendments fold into their form if asked for."""
    bare = F.upper(F.trim(form))
    return F.regexp_replace(bare, "/A$", "").isin(*forms) if amendments else bare.isin(*forms)


def role_of(printed: Column) -> Column:
    """Role of an exhibit's type: ex, number, and a two-digit minor number; null for another type."""
    body = F.regexp_extract(F.upper(F.trim(printed)), "^EX-(.+)$", 1)
    major, minor = F.regexp_replace(F.lower(F.substring_index(body, ".", 1)), "[^a-z0-9]", ""), F.trim(F.regexp_extract(body, r"\.(.*)$", 1))
    digits = F.when(minor.rlike(r"^\d+$"), F.when(F.length(minor) < 2, F.lpad(minor, 2, "0")).otherwise(minor)).otherwise(F.regexp_replace(F.lower(minor), "[^a-z0-9]", ""))
    return F.when(major != "", F.concat(F.lit("ex"), major, F.when(digits != "", F.concat(F.lit("-"), digits)).otherwise("")))


def classified(printed: Column, name: Column, sequence: Column, form: Column) -> tuple[Column, Column, Column]:
    """(kind, role, low priority) by the first test that holds: rendering, machine-read, asset, exhibit, the form itself, first in sequence, other."""
    bare, file = F.upper(F.trim(printed)), F.lower(F.trim(name))
    rendering = file.isin("show.js", "report.css", "filingsummary.xml", "metalinks.json") | file.rlike(r"^(r\d+\.htm|.*-xbrl\.zip|.*_htm\.xml)$")
    machine = bare.rlike(r"^(EX-100\.|EX-101\.|EX-99\.SDR)") | file.rlike(r"(_cal\.xml|_def\.xml|_lab\.xml|_pre\.xml|\.xsd)$")
    asset, exhibit = bare.isin("GRAPHIC", "ZIP", "PDF", "EXCEL", "JSON", "GIF", "JPEG"), bare.startswith("EX-")
    main = ((bare != "") & (bare == F.upper(F.trim(form)))) | (sequence == 1)
    kind = F.when(rendering, "render_artifact").when(machine, "xbrl").when(asset, "asset").when(exhibit, "exhibit").when(main, "primary").otherwise("other")
    role = F.when(kind.isin("xbrl", "exhibit"), role_of(printed)).when(kind == "primary", "primary")
    low = kind.isin("render_artifact", "xbrl", "asset", "other") | F.coalesce((kind == "exhibit") & role.rlike(r"^ex(31|32)(-|$)"), F.lit(False))
    return kind, role, low


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the orders: metric, subject, unit, period, value, lane, evidence, some of them wrong in one way or another."""
    rows = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 12).withColumn("day", F.col("o_orderdate").cast("date"))
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (c + 1).cast("int"))
    k, first = F.col("k"), F.trunc("day", "quarter")
    metric = pick(F.col("o_custkey") % 5, "net_revenue", "open_orders", "return_rate", "order_count", "unheard_of")
    return rows.select(
        F.col("o_orderkey").alias("claim_id"), metric.alias("metric_id"), F.when(k != 1, F.col("o_custkey")).alias("subject_id"), pick(k, "USD", "USD", "percent", "orders", "USD", "percent", "orders", "USD", "percent", "orders", "EUR", None).alias("unit"),
        F.when(k != 2, first).alias("period_start"), F.when(k == 3, F.date_sub(first, 1)).otherwise(F.last_day(F.add_months(first, 2))).alias("period_end"), F.when(F.col("o_orderkey") % 10 == 0, F.col("day")).alias("instant_date"), F.date_add("day", 30).alias("carrier_date"),
        F.when(k == 4, -F.col("o_totalprice")).when(k == 5, F.lit(130.0)).otherwise(F.col("o_totalprice")).alias("value"), pick(k, "table", "table", "table", "table", "table", "table", "table", "table", "table", "narrative", "guess", "table").alias("lane"),
        F.when(k == 6, "calculated").otherwise("reported").alias("assertion"), F.when((k == 6) & (F.col("o_orderkey") % 24 == 6), "net_revenue_v1").alias("formula_version"), F.when(k != 7, F.concat(F.lit("p"), F.col("o_custkey"))).alias("passage_id"),
    )


def claim_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes that a claim earns from its metric, period, unit, range, lane, calculation and evidence."""
    metrics = dims.frame(spark, "metric").select("metric_id", F.col("unit").alias("m_unit"), "period_type", "sign")
    formulas = dims.frame(spark, "formula").select(F.col("version").alias("formula_version"), F.col("metric_id").alias("f_metric"), F.col("valid_from").cast("date").alias("f_from"), F.coalesce(F.col("valid_to").cast("date"), F.lit("9999-12-31").cast("date")).alias("f_to"))
    rows = claims(spark, sf_dir).join(metrics, "metric_id", "left").join(formulas, "formula_version", "left")
    known, instant = F.col("m_unit").isNotNull(), F.col("instant_date").isNotNull()
    found = vocabulary.codes(
        ("UNKNOWN_METRIC", ~known), ("MISSING_SUBJECT", F.col("subject_id").isNull()), ("MISSING_UNIT", known & F.col("unit").isNull()), ("UNIT_MISMATCH", known & (F.col("unit") != F.col("m_unit"))),
        ("PERIOD_TYPE_MISMATCH", known & (instant != (F.col("period_type") == "instant"))), ("MISSING_PERIOD_START", ~instant & F.col("period_start").isNull()), ("PERIOD_REVERSED", ~instant & (F.col("period_start") > F.col("period_end"))),
        ("ENDS_AFTER_CARRIER", (F.col("assertion") == "reported") & (F.coalesce("instant_date", "period_end") > F.col("carrier_date"))), ("NEGATIVE_VALUE", (F.col("sign") == "positive") & (F.col("value") < 0)),
        ("PERCENT_OUT_OF_RANGE", (F.col("m_unit") == "percent") & (F.col("unit") == "percent") & ~F.col("value").between(-100, 100)), ("UNKNOWN_LANE", ~F.col("lane").isin("table", "narrative")),
        ("CALCULATION_WITHOUT_FORMULA", (F.col("assertion") == "calculated") & F.col("formula_version").isNull()), ("FORMULA_OF_ANOTHER_METRIC", F.col("f_metric").isNotNull() & (F.col("f_metric") != F.col("metric_id"))),
        ("FORMULA_NOT_IN_FORCE", F.col("f_from").isNotNull() & ~F.coalesce("instant_date", "period_end").between(F.col("f_from"), F.col("f_to"))), ("NO_EVIDENCE", F.col("passage_id").isNull()),
    )
    return rows.select("claim_id", F.array_join(found, ",").alias("codes"), F.size(found).cast("long").alias("n"))


def definition_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that repeat, point nowhere, loop, or whose alias hits two that must stay apart."""
    edges = cut(_is_a(spark, sf_dir))
    parts = read(spark, sf_dir, "part")
    row = lambda frame, code, subject: frame.select(F.lit(code).alias("code"), subject.cast("string").alias("subject"))
    twice = row(vocabulary.repeated(parts, "p_name"), "REPEATED_LABEL", F.col("p_name"))
    loops = row(vocabulary.ancestors(edges).where("child = ancestor"), "CYCLE", F.col("child"))
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("p")).distinct()
    nowhere = row(vocabulary.missing(lines, "p", parts, "p_partkey"), "UNKNOWN_REFERENCE", F.col("p"))
    # aliases (first words of names) that stand for parts of two brands of one manufacturer: groups that must stay apart
    alias = parts.select(F.substring_index("p_name", " ", 1).alias("alias"), F.col("p_brand").alias("member"), F.substring("p_brand", 1, 7).alias("grp")).distinct()
    both = alias.groupBy("alias", "grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.unionByName(loops).unionByName(nowhere).unionByName(row(both, "ALIAS_HITS_GROUP_TWICE", F.concat_ws("|", "alias", "grp")))


def endpoint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose ends aren't of an admitted type or one below it."""
    closure = vocabulary.ancestors(_is_a(spark, sf_dir)).select("child", "ancestor")
    admitted = spark.createDataFrame([("LOCATED_IN", "AMERICA"), ("LOCATED_IN", "ASIA"), ("LOCATED_IN", "REGION_0"), ("LOCATED_IN", "REGION_1")], "relation string, target_type string")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("child"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
    allowed = closure.join(admitted, F.col("ancestor") == F.col("target_type")).select("child").distinct()
    return rows.join(allowed, "child", "left_anti").groupBy(F.col("child").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of tables that don't depend on the order of rows, and rows counted."""
    one = lambda name, key: vocabulary.snapshot(read(spark, sf_dir, name).select(*_SNAPSHOT[name]), F.col(key) % 16).select(F.lit(name).alias("name"), "digest", "n")
    return one("nation", "n_nationkey").unionByName(one("part", "p_partkey")).unionByName(one("customer", "c_custkey"))


_SNAPSHOT = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type"], "customer": ["c_custkey", "c_name", "c_mktsegment"]}


def alias_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of a passage with the reasons, siblings that must be told apart added, nothing removed."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    surfaces = spark.createDataFrame(_SURFACES, "surface string, metric_id string")
    hits = tables.label_surfaces(docs.select(F.col("doc_id").alias("label"), F.lower(text.folded(F.col("text"))).alias("normal")), surfaces)
    said = hits.select(F.col("label").alias("doc_id"), F.col("metric_id").alias("concept"), F.concat(F.lit("surface:"), "surface").alias("reason"))
    apart = spark.createDataFrame([("license", "rights"), ("rights", "license"), ("contact", "address")], "concept string, sibling string")
    siblings = said.select("doc_id", "concept").distinct().join(apart, "concept").select("doc_id", F.col("sibling").alias("concept"), F.concat(F.lit("distinct_from:"), "concept").alias("reason"))
    return said.unionByName(siblings).groupBy("doc_id", "concept").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


_SURFACES = [("mit license", "license"), ("license", "license"), ("all rights reserved", "rights"), ("e-mail", "contact"), ("mail", "contact"), ("tel", "contact")]


def lane_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage and lane gets exactly one reason, by precedence of what is known of it."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    surfaces = spark.createDataFrame([(s, c) for s, c in _SURFACES], "surface string, metric_id string")
    hits = tables.label_surfaces(docs.where("text IS NOT NULL").select(F.col("doc_id").alias("label"), F.lower(text.folded(F.col("text"))).alias("normal")), surfaces)
    ambiguous = F.col("surface") == "mail"
    known = hits.groupBy(F.col("label").alias("doc_id")).agg(F.max(~ambiguous).alias("sure"), F.max(ambiguous).alias("unsure"))
    kind = F.when(F.col("source").rlike("[05]$"), "table").otherwise("narrative")
    of_type = F.coalesce("lang", F.lit("none"))
    lanes = F.explode(F.array(F.struct(F.lit("tables").alias("lane"), F.lit("table").alias("kind"), F.lit(True).alias("needs")), F.struct(F.lit("narrative").alias("lane"), F.lit("narrative").alias("kind"), F.lit(True).alias("needs")), F.struct(F.lit("events").alias("lane"), F.lit("narrative").alias("kind"), F.lit(False).alias("needs")))).alias("l")
    rows = docs.join(known, "doc_id", "left").select("doc_id", kind.alias("passage_kind"), of_type.alias("document_type"), F.coalesce("sure", F.lit(False)).alias("sure"), F.coalesce("unsure", F.lit(False)).alias("unsure"), F.coalesce(F.lower(F.substring_index("text", "\n", 1)).contains("result"), F.lit(False)).alias("headed"), lanes)
    reason = (
        F.when(F.col("passage_kind") != F.col("l.kind"), "UNSUPPORTED_PASSAGE_KIND").when(F.col("document_type") == "fr", "CONTRACT_BOILERPLATE").when(F.col("document_type") == "none", "UNSUPPORTED_DOCUMENT_TYPE")
        .when(F.col("sure") & (F.col("l.lane") == "tables"), "TABLE_LABEL").when(F.col("sure"), "EXACT_ALIAS").when(F.col("unsure"), "AMBIGUOUS_ALIAS").when(F.col("headed"), "HEADING_PRIOR").when(~F.col("l.needs"), "DOCUMENT_TYPE_PRIOR").otherwise("NO_CANDIDATE_SIGNAL")
    )
    return rows.select(F.col("l.lane").alias("lane"), reason.alias("reason")).groupBy("lane", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        type_ancestors, type_cycles, part_surfaces, concept_categories, order_in_force, interval_overlaps, artifact_decisions, filing_xbrl, artifact_kinds, claim_violations, definition_violations, endpoint_violations,
        vocabulary_snapshot, alias_scopes, lane_reasons,
    )
}

_ISA = """
isa AS (SELECT DISTINCT array_to_string(w[:k], ' ') AS child, CASE WHEN k = 1 THEN 'part' ELSE array_to_string(w[:k - 1], ' ') END AS parent FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part WHERE p_type IS NOT NULL) t) x
  UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'world' FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT * FROM (VALUES ('loop a', 'loop b'), ('loop b', 'loop c'), ('loop c', 'loop a'), ('loop c', 'part')) v),
up AS (SELECT child, parent AS ancestor, 1 AS steps FROM isa UNION SELECT up.child, isa.parent, steps + 1 FROM up JOIN isa ON up.ancestor = isa.child WHERE steps < 12),
anc AS (SELECT child, ancestor, min(steps) AS steps FROM up GROUP BY ALL)"""
_ART = """
art AS (SELECT l_orderkey || ':' || l_linenumber AS artifact_id, l_orderkey AS filing_id, (l_partkey + l_linenumber) % 10 AS k, l_suppkey % 7 = 0 AS no_media, l_suppkey % 4 AS d, l_linenumber AS seq, CASE WHEN l_linenumber <> 5 THEN ['1.01', '2.02', '9.01'][l_orderkey % 3 + 1] END AS item,
  CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' WHEN o_orderpriority LIKE '2%' THEN '8-K' ELSE '4' END AS form, floor(l_extendedprice)::BIGINT AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
rule AS (SELECT *, CASE WHEN k IN (7, 8) THEN 'machine' WHEN no_media THEN 'media' WHEN k = 1 THEN 'certificates' WHEN k = 0 THEN 'main' WHEN k IN (2, 3, 4) AND d IN (0, 2) THEN 'people' WHEN k IN (2, 3, 4) AND item = '1.01' THEN 'capital' WHEN k IN (2, 3, 4) AND size <= 4000 THEN 'small'
  WHEN k = 5 AND form IN ('10-K', '8-K') THEN 'governance' WHEN k BETWEEN 1 AND 6 THEN 'rest' END AS rule FROM art),
dec0 AS (SELECT *, CASE WHEN rule IN ('machine', 'media', 'certificates', 'small') THEN 'exclude' WHEN rule = 'rest' THEN 'needs_review' WHEN rule IS NULL THEN 'exclude' ELSE 'include' END AS d0,
  CASE rule WHEN 'machine' THEN 'NO_TEXT' WHEN 'media' THEN 'NO_TEXT' WHEN 'certificates' THEN 'CERTIFICATE' WHEN 'main' THEN 'MAIN_TEXT' WHEN 'people' THEN 'AGREEMENT' WHEN 'capital' THEN 'AGREEMENT' WHEN 'small' THEN 'TOO_SMALL' WHEN 'governance' THEN 'GOVERNANCE' WHEN 'rest' THEN 'UNCLASSIFIED' ELSE 'NEEDS_REVIEW' END AS r0 FROM rule),
decision AS (SELECT *, CASE WHEN d0 = 'include' AND size < 2000 THEN 'exclude' ELSE d0 END AS decision, CASE WHEN d0 = 'include' AND size < 2000 THEN 'BELOW_TEXT_FLOOR' ELSE r0 END AS reason FROM dec0)"""
_FOLD = "translate(lower(text), '—–−“”‘’\"''', '---')"


def _hits(pairs: list[tuple[str, str]]) -> str:
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"s(surface, concept) AS (VALUES {values}), hit AS (SELECT DISTINCT doc_id, concept, surface FROM (SELECT doc_id, {_FOLD} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d JOIN s ON contains(t, surface) AND regexp_matches(' ' || t || ' ', '[^a-z0-9]' || surface || '[^a-z0-9]'))"


ORACLES = {
    "type_ancestors": f"WITH RECURSIVE {_ISA} SELECT child, ancestor, steps::BIGINT AS steps FROM anc",
    "type_cycles": f"WITH RECURSIVE {_ISA} SELECT child FROM anc WHERE child = ancestor",
    "part_surfaces": """WITH c AS (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL), s AS (SELECT p_type AS concept, lower(p_type) AS surface FROM c UNION SELECT p_type, 'type:' || lower(replace(p_type, ' ', '_')) FROM c UNION SELECT p_type, unnest(string_split(lower(p_type), ' ')) FROM c)
SELECT surface, count(*) AS n_concepts, min(concept) AS first_concept, count(*) > 1 AS ambiguous FROM s WHERE length(surface) >= 3 GROUP BY surface""",
    "concept_categories": f"WITH RECURSIVE {_ISA} SELECT ancestor AS category, count(*) AS n_concepts, min(child) AS first_concept FROM anc GROUP BY ancestor",
    "order_in_force": """WITH f AS (SELECT l_orderkey, l_linenumber, o_custkey, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey), v AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, max(o_orderkey) AS version FROM orders GROUP BY ALL)
SELECT l_orderkey, l_linenumber, version AS order_in_force FROM f ASOF LEFT JOIN v ON f.o_custkey = v.o_custkey AND f.d >= v.s""",
    "interval_overlaps": """WITH i AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) + 40 ELSE DATE '9999-12-31' END AS u FROM orders),
p AS (SELECT a.o_custkey, CASE WHEN (a.s, a.o_orderkey) < (b.s, b.o_orderkey) THEN a.o_orderkey ELSE b.o_orderkey END AS l, CASE WHEN (a.s, a.o_orderkey) < (b.s, b.o_orderkey) THEN b.o_orderkey ELSE a.o_orderkey END AS r FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND greatest(a.s, b.s) <= least(a.u, b.u))
SELECT o_custkey, count(*) AS n_overlaps, min(l) AS first_left, max(r) AS last_right FROM p GROUP BY o_custkey""",
    "artifact_decisions": f"WITH {_ART} SELECT artifact_id, decision, reason, rule FROM decision",
    "filing_xbrl": f"WITH {_ART} SELECT filing_id, coalesce(string_agg(artifact_id, ',' ORDER BY artifact_id) FILTER (WHERE k = 7), '') AS xbrl_ids, count(*) FILTER (WHERE decision = 'needs_review') AS n_review, count(*) AS n FROM decision GROUP BY filing_id",
    "artifact_kinds": f"""WITH {_ART}, a AS (SELECT *, (filing_id + seq) % 9 AS j FROM art)
SELECT artifact_id, CASE WHEN j = 5 THEN 'render_artifact' WHEN j IN (2, 7) THEN 'xbrl' WHEN j = 3 THEN 'asset' WHEN j IN (0, 1, 6) THEN 'exhibit' WHEN j = 4 AND form = '10-K' AND filing_id % 2 = 0 OR seq = 1 THEN 'primary' ELSE 'other' END AS kind,
  CASE j WHEN 5 THEN NULL WHEN 2 THEN 'ex101-ins' WHEN 0 THEN 'ex10-01' WHEN 1 THEN 'ex31-02' WHEN 6 THEN 'ex3-i' ELSE CASE WHEN j IN (4, 8) AND (j = 4 AND form = '10-K' AND filing_id % 2 = 0 OR seq = 1) THEN 'primary' END END AS role,
  NOT (j IN (0, 6) OR j IN (4, 8) AND (j = 4 AND form = '10-K' AND filing_id % 2 = 0 OR seq = 1)) AS low_priority, form = '10-K' AS a_report, form = '10-K' AND filing_id % 2 = 1 AS an_original FROM a""",
    "claim_violations": f"""WITH {dims.values('metric')}, {dims.values('formula')}, o AS (SELECT *, o_orderkey % 12 AS k, CAST(o_orderdate AS DATE) AS d, date_trunc('quarter', o_orderdate)::DATE AS q0 FROM orders),
c AS (SELECT o_orderkey AS claim_id, k, ['net_revenue', 'open_orders', 'return_rate', 'order_count', 'unheard_of'][o_custkey % 5 + 1] AS metric_id, ['USD', 'USD', 'percent', 'orders', 'USD', 'percent', 'orders', 'USD', 'percent', 'orders', 'EUR', NULL][k + 1] AS unit, CASE WHEN k <> 2 THEN q0 END AS s,
  CASE WHEN k = 3 THEN q0 - 1 ELSE last_day((q0 + INTERVAL 2 MONTH)::DATE) END AS e, CASE WHEN o_orderkey % 10 = 0 THEN d END AS i, d + 30 AS carrier, CASE k WHEN 4 THEN -o_totalprice WHEN 5 THEN 130 ELSE o_totalprice END AS value, o_orderkey % 24 = 6 AS f FROM o),
v AS (SELECT claim_id, list_filter([CASE WHEN m.unit IS NULL THEN 'UNKNOWN_METRIC' END, CASE WHEN k = 1 THEN 'MISSING_SUBJECT' END, CASE WHEN m.unit IS NOT NULL AND c.unit IS NULL THEN 'MISSING_UNIT' END, CASE WHEN c.unit <> m.unit THEN 'UNIT_MISMATCH' END,
  CASE WHEN m.unit IS NOT NULL AND (i IS NOT NULL) <> (m.period_type = 'instant') THEN 'PERIOD_TYPE_MISMATCH' END, CASE WHEN i IS NULL AND s IS NULL THEN 'MISSING_PERIOD_START' END, CASE WHEN i IS NULL AND s > e THEN 'PERIOD_REVERSED' END, CASE WHEN k <> 6 AND coalesce(i, e) > carrier THEN 'ENDS_AFTER_CARRIER' END,
  CASE WHEN m.sign = 'positive' AND value < 0 THEN 'NEGATIVE_VALUE' END, CASE WHEN m.unit = 'percent' AND c.unit = 'percent' AND abs(value) > 100 THEN 'PERCENT_OUT_OF_RANGE' END, CASE WHEN k = 10 THEN 'UNKNOWN_LANE' END, CASE WHEN k = 6 AND NOT f THEN 'CALCULATION_WITHOUT_FORMULA' END,
  CASE WHEN f AND c.metric_id <> 'net_revenue' THEN 'FORMULA_OF_ANOTHER_METRIC' END, CASE WHEN f AND NOT coalesce(i, e) BETWEEN DATE '1990-01-01' AND DATE '1997-12-31' THEN 'FORMULA_NOT_IN_FORCE' END, CASE WHEN k = 7 THEN 'NO_EVIDENCE' END], lambda x: x IS NOT NULL) AS codes FROM c LEFT JOIN metric_dim m USING (metric_id))
SELECT claim_id, array_to_string(codes, ',') AS codes, len(codes) AS n FROM v""",
    "definition_violations": f"""WITH RECURSIVE {_ISA} SELECT 'REPEATED_LABEL' AS code, p_name AS subject FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'CYCLE', child FROM anc WHERE child = ancestor
UNION ALL SELECT DISTINCT 'UNKNOWN_REFERENCE', (l_partkey * 2)::VARCHAR FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'ALIAS_HITS_GROUP_TWICE', string_split(p_name, ' ')[1] || '|' || substr(p_brand, 1, 7) FROM part GROUP BY string_split(p_name, ' ')[1], substr(p_brand, 1, 7) HAVING count(DISTINCT p_brand) > 1""",
    "endpoint_violations": f"WITH RECURSIVE {_ISA} SELECT n_name AS target, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM anc WHERE child = n_name AND ancestor IN ('AMERICA', 'ASIA', 'REGION_0', 'REGION_1')) GROUP BY n_name",
    "alias_scopes": f"""WITH {_hits(_SURFACES)}, w AS (SELECT doc_id, concept, 'surface:' || surface AS reason FROM hit UNION SELECT doc_id, CASE concept WHEN 'license' THEN 'rights' WHEN 'rights' THEN 'license' ELSE 'address' END, 'distinct_from:' || concept FROM hit)
SELECT doc_id, concept, string_agg(reason, ',' ORDER BY reason) AS reasons FROM w GROUP BY doc_id, concept""",
    "lane_reasons": f"""WITH {_hits(_SURFACES)}, d AS (SELECT doc_id, regexp_matches(source, '[05]$') AS tab, coalesce(lang, 'none') AS typ, doc_id IN (SELECT doc_id FROM hit WHERE surface <> 'mail') AS sure, doc_id IN (SELECT doc_id FROM hit WHERE surface = 'mail') AS unsure,
  coalesce(contains(lower(string_split(text, chr(10))[1]), 'result'), false) AS headed FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT lane, CASE WHEN coalesce(tab, false) <> (lane = 'tables') THEN 'UNSUPPORTED_PASSAGE_KIND' WHEN typ = 'fr' THEN 'CONTRACT_BOILERPLATE' WHEN typ = 'none' THEN 'UNSUPPORTED_DOCUMENT_TYPE' WHEN sure THEN CASE lane WHEN 'tables' THEN 'TABLE_LABEL' ELSE 'EXACT_ALIAS' END
  WHEN unsure THEN 'AMBIGUOUS_ALIAS' WHEN headed THEN 'HEADING_PRIOR' WHEN lane = 'events' THEN 'DOCUMENT_TYPE_PRIOR' ELSE 'NO_CANDIDATE_SIGNAL' END AS reason FROM d CROSS JOIN (VALUES ('tables'), ('narrative'), ('events')) l(lane))
SELECT lane, reason, count(*) AS n FROM r GROUP BY ALL""",
}

ORACLES["vocabulary_snapshot"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS name, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest, sum(n)::BIGINT AS n FROM (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM (
SELECT {key} % 16 AS part, sha256({" || chr(31) || ".join(f"coalesce({c}::VARCHAR, '')" for c in sorted(_SNAPSHOT[name]))}) AS line FROM {name}) a GROUP BY part) b"""
    for name, key in (("nation", "n_nationkey"), ("part", "p_partkey"), ("customer", "c_custkey"))
)

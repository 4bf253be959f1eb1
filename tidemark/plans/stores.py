"""Queries that go through sources and sinks of catalogs, over texts and files made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import catalogs
from ..sources.shared import shared_folder
from ..sources.tables import read


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def submissions_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers' orders as JSON of parallel arrays of unequal length, read back as filings of two forms in a span."""
    orders = read(spark, sf_dir, "orders")
    form = F.concat(F.when(F.col("o_orderpriority").startswith("1"), "10-k").when(F.col("o_orderpriority").startswith("2"), " 8-K").otherwise("4"), F.when(F.col("o_orderkey") % 4 == 0, "/A").otherwise(""))
    rows = orders.select("o_custkey", F.struct("o_orderkey", form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed")).alias("r"))
    lists = rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list("r")).alias("r"))
    forms = F.transform("r", lambda r: r["form"])
    arrays = F.struct(F.transform("r", lambda r: r["o_orderkey"]).alias("accession"), F.when(F.col("o_custkey") % 3 == 0, F.slice(forms, 1, F.size("r") - 1)).otherwise(forms).alias("form"), F.transform("r", lambda r: r["filed"]).alias("filed"))
    texts = lists.select(F.to_json(F.struct(F.col("o_custkey").alias("company"), arrays.alias("recent"))).alias("t"))
    read_back = texts.select(F.from_json("t", "company long, recent struct<accession: array<long>, form: array<string>, filed: array<string>>").alias("j")).select("j.*")
    return catalogs.filings(read_back, ["10-K", "8-K"], "1996-01-01", "1999-12-31", True)


def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document blocks of tagged header texts."""
    lines = read(spark, sf_dir, "lineitem")
    block = F.concat(
        F.lit("<DOCUMENT>\n<TYPE>EX-"), F.col("l_linenumber"), F.lit(".1\n<SEQUENCE>"), F.col("l_partkey"), F.lit("\n<FILENAME>f"), F.col("l_suppkey"), F.lit(".htm\r\n"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("<DESCRIPTION> "), F.col("l_returnflag"), F.lit(" text\n"))).otherwise("<DESCRIPTION>\n"), F.lit("<TEXT>\n</DOCUMENT>\n"),
    )
    headers = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<SEC-HEADER>\n"), F.array_join(F.sort_array(F.collect_list(block)), "")).alias("text"))
    return catalogs.header_documents(headers, "l_orderkey")


def filing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filing's documents, its whole submission and its index header as artifacts."""
    docs = read(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("document").alias("kind"), F.floor("l_extendedprice").cast("long").alias("size"))
    whole = docs.groupBy("l_orderkey").agg(F.sum("size").alias("size")).select("l_orderkey", F.lit("full_submission").alias("kind"), "size")
    index = whole.select("l_orderkey", F.lit("index_header").alias("kind"), F.lit(0).cast("long").alias("size"))
    return docs.unionByName(whole).unionByName(index).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.count_distinct("kind").alias("n_kinds"))


def fetch_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is complete, damaged, missing or unexpected, by digest."""
    orders = read(spark, sf_dir, "orders")
    sha = lambda c: F.sha2(c.cast("string"), 256)
    expected = orders.where("o_orderkey % 9 <> 0").select("o_orderkey", sha(F.floor("o_totalprice")).alias("sha"))
    landed = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", sha(F.floor("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("sha"))
    return catalogs.fetch_plan(expected, landed, "o_orderkey").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run written whole and read back; a partial one, one written twice and one with lost rows are refused."""
    folder = _folder(spark)
    frames = {"documents": read(spark, sf_dir, "documents").select("doc_id", "lang"), "customers": read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")}
    catalogs.write_run(f"{folder}/1", frames, version="1")
    opened = catalogs.open_run(spark, f"{folder}/1")
    rows = [(name, frame.count()) for name, frame in sorted(opened.items())]

    def refused(what: str, act) -> tuple[str, int]:
        try:
            act()
        except Exception:  # whichever way it is refused
            return (what, 1)
        return (what, 0)

    rows.append(refused("refused twice", lambda: catalogs.write_run(f"{folder}/1", frames)))
    frames["customers"].write.parquet(f"{folder}/2/customers")
    rows.append(refused("refused partial", lambda: catalogs.open_run(spark, f"{folder}/2")))
    catalogs.write_run(f"{folder}/3", frames)
    frames["customers"].limit(1).write.mode("overwrite").parquet(f"{folder}/3/customers")
    rows.append(refused("refused changed", lambda: catalogs.open_run(spark, f"{folder}/3")))
    return spark.createDataFrame(rows, "what string, n long")


def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as ordered JSON lines and read back strictly."""
    folder = _folder(spark)
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    catalogs.write_lines(rows, f"{folder}/lines", "event_id")
    back = catalogs.read_lines(spark, f"{folder}/lines", rows.schema)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"), F.round(F.sum("value"), 4).alias("total"), F.max("user_id").alias("last_user"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't fit the schema kept apart, the others read."""
    folder = _folder(spark)
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    line = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "event_type'))).when(F.col("event_id") % 10 == 4, F.lit('{"event_id": "not a number"}')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    rows.select(line.alias("value")).write.text(f"{folder}/lines")
    back = catalogs.read_lines(spark, f"{folder}/lines", rows.schema, strict=False).select("event_id", "event_type", "bad")
    return back.groupBy(F.when(F.col("bad").isNotNull(), "rejected").otherwise("read").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("event_type").alias("n_types"))


def catalog_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs by key with repeats and rows without a key told, issues of the latest run only."""
    orders = read(spark, sf_dir, "orders").withColumn("key", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 3))
    kept, twice, without = catalogs.catalogued(orders.select("key", "o_orderkey", "o_totalprice"), "key", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))
    issues = orders.select(F.concat(F.lit("run-"), F.year("o_orderdate")).alias("run_id"), (F.col("o_custkey") % 20).alias("issue_id"), "o_orderkey")
    latest = catalogs.of_latest_run(issues)
    named, _, _ = catalogs.catalogued(latest, "issue_id", F.col("o_orderkey"))
    count = lambda frame, what, total: frame.agg(F.count(F.lit(1)).alias("n"), F.sum(total).cast("long").alias("total")).select(F.lit(what).alias("what"), "n", "total")
    return count(kept, "kept", "o_orderkey").unionByName(count(twice, "repeated", "n")).unionByName(count(without, "without key", "o_orderkey")).unionByName(count(latest, "latest issues", "o_orderkey")).unionByName(count(named, "distinct issues", "o_orderkey"))


def tagged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three kinds in one frame of payloads, taken apart again."""
    orders, events, nations = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), read(spark, sf_dir, "events").select("event_id", "event_type"), read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = catalogs.tagged({"claim": orders, "event": events, "entity": nations})
    claims, happened, named = catalogs.untagged(rows, "claim", "o_orderkey long, o_orderstatus string"), catalogs.untagged(rows, "event", "event_id long, event_type string"), catalogs.untagged(rows, "entity", "n_nationkey int, n_name string")
    count = lambda frame, kind, id_, name: frame.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(id_).cast("long").alias("ids"))
    return count(claims, "claim", "o_orderkey", "o_orderstatus").unionByName(count(happened, "event", "event_id", "event_type")).unionByName(count(named, "entity", "n_nationkey", "n_name"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents looked up in a store keyed by the digest of their normal text; misses are recorded."""
    docs = read(spark, sf_dir, "documents").select("doc_id", catalogs.vector_key(F.col("text")).alias("key"))
    store = docs.where("doc_id % 3 <> 0").groupBy("key").agg(F.min("doc_id").alias("vector_id"))
    found = docs.join(store, "key", "left")
    return found.select("doc_id", "key", F.coalesce(F.col("vector_id").cast("string"), F.lit("NO_STORED_VECTOR")).alias("vector"))


def catalog_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks over the catalogs, each with how many rows it examined and how many fail."""
    t = {name: read(spark, sf_dir, name) for name in ("orders", "lineitem", "customer", "nation", "part", "supplier", "documents", "labels")}

    def check(name: str, rows: DataFrame, fails: Column) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.coalesce(fails, F.lit(False))).alias("failed")).select(F.lit(name).alias("check"), "examined", "failed")

    def refers(name: str, rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
        held = known.select(F.col(key).alias(column)).distinct().withColumn("_held", F.lit(True))
        return check(name, rows.select(column).join(held, column, "left"), F.col("_held").isNull())

    def unique(name: str, rows: DataFrame, *key: str) -> DataFrame:
        return check(name, rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1)

    totals = t["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("last"))
    out = unique("orders are told by their key", t["orders"], "o_orderkey")
    for more in (
        unique("lines are told by order and number", t["lineitem"], "l_orderkey", "l_linenumber"), refers("lines have an order", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), refers("lines have a part", t["lineitem"], "l_partkey", t["part"], "p_partkey"),
        refers("orders have a customer", t["orders"], "o_custkey", t["customer"], "c_custkey"), refers("customers have a nation", t["customer"], "c_nationkey", t["nation"], "n_nationkey"), refers("labels have a document", t["labels"], "doc_id", t["documents"], "doc_id"),
        check("line numbers have no gap", totals, F.col("n") != F.col("last")), check("documents count their characters", t["documents"], F.length("text") != F.col("n_chars")), check("lines ship after 1990", t["lineitem"], F.col("l_shipdate") < F.lit("1990-01-01").cast("timestamp")),
    ):
        out = out.unionByName(more)
    return out


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents with identifiers that grow from their parents', offsets, flags and a digest of how they were made."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = F.split("text", "\n")
    flags = F.array_compact(F.array(F.when(F.length("text") < 200, "low_yield"), F.when(F.size(parts) > 20, "many_blocks"), F.when(F.contains("text", F.lit("|")), "has_pipes")))
    made = F.substring(F.sha2(F.concat_ws("|", F.lit("parser=1"), F.lit("policy=v1"), F.sha2("text", 256)), 256), 1, 12)
    lengths = F.transform(parts, lambda p: F.length(p))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + 1)))
    return docs.select(
        "doc_id", F.concat(F.lit("doc:"), "doc_id", F.lit(":"), made).alias("derivation_id"), F.size(parts).cast("long").alias("n_blocks"), F.array_join(flags, ",").alias("flags"), F.element_at(ends, -2).cast("long").alias("last_block_at"),
        F.size(F.filter(parts, lambda p: F.trim(p) == "")).cast("long").alias("n_blank"),
    )


def catalog_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stands under a smaller id. Texts meet by digest, combined where they lie; no text is moved or sorted."""
    docs = read(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n")), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first_id")
    return docs.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


def passage_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether a text can serve as a passage: long enough, of three words or more, few control characters, no boilerplate."""
    rows = read(spark, sf_dir, "documents")
    bare = F.coalesce("text", F.lit(""))
    control = F.length(F.regexp_replace(bare, r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]+", ""))
    verdict = (
        F.when(F.length(F.trim(bare)) < 20, "too_short").when(F.regexp_count(bare, F.lit(r"[A-Za-z]{2,}")) < 3, "too_few_words").when(control * 10 > F.length(bare), "control_characters")
        .when(F.lower(bare).rlike(r"all rights reserved|released under the|licensed under"), "boilerplate").otherwise("usable")
    )
    return rows.select("doc_id", verdict.alias("usability"))


QUERIES = {
    f.__name__: f
    for f in (submissions_scan, header_blocks, filing_artifacts, fetch_statuses, run_round_trip, lines_round_trip, broken_lines, catalog_rebuild, tagged_records, vector_store, catalog_checks, document_stats, catalog_duplicates, passage_usability)
}

ORACLES = {
    "submissions_scan": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey AS company, o_orderkey AS accession, CASE WHEN o_orderpriority LIKE '1%' THEN '10-K' ELSE '8-K' END || CASE WHEN o_orderkey % 4 = 0 THEN '/A' ELSE '' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed
FROM o WHERE (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND NOT (o_custkey % 3 = 0 AND r = n)""",
    "header_blocks": "SELECT l_orderkey, 'EX-' || l_linenumber || '.1' AS type, l_partkey::INTEGER AS sequence, 'f' || l_suppkey || '.htm' AS name, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag || ' text' END AS description FROM lineitem",
    "filing_artifacts": "SELECT l_orderkey, count(*) + 2 AS n, (2 * sum(floor(l_extendedprice)))::BIGINT AS size, 3::BIGINT AS n_kinds FROM lineitem GROUP BY l_orderkey",
    "fetch_statuses": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unexpected' WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'damaged' ELSE 'complete' END AS status, count(*) AS n FROM orders WHERE o_orderkey % 9 <> 0 OR o_orderkey % 5 <> 0 GROUP BY 1",
    "run_round_trip": "SELECT 'customers' AS what, count(*) AS n FROM customer UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'refused ' || x, 1 FROM (VALUES ('twice'), ('partial'), ('changed')) v(x)",
    "lines_round_trip": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 4) AS total, max(user_id) AS last_user FROM events GROUP BY event_type",
    "broken_lines": "SELECT CASE WHEN event_id % 10 IN (3, 4) THEN 'rejected' ELSE 'read' END AS state, count(*) AS n, (sum(event_id) FILTER (WHERE event_id % 10 NOT IN (3, 4)))::BIGINT AS ids, count(DISTINCT event_type) FILTER (WHERE event_id % 10 NOT IN (3, 4)) AS n_types FROM events GROUP BY 1",
    "catalog_rebuild": """WITH k AS (SELECT *, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - o_orderkey % 3 END AS key FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY key) AS n FROM k WHERE key IS NOT NULL),
l AS (SELECT o_custkey % 20 AS i, o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders))
SELECT 'kept' AS what, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM r WHERE r = 1 UNION ALL SELECT 'repeated', count(*), sum(n)::BIGINT FROM r WHERE r = 1 AND n > 1 UNION ALL SELECT 'without key', count(*), sum(o_orderkey)::BIGINT FROM k WHERE key IS NULL
UNION ALL SELECT 'latest issues', count(*), sum(o_orderkey)::BIGINT FROM l UNION ALL SELECT 'distinct issues', count(*), sum(f)::BIGINT FROM (SELECT min(o_orderkey) AS f FROM l GROUP BY i) x""",
    "tagged_records": "SELECT 'claim' AS kind, o_orderstatus AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'event', event_type, count(*), sum(event_id)::BIGINT FROM events GROUP BY event_type UNION ALL SELECT 'entity', n_name, count(*), sum(n_nationkey)::BIGINT FROM nation GROUP BY n_name",
    "vector_store": r"""WITH d AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS key FROM documents), s AS (SELECT key, min(doc_id) AS v FROM d WHERE doc_id % 3 <> 0 GROUP BY key) SELECT doc_id, d.key, coalesce(v::VARCHAR, 'NO_STORED_VECTOR') AS vector FROM d LEFT JOIN s USING (key)""",
    "catalog_checks": """WITH u AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey), w AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), g AS (SELECT count(*) AS n, max(l_linenumber) AS m FROM lineitem GROUP BY l_orderkey)
SELECT 'orders are told by their key' AS "check", count(*) AS examined, count(*) FILTER (WHERE n > 1) AS failed FROM u UNION ALL SELECT 'lines are told by order and number', count(*), count(*) FILTER (WHERE n > 1) FROM w
UNION ALL SELECT 'lines have an order', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem UNION ALL SELECT 'lines have a part', count(*), count(*) FILTER (WHERE l_partkey NOT IN (SELECT p_partkey FROM part)) FROM lineitem
UNION ALL SELECT 'orders have a customer', count(*), count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders UNION ALL SELECT 'customers have a nation', count(*), count(*) FILTER (WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) FROM customer
UNION ALL SELECT 'labels have a document', count(*), count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)) FROM labels UNION ALL SELECT 'line numbers have no gap', count(*), count(*) FILTER (WHERE n <> m) FROM g
UNION ALL SELECT 'documents count their characters', count(*), count(*) FILTER (WHERE length(text) <> n_chars) FROM documents UNION ALL SELECT 'lines ship after 1990', count(*), count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1990-01-01') FROM lineitem""",
    "catalog_duplicates": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE doc_id IS NOT NULL) t WHERE doc_id <> first_id",
    "passage_usability": r"""SELECT doc_id, CASE WHEN length(trim(t)) < 20 THEN 'too_short' WHEN len(regexp_extract_all(t, '[A-Za-z][A-Za-z]+')) < 3 THEN 'too_few_words' WHEN len(list_filter(string_split(t, ''), lambda c: ascii(c) < 32 AND ascii(c) NOT IN (9, 10, 13) OR ascii(c) IN (127, 65533))) * 10 > length(t) THEN 'control_characters'
WHEN contains(lower(t), 'all rights reserved') OR contains(lower(t), 'released under the') OR contains(lower(t), 'licensed under') THEN 'boilerplate' ELSE 'usable' END AS usability FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d""",
    "document_stats": """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, 'doc:' || doc_id || ':' || substr(sha256('parser=1|policy=v1|' || sha256(text)), 1, 12) AS derivation_id, len(p) AS n_blocks, array_to_string(list_filter([CASE WHEN length(text) < 200 THEN 'low_yield' END, CASE WHEN len(p) > 20 THEN 'many_blocks' END, CASE WHEN contains(text, '|') THEN 'has_pipes' END], lambda x: x IS NOT NULL), ',') AS flags,
length(text) - length(p[-1]) AS last_block_at, len(list_filter(p, lambda x: trim(x) = '')) AS n_blank FROM d""",
}

"""A property graph from catalogs: nodes, edges, keys, loading by upsert, and reconciliation of what was loaded.

A node row: label, marks (further labels), key, props (map of texts), run. An edge row: type, key, src, dst,
props, run. Keys are digests of what identifies a thing, so that the same row makes the same key. All checks
are joins and aggregates by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PROJECTION = "2.1.0"
#: Hex digits of an edge key's digest: with 12, some pairs of 36 million edges share a key.
DIGITS = 32


def _props(columns: dict[str, Column]) -> Column:
    """Map of the columns that aren't null, as texts."""
    whole = F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), c.cast("string")))) if columns else F.create_map().cast("map<string,string>")
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def nodes(frame: DataFrame, label: str, key: Column, run: str, marks: Column | None = None, /, **props: Column) -> DataFrame:
    """Node rows of a frame; every one carries the run and the projection's version."""
    none = F.array().cast("array<string>")
    return frame.select(
        F.lit(label).alias("label"), (F.coalesce(marks, none) if marks is not None else none).alias("marks"), key.alias("key"),
        F.map_concat(_props(props), F.create_map(F.lit("run_id"), F.lit(run), F.lit("projection"), F.lit(PROJECTION))).alias("props"), F.lit(run).alias("run"),
    )


def edge_key(kind: Column, src: Column, dst: Column, *more: Column, digits: int = DIGITS) -> Column:
    return F.concat(F.lit("edge:"), F.lower(kind), F.lit(":"), text.digest(kind, src, dst, *more, length=digits))


def edges(frame: DataFrame, kind: str, src: Column, dst: Column, run: str, more: tuple[Column, ...] = (), digits: int = DIGITS, /, **props: Column) -> DataFrame:
    """Edge rows of a frame; `more` are further parts of an edge's identity, such as a role; `digits`: of the key's digest."""
    return frame.select(
        F.lit(kind).alias("type"), edge_key(F.lit(kind), src, dst, *more, digits=digits).alias("key"), src.alias("src"), dst.alias("dst"),
        F.map_concat(_props(props), F.create_map(F.lit("run_id"), F.lit(run))).alias("props"), F.lit(run).alias("run"),
    )


def variants(rows: DataFrame, key: str, *names: str) -> DataFrame:
    """One row a key from several sources: the one value of each attribute, else null, its variants, and whether they conflict."""
    merged = rows.groupBy(key).agg(*(F.sort_array(F.collect_set(name)).alias(name) for name in names), F.sort_array(F.collect_set("source")).alias("sources"))
    out = [F.col(key), "sources"]
    for name in names:
        several = F.size(name) > 1
        out += [F.when(~several, F.get(name, F.lit(0))).alias(name), F.when(several, F.array_join(name, "|")).alias(f"{name}_variants"), several.alias(f"{name}_conflict")]
    return merged.select(*out)


def first_cited(evidence: DataFrame, claim: str, target: str, order: str) -> DataFrame:
    """One row for each claim and cited thing, the first by order; of several the least row."""
    row = F.struct(order, F.struct(*evidence.columns).alias("row"))
    return evidence.groupBy(claim, target).agg(F.min(row).alias("r")).select("r.row.*")


def upserted(held: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """Held rows with the new ones in their place, by key; loading the same rows again changes nothing."""
    both = held.withColumn("_new", F.lit(0)).unionByName(rows.dropDuplicates([key]).withColumn("_new", F.lit(1)))
    # a key stands once on each side, so that a group holds two rows
    return both.groupBy(key).agg(F.max_by(F.struct(*held.columns), "_new").alias("r")).select("r.*")


def loadable(edge_rows: DataFrame, node_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends among the nodes, and for the others which end is missing."""
    keys = node_rows.select("key").distinct()
    found = edge_rows.join(keys.withColumnsRenamed({"key": "src"}).withColumn("_s", F.lit(True)), "src", "left").join(keys.withColumnsRenamed({"key": "dst"}).withColumn("_d", F.lit(True)), "dst", "left")
    whole = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    ends = F.when(F.col("_s").isNull() & F.col("_d").isNull(), "both").when(F.col("_s").isNull(), "source").otherwise("target")
    return found.where(whole).select(*edge_rows.columns), found.where(~whole).select("type", "key", "src", "dst", ends.alias("missing"))


def collisions(edge_rows: DataFrame) -> DataFrame:
    """(key, n, identical) of edge keys that stand more than once: the same row again, or two different ones."""
    content = F.sha2(F.concat_ws("\u001f", "type", "src", "dst", F.to_json("props")), 256)
    return edge_rows.select("key", content.alias("c")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("c") == F.max("c")).alias("identical")).where("n > 1")


def inadmissible(edge_rows: DataFrame, node_rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """(type, src_label, dst_label, n) of edges between labels that the type doesn't allow; allowed: type, src_label, dst_label."""
    labels = node_rows.select("key", "label").distinct()
    ends = edge_rows.join(labels.select(F.col("key").alias("src"), F.col("label").alias("src_label")), "src").join(labels.select(F.col("key").alias("dst"), F.col("label").alias("dst_label")), "dst")
    return ends.groupBy("type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("n")).join(allowed, ["type", "src_label", "dst_label"], "left_anti")


def content(rows: DataFrame) -> DataFrame:
    """(key, digest) of each row's content, whatever the order of its properties; the run is left out."""
    props = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: k != "run_id"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\u001f")
    ends = [F.col(c) for c in ("label", "type", "src", "dst") if c in rows.columns]
    return rows.select("key", F.sha2(F.concat_ws("\u001f", *ends, props), 256).alias("digest"))


def reconciled(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(check, n) of keys that are missing, unexpected, repeated or of another content; a check that holds has 0."""
    want, have = content(expected).withColumn("side", F.lit("want")), content(actual).withColumn("side", F.lit("have"))
    by_key = want.unionByName(have).groupBy("key").agg(
        F.count_if(F.col("side") == "want").alias("w"), F.count_if(F.col("side") == "have").alias("h"), F.max(F.when(F.col("side") == "want", F.col("digest"))).alias("dw"), F.max(F.when(F.col("side") == "have", F.col("digest"))).alias("dh"),
    )
    checks = {"missing": F.col("h") == 0, "unexpected": F.col("w") == 0, "repeated": F.col("h") > 1, "changed": (F.col("w") > 0) & (F.col("h") > 0) & (F.col("dw") != F.col("dh"))}
    counted = by_key.agg(*(F.count_if(when).alias(name) for name, when in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks))).alias("c")).select("c.*")


def ranked_passages(passages: DataFrame, words: list[str], k: int, pool: int) -> DataFrame:
    """The k passages that fit words best (id, score): BM25 over all passages, ties to the smaller id, among a pool of the best.

    passages: id, text. Statistics are of all passages; only passages with a word are scored.
    """
    tokens = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    each = passages.where("id IS NOT NULL").select("id", tokens.alias("t"))
    asked = F.array(*(F.lit(w.lower()) for w in words))
    hit = each.select("id", F.size("t").alias("n"), F.transform(asked, lambda w: F.size(F.filter("t", lambda t: t == w))).alias("f"))
    whole = each.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("t")).alias("mean"))
    df = hit.agg(F.array(*(F.count_if(F.col("f")[i] > 0) for i in range(len(words)))).alias("df"))
    held = hit.where(F.exists("f", lambda f: f > 0)).crossJoin(F.broadcast(whole.crossJoin(df)))  # one row of statistics

    def term(f: Column, d: Column) -> Column:
        idf = F.log(1 + (F.col("docs") - d + 0.5) / (d + 0.5))
        return idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("n") / F.col("mean")))

    score = F.aggregate(F.zip_with("f", "df", term), F.lit(0.0), lambda a, b: a + b)
    top = held.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(pool)
    return top.orderBy(F.desc("score"), "id").limit(k)


def truncated(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows by order, up to a limit, each saying whether there were more."""
    seen = rows.orderBy(*order).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows
    return seen.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)

"""The table lane: pipe tables to claims, relationally.

A table is exploded into cells; its period columns and the values of a row are both numbered in order, and a
join by that number binds the k-th value to the k-th period. Whatever can't be bound for certain is an issue
row with a code, never a guess. All joins and windows go by table, so that a table is the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, periods, text
from ..sources.shared import cut

# What a period label, a heading and a column of changes look like.
FISCAL_YEAR = r"(?i)\bFY\s?(\d{2}|\d{4})\b"
BARE_YEAR = r"^\s*(19|20)\d{2}\s*$"
CHANGE = r"(?i)\b(change|variance|increase|decrease|%\s*change)\b"
SEPARATOR = r"^\s*\|?[\s:|-]*-{2,}[\s:|-]*\|?\s*$"
_MONTHS = "|".join(periods.MONTHS)
MONTH_DAY = rf"(?i)\b({_MONTHS})\s+\d{{1,2}}\b"
DAY_HEADING = rf"(?i)^({_MONTHS})\s+\d{{1,2}},?$"
#: Distinct labels that are broadcast at most; more are joined.
BROADCAST_LABELS = 100_000


def cells(tables: DataFrame) -> DataFrame:
    """(table_id, row, col, cell, separator): rows are lines that aren't blank, columns the places between pipes."""
    lines = F.filter(F.split("text", "\r?\n"), lambda line: F.trim(line) != "")
    rows = tables.select("table_id", F.posexplode(lines).alias("row", "line"))
    inner = F.regexp_replace(F.regexp_replace(F.trim("line"), r"^\|", ""), r"\|$", "")
    ruled = F.col("line").rlike(SEPARATOR)
    parts = rows.select("table_id", "row", ruled.alias("separator"), F.posexplode_outer(F.when(~ruled, F.split(inner, r"\|"))).alias("col", "cell"))
    return parts.select("table_id", "row", "col", F.trim("cell").alias("cell"), "separator")


def addressed(grid: DataFrame) -> DataFrame:
    """Cells with `collapsed`, their column among those that hold anything in the table; null in an empty column."""
    held = grid.where("cell <> '' AND NOT separator").select("table_id", "col").distinct()
    order = held.withColumn("collapsed", F.row_number().over(Window.partitionBy("table_id").orderBy("col")) - 1)
    return grid.where("NOT separator").join(order, ["table_id", "col"], "left")


def looks_like_period(label: Column) -> Column:
    # most cells are plain numbers or words: all but a bare year have letters, all but a duration have digits
    dated = label.rlike("[0-9]") & (label.rlike(periods.FULL_DATE) | label.rlike(periods.SHORTHAND) | label.rlike(FISCAL_YEAR))
    return label.rlike(BARE_YEAR) | (label.rlike("[A-Za-z]") & (dated | label.rlike(periods.DURATION)))


def gridded(tables: DataFrame) -> DataFrame:
    """tables with `grid`: the trimmed cells of each line that isn't blank; a separator has none."""
    lines = F.filter(F.split("text", "\r?\n"), lambda line: F.trim(line) != "")
    inner = lambda line: F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    parts = lambda line: F.when(line.rlike(SEPARATOR), F.array().cast("array<string>")).otherwise(F.transform(F.split(inner(line), r"\|"), lambda c: F.trim(c)))
    return tables.withColumn("grid", F.coalesce(F.transform(lines, parts), F.array().cast("array<array<string>>")))


def period_columns(tables: DataFrame) -> DataFrame:
    """Tables with a grid, and date_row, n_dated, rule and columns: (k, change, col, period) of every header cell that is bound; a table without a rule is refused.

    The row of dates is the first with three labels of periods, else the last with two. Headings above it go
    to the dates by the first of three rules that fits: one heading without a day and one with go to full
    dates and to bare years; else an even split, if the dates divide evenly and there is one heading or the
    labels repeat; else by the column where each heading starts, if that is a date's column and no heading is
    left over. If none fits, the table is refused.
    """
    counts = F.transform("grid", lambda cells: F.size(F.filter(cells, lambda c: (c != "") & looks_like_period(c))))
    known = tables.withColumn("n_dated", counts)
    at_least = lambda n: F.transform("n_dated", lambda found, row: F.when(found >= n, row))
    known = known.withColumn("date_row", F.coalesce(F.array_min(at_least(3)), F.array_max(at_least(2))))
    placed = lambda cells, row: F.transform(cells, lambda c, col: F.struct(row.alias("row"), col.alias("start"), c.alias("phrase")))
    heads = F.flatten(F.transform(F.slice("grid", F.lit(1), F.coalesce("date_row", F.lit(0))), placed))
    dated = F.coalesce(F.get("grid", F.col("date_row")), F.array().cast("array<string>"))
    labels = F.transform(dated, lambda c, col: F.struct(col.alias("col"), c.alias("label"), c.rlike(CHANGE).alias("change")))
    header = known.withColumns({
        "spans": F.filter(heads, lambda s: (s["phrase"] != "") & (s["phrase"].rlike(periods.DURATION) | s["phrase"].rlike(DAY_HEADING))),
        "labels": F.filter(labels, lambda c: (c["label"] != "") & (c["change"] | looks_like_period(c["label"]))),
    })
    header = header.withColumn("dates", F.filter("labels", lambda c: ~c["change"])).withColumn("phrases", F.transform("spans", lambda s: s["phrase"]))
    is_full = lambda c: c["label"].rlike(periods.FULL_DATE)
    is_year = lambda c: c["label"].rlike(BARE_YEAR)
    with_day = lambda p: p.rlike(MONTH_DAY)
    header = header.select(
        "*", F.filter("phrases", lambda p: ~with_day(p)).alias("bare"), F.filter("phrases", with_day).alias("dayed"), F.size("dates").alias("n_dates"), F.size("spans").alias("n_spans"),
        F.size(F.filter("dates", is_full)).alias("n_full"), F.size(F.filter("dates", is_year)).alias("n_year"), F.size(F.array_distinct(F.transform("dates", lambda c: c["label"]))).alias("n_labels"),
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["phrase"].alias("phrase")))).alias("starts"),
    )
    # what stands above a date: the heading that starts last among those at its column or before
    above = lambda c: F.get(F.reverse(F.filter(F.col("starts"), lambda s: s["start"] <= c["col"])), F.lit(0))["phrase"]
    header = header.withColumn("governed", F.transform("dates", lambda c: F.struct(c.alias("c"), above(c).alias("phrase"))))
    first = (F.size("bare") == 1) & (F.size("dayed") == 1) & (F.col("n_full") > 0) & (F.col("n_year") > 0) & (F.col("n_full") + F.col("n_year") == F.col("n_dates"))
    even = (F.col("n_dates") > 0) & (F.col("n_dates") % F.col("n_spans") == 0) & ((F.col("n_spans") < 2) | (F.col("n_labels") < F.col("n_dates")))
    places = F.transform("spans", lambda s: s["start"])
    fits = (
        (F.col("n_spans") >= 2) & (F.size(F.array_distinct(places)) == F.col("n_spans")) & (F.size(F.array_except(places, F.transform("dates", lambda c: c["col"]))) == 0)
        & F.forall("governed", lambda g: g["phrase"].isNotNull() & ~(g["c"]["label"].rlike(periods.FULL_DATE) & g["phrase"].rlike(MONTH_DAY)))
        & (F.size(F.array_distinct(F.transform("governed", lambda g: g["phrase"]))) == F.col("n_spans"))
    )
    header = header.withColumn("rule", F.when(F.col("n_spans") == 0, 0).when(first, 1).when(even, 2).when(fits, 3))

    def heading_of(c: Column) -> Column:
        at = F.size(F.filter("dates", lambda d: d["col"] < c["col"]))
        return (
            F.when(F.col("rule") == 1, F.when(c["label"].rlike(periods.FULL_DATE), F.get("bare", F.lit(0))).otherwise(F.get("dayed", F.lit(0))))
            .when(F.col("rule") == 2, F.get("phrases", F.floor(at / (F.col("n_dates") / F.col("n_spans"))).cast("int"))).when(F.col("rule") == 3, F.get("governed", at)["phrase"]).otherwise("")
        )

    def period_of(c: Column) -> Column:
        year = F.regexp_extract(c["label"], FISCAL_YEAR, 1)
        whole = F.when(F.length(year) == 4, year.try_cast("int")).otherwise(2000 + year.try_cast("int"))
        fiscal = F.struct(periods.made_date(whole, F.lit(1), F.lit(1)).alias("start"), periods.made_date(whole, F.lit(12), F.lit(31)).alias("end"), F.lit(None).cast("date").alias("instant"))
        resolved = periods.resolve(c["label"], F.coalesce(heading_of(c), F.lit("")), F.lit(""))
        return F.when(c["label"].rlike(FISCAL_YEAR) & ~c["label"].rlike(periods.FULL_DATE), fiscal).otherwise(resolved)

    read = F.filter(F.transform("labels", lambda c: F.struct(c["change"].alias("change"), c["col"].alias("col"), F.when(~c["change"], period_of(c)).alias("period"))), lambda c: c["change"] | c["period"].isNotNull())
    numbered = F.transform(read, lambda c, k: F.struct((k + 1).alias("k"), c["change"].alias("change"), c["col"].alias("col"), c["period"].alias("period")))
    return header.withColumn("columns", F.when(F.col("rule").isNotNull() & F.col("date_row").isNotNull(), numbered)).select(*tables.columns, "date_row", "rule", "columns")


def first_words(rows: DataFrame, column: str, surfaces: DataFrame) -> DataFrame:
    """rows once for every surface (surface, metric_id) whose first word the text of a column holds.

    A text is cut into words where it lies and met with the one row of all first words, so that it is repeated
    for the few words that begin a surface and never for its own. The vocabulary is what is broadcast.
    """
    word = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    begins = surfaces.select("surface", "metric_id", F.get(word(F.lower("surface")), F.lit(0)).alias("_w"))
    one = begins.agg(F.collect_set("_w").alias("_firsts"))
    held = rows.crossJoin(F.broadcast(one)).withColumn("_w", F.explode(F.array_intersect(word(F.col(column)), "_firsts"))).drop("_firsts")
    return held.join(begins, "_w").drop("_w")


def label_surfaces(labels: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(label, surface, metric_id) of every surface that stands in a label (normal) as a whole phrase: met by first word, then tested.

    labels: label, normal (folded, in lower case).
    """
    met = first_words(labels.select("label", "normal"), "normal", surfaces)
    return met.where(text.phrase_at(F.col("normal"), F.col("surface")) > 0).select("label", "surface", "metric_id").distinct()


def resolve_labels(labels: DataFrame, metrics: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(label, metric_ids, basis) of distinct labels: a metric's own label, else a surface of its own, else the widest ambiguous surface in it, else nothing."""
    plain = F.lower(F.trim(text.without_qualifiers(text.folded(F.col("label")))))
    known = labels.select("label").distinct().withColumn("normal", plain)
    own = metrics.groupBy(F.lower("label").alias("normal")).agg(F.collect_set("metric_id").alias("own")).where("size(own) = 1")
    exact = surfaces.groupBy(F.lower("surface").alias("normal")).agg(F.sort_array(F.collect_set("metric_id")).alias("exact"))
    folded = F.lower(text.folded(F.col("label")))
    inside = label_surfaces(known.select("label", folded.alias("normal")), surfaces).groupBy("label", "surface").agg(F.sort_array(F.collect_set("metric_id")).alias("ids")).where("size(ids) > 1")
    widest = inside.groupBy("label").agg(F.max_by("ids", F.struct(F.length("surface"), "surface")).alias("widest"))
    rows = known.join(own, "normal", "left").join(exact, "normal", "left").join(widest, "label", "left")
    basis = F.when(F.col("own").isNotNull(), "canonical_label").when(F.size("exact") == 1, "exact_alias").when((F.size("exact") > 1) | F.col("widest").isNotNull(), "ambiguous_alias").otherwise("unresolved")
    return rows.select("label", F.coalesce("own", "exact", "widest", F.array().cast("array<string>")).alias("metric_ids"), basis.alias("basis"))


def read_tables(tables: DataFrame, metrics: DataFrame, surfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims and issues of tables (table_id, text, preceding), one a row.

    A claim: table_id, row, col, metric_id, period (start, end, instant), value, unit, currency, scale, source
    of the scale, label, period_key. An issue: table_id, row, col, code. A declared scale in the table goes
    before one in the text ahead; it applies to amounts only, and not to rows its exceptions name.

    A table is read within its row, and a line of it within its own, so nothing but distinct labels moves.
    Arrays are exploded as outer ones: of others the optimizer works out their whole making once more, in a filter.
    """
    grids = gridded(tables.select("table_id", "text", "preceding"))
    # a label is the first cell of a line that holds anything; those of headers are resolved as well, and not used
    held = lambda cells: F.filter(F.transform(cells, lambda c, col: F.struct(col.alias("at"), c.alias("cell"))), lambda x: x["cell"] != "")
    first = F.get(F.filter("line", lambda c: c != ""), F.lit(0))
    said = grids.select(F.explode_outer("grid").alias("line")).select(first.alias("label")).where("label IS NOT NULL").distinct()
    kinds = metrics.select("metric_id", "unit", "currency", "period_type", F.lit(True).alias("listed"))
    names = resolve_labels(cut(said), metrics, surfaces).withColumn("metric_id", F.when(F.size("metric_ids") == 1, F.get("metric_ids", F.lit(0))))
    names = cut(names.join(F.broadcast(kinds), "metric_id", "left").select("label", "metric_ids", "metric_id", "unit", "currency", "period_type", "listed"))
    if names.count() <= BROADCAST_LABELS:
        names = F.broadcast(names)

    header = period_columns(grids)
    n_rows, last_col = F.size(F.filter("grid", lambda cells: F.size(cells) > 0)), F.array_max(F.transform("grid", lambda cells: F.size(cells) - 1))
    flat = (n_rows < 2) | (F.coalesce(last_col, F.lit(0)) < 1)
    no_period = F.col("date_row").isNull() | (F.col("rule").isNotNull() & (F.size("columns") == 0))
    refused = F.when(flat, "UNSUPPORTED_TABLE_SHAPE").when(no_period, "MISSING_PERIOD").when(F.col("rule").isNull(), "AMBIGUOUS_COLUMN_ALIGNMENT")
    # a cell that declares a scale declares it in the whole text, too
    local = F.get(F.filter(F.transform(F.flatten("grid"), numbers.scale_declaration), lambda s: s.isNotNull()), F.lit(0))
    local = F.when(numbers.scale_declaration(F.col("text")).isNotNull(), local)
    header = header.select("table_id", "grid", "date_row", "columns", refused.alias("refused"), local.alias("local"), numbers.scale_declaration(F.col("preceding")).alias("ahead"))
    source = F.when(F.col("local").isNotNull(), "table_header").when(F.col("ahead").isNotNull(), "preceding_context").otherwise("metric_default")
    header = header.select("table_id", "date_row", "columns", "refused", F.coalesce("local", "ahead").alias("declared"), source.alias("scale_source"), F.posexplode_outer(F.when(F.col("refused").isNull(), F.col("grid"))).alias("row", "line"))

    rows = header.withColumn("held", held(F.col("line"))).where("refused IS NOT NULL OR (row > date_row AND size(held) > 0)")
    rows = rows.withColumn("label", F.get("held", F.lit(0))["cell"]).join(names, "label", "left")
    values = F.transform(F.slice("held", F.lit(2), F.greatest(F.size("held") - 1, F.lit(0))), lambda x: F.struct(x["at"].alias("at"), numbers.magnitude(x["cell"]).alias("number"), x["cell"].alias("cell")))
    rows = rows.withColumn("values", F.filter(values, lambda v: v["number"].isNotNull() | numbers.is_nil(v["cell"])))
    reporting = F.filter("columns", lambda c: ~c["change"])
    aligned = F.when(F.size("values") == F.size("columns"), F.col("columns")).when(F.size("values") == F.size(reporting), reporting)
    rows = rows.withColumn("aligned", F.when(F.col("listed"), aligned)).withColumn("pairs", F.zip_with("values", "aligned", lambda v, c: F.struct(v.alias("v"), c.alias("c"))))

    none = F.lit(None).cast("date")
    stock = periods.is_instant_label(F.col("label"))
    period = lambda c: F.when(stock, F.struct(none.alias("start"), none.alias("end"), F.coalesce(c["period"]["instant"], c["period"]["end"]).alias("instant"))).otherwise(c["period"])
    mismatch = lambda x: (F.col("period_type") == "instant") != x["period"]["instant"].isNotNull()
    exempt = numbers.scale_excludes(F.col("declared.exceptions"), F.col("label"))
    scale = F.when(F.col("declared").isNotNull(), F.when((F.col("unit") == "USD") & ~exempt, F.col("declared.scale")).otherwise("units"))
    rows = rows.withColumn("scale", scale).withColumn("read", F.transform(F.filter("pairs", lambda p: ~p["c"]["change"] & p["v"]["number"].isNotNull()), lambda p: F.struct(p["c"]["col"].alias("col"), period(p["c"]).alias("period"), p["v"]["number"].alias("number"))))
    key = lambda p: periods.key(p["start"], p["end"], p["instant"])
    made = lambda x: F.struct(x["col"].alias("col"), x["period"].alias("period"), (x["number"] * numbers.scale_factor(F.col("scale"))).alias("value"), key(x["period"]).alias("period_key"))
    rows = rows.withColumn("claims", F.transform(F.filter("read", lambda x: ~mismatch(x)), made))
    apart = lambda x: F.exists("claims", lambda y: y["period_key"].eqNullSafe(x["period_key"]) & (y["value"] != x["value"]))
    earlier = lambda x: F.exists("claims", lambda y: y["period_key"].eqNullSafe(x["period_key"]) & (y["col"] < x["col"]))
    claims = rows.select("table_id", "row", "metric_id", "unit", "currency", "scale", "scale_source", "label", F.explode_outer(F.filter("claims", lambda x: ~apart(x))).alias("x")).where("x IS NOT NULL")
    claims = claims.select("table_id", "row", "x.col", "metric_id", "x.period", "x.value", "unit", "currency", "scale", "scale_source", "label", "x.period_key")

    issue = lambda col, code: F.struct(col.cast("int").alias("col"), F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"))
    whole = lambda condition, code: F.when(condition, F.array(issue(F.lit(None), code)))
    at = lambda found, code: F.transform(found, lambda x: issue(x["col"], code))
    several = [
        whole(F.col("refused").isNotNull(), F.col("refused")), whole(F.size("metric_ids") > 1, "AMBIGUOUS_ALIAS"), whole(F.size("metric_ids") == 0, "UNRESOLVED_METRIC"),
        whole(F.col("listed") & F.col("aligned").isNull() & F.col("refused").isNull(), "AMBIGUOUS_COLUMN_ALIGNMENT"),
        at(F.transform(F.filter("pairs", lambda p: p["c"]["change"]), lambda p: p["c"]), "DERIVED_CHANGE_COLUMN"), at(F.filter("read", mismatch), "PERIOD_TYPE_MISMATCH"),
        at(F.filter("claims", lambda x: apart(x) & ~earlier(x)), "AMBIGUOUS_COLUMN_ALIGNMENT"),
    ]
    none_at = F.array().cast("array<struct<col:int,code:string>>")
    found = rows.select("table_id", "row", F.explode_outer(F.concat(*(F.coalesce(one, none_at) for one in several))).alias("x")).where("x IS NOT NULL")
    return claims, found.select("table_id", "row", "x.col", "x.code")

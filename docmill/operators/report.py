"""Metrics and reports over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.shared import new_folder, stored


def ingestion_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A-5. docs: doc_id, started, ended (timestamps). chunks: doc_id. Status, number of chunks and milliseconds of each document."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    total = F.coalesce("n", F.lit(0))
    ms = F.unix_millis("ended") - F.unix_millis("started")
    return docs.join(n, "doc_id", "left").select("doc_id", F.when(total == 0, "FAILED").otherwise("DONE").alias("status"), total.alias("total_chunks"), ms.alias("processing_time_ms"), F.when(total == 0, "No chunks extracted").alias("error_message"))


def eval_quality(log: DataFrame, by: str = "llm_model") -> DataFrame:
    """A-10. log: by, faithfulness, relevance, scope_violation, verdict (null if none was given). Verdict rates and means of the clamped metrics."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    rows = log.withColumn("faithfulness", clamp("faithfulness")).withColumn("relevance", clamp("relevance"))
    rule = F.when((F.col("faithfulness") >= 0.75) & (F.col("relevance") >= 0.70) & ~F.col("scope_violation"), "PASS").when(F.col("faithfulness") >= 0.55, "WARN").otherwise("FAIL")
    rows = rows.withColumn("verdict", F.coalesce("verdict", rule))
    rates = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("PASS", "WARN", "FAIL")]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *rates, F.avg("faithfulness").alias("faithfulness"), F.avg("relevance").alias("relevance"))


def control_coverage(controls: DataFrame, group: str, partial: float = 0.5) -> DataFrame:
    """A-11. controls: group, status (implemented, partial or other)."""
    done, half = F.count_if(F.col("status") == "implemented"), F.count_if(F.col("status") == "partial")
    return controls.groupBy(group).agg(F.count("*").alias("total"), ((done + half * partial) / F.count("*") * 100).alias("coverage"))


def risk_ranking(risks: DataFrame, group: str, pieces: int = 256) -> DataFrame:
    """A-12. risks: group, probability, impact. Groups by the sum of probability times impact; equal sums share a rank; groups without a sum come last.

    Products are rounded to six decimals and added up as decimals, so a sum, its ties and its
    rank don't hang on the order of addition; a product over 22 digits before the point is an error
    or null, as the session has it.

    Sums are dealt by `pieces` quantiles into ranges that are ranked apart, equal sums in one
    range; how many lie in higher ranges is added. So no task ranks all groups. The sums are
    written to the shared folder first.
    """
    total = risks.groupBy(group).agg(F.sum((F.col("probability") * F.col("impact")).cast("decimal(28,6)")).cast("double").alias("risk"))
    total = stored(total, new_folder(risks.sparkSession, "risks"))
    cuts = total.agg(F.array_distinct(F.percentile_approx("risk", [i / pieces for i in range(1, pieces)], 100 * pieces)).alias("q")).first().q or []
    above = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c > F.col("risk"))), F.lit(pieces)) if cuts else F.lit(0)
    placed = total.withColumn("_range", F.when(F.col("risk").isNull(), F.lit(pieces)).otherwise(above))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # at most pieces + 1 rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.rank().over(Window.partitionBy("_range").orderBy(F.desc("risk")))
    ranked = placed.join(F.broadcast(ranges.select("_range", before.alias("_before"))), "_range")
    return ranked.select(group, "risk", (own + F.col("_before")).cast("int").alias("rank"))


def sla_cumulative(tickets: DataFrame, sla: DataFrame, by: str) -> DataFrame:
    """A-13. tickets: by, severity. sla: severity, max_hours; a few rows, broadcast. Hours allowed in all, of groups with two severities or more."""
    n = tickets.groupBy(by, "severity").agg(F.count("*").alias("n")).join(F.broadcast(sla), "severity")
    return n.groupBy(by).agg(F.sum(F.col("n") * F.col("max_hours")).alias("hours"), F.count("*").alias("severities")).where("severities >= 2")


def rosi(cases: DataFrame, group: str) -> DataFrame:
    """A-14. cases: group, impact, p0, p1, cost. Annual losses before and after, net benefit and return of a security investment; groups without cost are left out."""
    s = cases.groupBy(group).agg(F.sum(F.col("impact") * F.col("p0")).alias("ale0"), F.sum(F.col("impact") * F.col("p1")).alias("ale1"), F.sum("cost").alias("cost")).where("cost > 0")
    net = F.col("ale0") - F.col("ale1") - F.col("cost")
    return s.withColumns({"gross": F.col("ale0") - F.col("ale1"), "net": net, "rosi": net / F.col("cost") * 100})


def budget_remainder(shares: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """A-15. shares: key, percent. totals: key, total. What at least two shares leave of 100 %."""
    s = shares.groupBy(key).agg(F.sum("percent").alias("used"), F.count("*").alias("n")).where("n >= 2 and used <= 100")
    left = 100 - F.col("used")
    return s.join(totals, key).select(key, left.alias("percent"), (F.col("total") * left / 100).alias("amount"))


def deadline_offsets(events: DataFrame, hours: list[int]) -> DataFrame:
    """A-16. events: event_id, ts. A row for each deadline: its time, weekday, and the span from the first to the last deadline of the event."""
    deadline = F.explode(F.array(*[F.lit(h) for h in sorted(hours)]))
    rows = events.select("event_id", "ts", deadline.alias("hours"))
    at = F.timestamp_micros(F.unix_micros("ts") + F.col("hours").cast("long") * 3_600_000_000)
    return rows.select("event_id", "hours", at.alias("deadline"), F.date_format(at, "EEEE").alias("weekday"), F.lit(max(hours) - min(hours)).alias("span_hours"))


POINT = "struct<category:string,categories:string,label:string,labels:string,value:string,values:string>"
CHART_SCHEMA = f"kind string, toon_type string, title string, source string, unit_of_measure string, timeframe string, x_axis_labels array<string>, `x-axis_labels` array<string>, confidence double, visual_trend_description string, data_points array<{POINT}>"
YEAR = r"\b(?:19|20)[0-9]{2}\b"
#: Qualifiers of categories that readings of charts invent.
SUSPECT = " sud|south"


def normalize_chart_json(charts: DataFrame, least: float = 0.55, most_points: int = 40, most_numbers: int = 12, sanitize: bool = False) -> DataFrame:
    """X-17. charts: doc_id, page_no, pass, raw (JSON). The better reading of each chart (10 a point with a category, -25 an unreadable one) under one name for each field; readings below the least confidence are dropped.

    Adds kind (a bar chart where there are points and labels of the x axis), timeframe (the
    first and last year of the labels, where none was read), confidence (as read, or by what
    there is), numbers (the first points with unit and period) and text (title, trend and points).
    sanitize, once a reading is chosen and its confidence known: the timeframe becomes its
    different four-digit years in order, or NOT READABLE without any, and points whose category
    is qualified by a south are removed.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))).isin("", "NOT READABLE", "None")
    said = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))
    shown = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"[\[\]'\"]", ""), r"\s*,\s*", ", "))
    points = F.transform(
        F.coalesce("c.data_points", F.array().cast(f"array<{POINT}>")),
        lambda p: F.struct(shown(said(p["category"], p["categories"], p["label"], p["labels"])).alias("label"), shown(said(p["value"], p["values"])).alias("value")),
    )
    rows = charts.select("doc_id", "page_no", "pass", F.from_json("raw", CHART_SCHEMA).alias("c")).withColumn("points", points)
    bad = F.filter("points", lambda p: F.upper(p["label"]).contains("NOT_READABLE") | F.upper(p["value"]).contains("NOT_READABLE"))
    quality = 10 * F.size(F.filter("points", lambda p: p["label"] != "")) - 25 * F.size(bad)
    best = rows.groupBy("doc_id", "page_no").agg(F.max_by(F.struct("c", "points"), F.struct(quality, -F.col("pass"))).alias("b")).select("doc_id", "page_no", "b.c", "b.points")
    labels = F.coalesce(F.col("c.x_axis_labels"), F.col("c.`x-axis_labels`"), F.array().cast("array<string>"))
    years = F.array_distinct(F.regexp_extract_all(F.array_join(labels, " "), F.lit(f"({YEAR})"), F.lit(1)))
    span = F.when(F.size(years) >= 2, F.concat(F.element_at(years, 1), F.lit(" vs "), F.element_at(years, -1))).when(F.size(years) == 1, F.element_at(years, 1)).otherwise("")
    n = F.size("points")
    named = best.withColumn("timeframe", F.when(blank(F.col("c.timeframe")), span).otherwise(F.col("c.timeframe"))).withColumns(
        {
            "kind": F.when(said(F.col("c.kind")) != "", F.col("c.kind")).when((n > 0) & (F.size(labels) > 0), "bar_chart").otherwise(F.coalesce(F.nullif(said(F.col("c.toon_type")), F.lit("")), F.lit("image"))),
            "title": said(F.col("c.title")),
            "unit": said(F.col("c.unit_of_measure")),
        }
    )
    has = lambda c: (c != "").cast("double")
    guess = 0.25 + 0.15 * has(F.col("title")) + 0.10 * has(said(F.col("c.source"))) + 0.05 * has(F.col("unit")) + F.when(n >= 2, 0.25).otherwise(0.0) + F.when(n >= 4, 0.10).otherwise(0.0) + 0.10 * F.col("timeframe").rlike(YEAR).cast("double")
    out = named.withColumn("confidence", F.round(F.coalesce("c.confidence", F.least(F.lit(0.95), guess)), 6))
    if sanitize:
        period = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("timeframe", F.lit("")), F.lit(f"({YEAR})"), F.lit(1)))), " vs ")
        clean = F.filter("points", lambda p: ~F.lower(p["label"]).rlike(SUSPECT))
        out = out.withColumn("points", clean).withColumn("timeframe", F.when(period == "", "NOT READABLE").otherwise(period))
    numbers = F.transform(F.slice("points", 1, most_numbers), lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"), F.col("unit").alias("unit"), F.col("timeframe").alias("period")))
    lines = F.concat(F.filter(F.array("title", said(F.col("c.visual_trend_description"))), lambda t: t != ""), F.transform(F.filter(F.slice("points", 1, most_points), lambda p: (p["label"] != "") | (p["value"] != "")), lambda p: F.concat(F.lit(" - "), p["label"], F.lit(": "), p["value"])))
    return out.select("doc_id", "page_no", "kind", "title", "timeframe", n.alias("n_points"), "confidence", numbers.alias("numbers"), F.array_join(lines, "\n").alias("text")).where(F.col("confidence") >= least)


def formula_texts(pages: DataFrame) -> DataFrame:
    """X-17's twin for formulas. pages: doc_id, page_no, raw (JSON with summary_it and formulas): one text for each page, of its summary and each formula's meaning, LaTeX and variables; pages with neither have no row."""
    schema = "summary_it string, formulas array<struct<meaning_it:string,description_it:string,latex:string,variables:array<string>>>"
    js = pages.select("doc_id", "page_no", F.from_json("raw", schema).alias("j"))
    name = lambda v: F.when(F.trim(v).startswith("{"), F.concat_ws(": ", F.get_json_object(v, "$.name"), F.get_json_object(v, "$.meaning"))).otherwise(v)
    latex = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^\[\s*\""), F.array_join(F.from_json(c, "array<string>"), " ")).otherwise(F.coalesce(c, F.lit("")))
    block = lambda f: F.concat(F.lit("## "), F.coalesce(F.nullif(f["meaning_it"], F.lit("")), F.nullif(f["description_it"], F.lit("")), F.lit("Formula")), F.lit("\n$$"), latex(f["latex"]), F.lit("$$\n"), F.array_join(F.transform(F.coalesce(f["variables"], F.array().cast("array<string>")), name), "; "))
    formulas = F.coalesce("j.formulas", F.array().cast("array<struct<meaning_it:string,description_it:string,latex:string,variables:array<string>>>"))
    text = F.array_join(F.concat(F.filter(F.array("j.summary_it"), lambda s: F.coalesce(s, F.lit("")) != ""), F.transform(formulas, block)), "\n")
    return js.select("doc_id", "page_no", text.alias("text")).where("text != ''")

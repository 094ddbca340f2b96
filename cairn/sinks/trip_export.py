"""Trip reports as Markdown, HTML or JSON.

A report is built as lines, one row each, numbered per trip, and comes in parts of a fixed number of
lines that follow each other. A part is the same row whatever else the trip holds, so reports grow by
rows, and no row grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.functions.columns import iso_minute, not_empty
from cairn.operators.journal import best_rated, rating_average
from cairn.operators.ordered import running_totals
from cairn.session import cut

LINES_PER_PART = 1000
HEAD, BEST, PLACES, END = 0, 1, 2, 3


def decimal_text(value) -> Column:
    """``12.34``, ``12.3`` or ``12.0``."""
    fixed = F.regexp_replace(F.format_string("%.2f", value), r"0+$", "")
    return F.regexp_replace(fixed, r"\.$", ".0")


def _date_text(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd HH:mm:ss'+00:00'"), F.lit("N/A"))


def _stars(average: Column) -> Column:
    return F.repeat(F.lit("⭐"), F.rint(average).cast("int"))


def _rows(source: DataFrame, section: int, ts: Column, lines: Column, ord_: Column,
          step: Column) -> DataFrame:
    lines = F.flatten(F.transform(lines, lambda line: F.split(line, "\n")))
    return source.select("trip_id", F.lit(section).alias("section"), ts.alias("ts"),
                         ord_.alias("ord"), step.alias("step"),
                         F.posexplode(lines).alias("n", "line"))


def _visit_notes(visits: DataFrame, notes: DataFrame) -> DataFrame:
    own = visits.select(
        F.col("id").alias("visit_id"), "trip_id", "visited_at", F.col("ord").alias("visit_ord"),
        F.coalesce("place_name", "place_id").alias("label"))
    rated = notes.withColumn("average", rating_average()).select(
        "visit_id", "text", "average", F.col("ord").alias("note_ord"), "rating", "ord")
    return own.join(rated, "visit_id", "left")


def _lines(trips: DataFrame, visits: DataFrame, notes: DataFrame, summary: DataFrame,
           head: Column, best_title: Column, best_line, places_title: Column, visit_lines,
           note_lines, end: Column) -> DataFrame:
    zero, no_ts = F.lit(0).cast("bigint"), F.lit(None).cast("timestamp")
    own = visits.where("trip_id IS NOT NULL").join(trips.select("trip_id"), "trip_id",
                                                   "left_semi")
    joined = trips.join(summary.drop("categories"), "trip_id", "left").withColumns({
        "total_places": F.coalesce("total_places", F.lit(0)),
        "total_distance_km": F.coalesce("total_distance_km", F.lit(0.0)),
        "total_hours": F.coalesce("total_hours", F.lit(0.0))})
    noted = _visit_notes(own, notes)
    best = cut(best_rated(noted.where("note_ord IS NOT NULL")))
    firsts = own.select(
        "trip_id", "visited_at", "ord", F.coalesce("place_name", "place_id").alias("label"))
    stars = own.select("trip_id").distinct()
    parts = [
        _rows(joined, HEAD, no_ts, head, zero, zero),
        _rows(best.select("trip_id").distinct(), BEST, no_ts, best_title, zero, zero),
        _rows(best, BEST, no_ts, best_line(F.col("label")), F.col("position").cast("bigint"),
              F.lit(1).cast("bigint")),
        _rows(best.select("trip_id").distinct(), BEST, no_ts, F.array(F.lit("")),
              F.lit(1 << 40), zero),
        _rows(stars, PLACES, no_ts, places_title, zero, zero),
        _rows(firsts, PLACES, F.col("visited_at"), visit_lines(F.col("label")),
              F.col("ord"), zero),
        _rows(noted.where("note_ord IS NOT NULL"), PLACES, F.col("visited_at"),
              note_lines(F.col("text"), F.col("average")), F.col("visit_ord"),
              F.col("note_ord") + 1),
        _rows(joined if end is not None else stars, END, no_ts,
              end if end is not None else F.array(F.lit("")), zero, zero)]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return cut(lines)


def documents(lines: DataFrame, per_part: int = LINES_PER_PART) -> DataFrame:
    """(trip_id, part, content): lines ``part * per_part`` and on, joined by newlines."""
    order = ["section", "ts", "ord", "step", "n", "line"]
    numbered = running_totals(lines, ["trip_id"], order, {"number": F.lit(1)})
    parted = numbered.withColumn("part", F.floor((F.col("number") - 1) / per_part))
    return parted.groupBy("trip_id", "part").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("number", "line"))), lambda r: r["line"]), "\n").alias("content"))


def markdown(trips: DataFrame, visits: DataFrame, notes: DataFrame, summary: DataFrame,
             per_part: int = LINES_PER_PART) -> DataFrame:
    """Markdown report per trip."""
    head = F.array(
        F.concat(F.lit("# 🌍 "), "name"), F.lit(""),
        F.concat(F.lit("**Region:** "), F.coalesce(not_empty("region"), F.lit("N/A"))),
        F.concat(F.lit("**Dates:** "), _date_text("start_date"), F.lit(" — "),
                 _date_text("end_date")),
        F.concat(F.lit("**Places visited:** "), "total_places"),
        F.concat(F.lit("**Distance:** "), decimal_text("total_distance_km"), F.lit(" km")),
        F.concat(F.lit("**Time:** "), decimal_text("total_hours"), F.lit(" hours")), F.lit(""))

    def note(body: Column, average: Column) -> Column:
        return F.filter(F.array(
            F.when(F.length(body) > 0, F.concat(F.lit("  > "), body)),
            F.when(average > 0, F.concat(F.lit("  Rating: "), _stars(average), F.lit(" ("),
                                         decimal_text(average), F.lit("/5)")))),
            lambda x: x.isNotNull())

    return documents(_lines(
        trips, visits, notes, summary, head, F.array(F.lit("## ⭐ Best Places")),
        lambda label: F.array(F.concat(F.lit("- "), label)), F.array(F.lit("## 📍 Places")),
        lambda label: F.array(F.concat(F.lit("- **"), label, F.lit("** — "),
                                       iso_minute("visited_at"))), note, None), per_part)


def html(trips: DataFrame, visits: DataFrame, notes: DataFrame, summary: DataFrame,
         product: str = "cairn", per_part: int = LINES_PER_PART) -> DataFrame:
    """HTML report per trip, user texts escaped."""
    title = text.html_escape("name")

    def fact(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"<p><strong>{label}:</strong> "), value, F.lit("</p>"))

    head = F.array(
        F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">'),
        F.concat(F.lit("<title>"), title, F.lit(f" — {product}</title>\n</head>\n<body>")),
        F.concat(F.lit("<h1>🌍 "), title, F.lit('</h1>\n<div class="meta">')),
        fact("Region", text.html_escape(F.coalesce(not_empty("region"), F.lit("N/A")))),
        fact("Dates", F.concat(_date_text("start_date"), F.lit(" — "), _date_text("end_date"))),
        fact("Places visited", F.col("total_places").cast("string")),
        fact("Distance", F.concat(decimal_text("total_distance_km"), F.lit(" km"))),
        fact("Time", F.concat(decimal_text("total_hours"), F.lit(" hours"))), F.lit("</div>"))

    def note(body: Column, average: Column) -> Column:
        return F.filter(F.array(
            F.when(F.length(body) > 0, F.concat(F.lit("<blockquote>"), text.html_escape(body),
                                                F.lit("</blockquote>"))),
            F.when(average > 0, F.concat(F.lit("<p class='rating'>"), _stars(average), F.lit(" ("),
                                         decimal_text(average), F.lit("/5)</p>")))),
            lambda x: x.isNotNull())

    return documents(_lines(
        trips, visits, notes, summary, head, F.array(F.lit("<h2>⭐ Best Places</h2>")),
        lambda label: F.array(F.concat(F.lit("<li>"), text.html_escape(label), F.lit("</li>"))),
        F.array(F.lit("<h2>📍 Places</h2>")),
        lambda label: F.array(
            F.concat(F.lit("<h3>"), text.html_escape(label), F.lit("</h3>")),
            F.concat(F.lit('<p class="date">'), iso_minute("visited_at"), F.lit("</p>"))),
        note, F.array(F.lit("</body>\n</html>"))), per_part)


def json(trips: DataFrame, summary: DataFrame) -> DataFrame:
    """JSON report per trip."""
    joined = trips.join(summary, "trip_id", "left")
    return joined.select("trip_id", F.to_json(F.struct(
        F.struct(*trips.columns).alias("trip"), *[c for c in summary.columns if c != "trip_id"]))
        .alias("content"))


def with_file_name(reports: DataFrame, trips: DataFrame, extension: str) -> DataFrame:
    return reports.join(trips.select("trip_id", text.file_name("name", extension)
                                     .alias("file_name")), "trip_id")

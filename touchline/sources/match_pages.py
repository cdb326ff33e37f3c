"""Odds and statistics of matches from saved web pages: tables of cells with class names, taken apart by SQL functions.

A page's markup is cut at its rows (`split` on the row's opening tag), and a row at its cells, so that one pass of JVM expressions gives rows (page_id, block, n, cells). Nothing is fetched
here: pages are a table with their html, as any crawler leaves them.

Defined results: null or empty pages give no rows; markup inside a cell is dropped and white space made single; a number without digits is null; repeated rows
stay; cells beyond those expected are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: statistics' labels on the pages, and our names.
STAT_LABELS = {
    "Expected goals (xG)": "xg", "Ball possession": "possession", "Total shots": "shots", "Shots on target": "shots_on_target", "Shots off target": "shots_off_target", "Corner kicks": "corners", "Fouls": "fouls", "Offsides": "offsides",
    "Yellow cards": "yellow_cards", "Red cards": "red_cards",
}


def number(text: Column) -> Column:
    """The first number of a text (a comma is a point); 45% is 0.45; null without digits."""
    digits = F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit(".")), r"-?\d+(?:\.\d+)?", 0), F.lit(""))
    return digits.cast("double") / F.when(F.contains(text, F.lit("%")), 100.0).otherwise(1.0)


def plain(markup: Column) -> Column:
    """Markup without tags and with the common character references read, white space single."""
    text = F.regexp_replace(markup, r"<[^>]*>", " ")
    for reference, char in (("&nbsp;", " "), ("&#160;", " "), ("&raquo;", "»"), ("&#187;", "»"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def start_and_end(title: Column) -> Column:
    """struct(start, end) of an odds' title `1.80 » 1.95`; one number alone is the end."""
    parts = F.split(title, "»")
    return F.when(F.size(parts) > 1, F.struct(number(F.get(parts, F.lit(0))).alias("start"), number(F.get(parts, F.lit(1))).alias("end"))).otherwise(F.struct(F.lit(None).cast("double").alias("start"), number(title).alias("end")))


def backfilled(odds: Column) -> Column:
    """An odds struct whose missing start is its end."""
    return F.struct(F.coalesce(odds["start"], odds["end"]).alias("start"), odds["end"].alias("end"))


def page_rows(pages: DataFrame, tag: str = "tr", cell: str = "t[dh]") -> DataFrame:
    """(page_id, n, row_class, cells array<struct(title, text)>) of every row of the pages' tables, n from 0 in page order."""
    opened = F.split("html", rf"(?i)<{tag}\b")
    one = pages.select("page_id", F.posexplode(F.slice(opened, 2, 1 << 30)).alias("n", "row"))
    body = F.regexp_extract("row", rf"(?is)^[^>]*>(.*?)(?:</{tag}>|$)", 1)
    parts = F.slice(F.split(body, rf"(?i)<{cell}\b"), 2, 1 << 30)
    title = lambda c: F.nullif(plain(F.regexp_extract(c, r'(?is)^.*?\btitle="([^"]*)"', 1)), F.lit(""))
    inner = lambda c: plain(F.regexp_extract(c, rf"(?is)^[^>]*>(.*?)(?:</{cell}>|$)", 1))
    return one.select("page_id", "n", F.regexp_extract("row", r'(?is)^[^>]*\bclass="([^"]*)"', 1).alias("row_class"), F.transform(parts, lambda c: F.struct(title(c).alias("title"), inner(c).alias("text"))).alias("cells"))


def result_odds(rows: DataFrame, bookmakers: tuple[str, ...]) -> DataFrame:
    """(page_id, bookmaker, home, draw, away) of rows of class odds-1x2 whose first cell names a wanted bookmaker; the first row of a bookmaker counts. Odds have a title with start and end, or a text."""
    one = rows.where(F.contains("row_class", F.lit("odds-1x2"))).withColumn("bookmaker", F.get("cells", F.lit(0))["text"]).where(F.col("bookmaker").isin(*bookmakers))
    odds = [backfilled(start_and_end(F.coalesce(F.get("cells", F.lit(i))["title"], F.get("cells", F.lit(i))["text"]))).alias(n) for i, n in enumerate(("home", "draw", "away"), 1)]
    first = one.groupBy("page_id", "bookmaker").agg(F.min_by(F.struct(*odds), "n").alias("o"))
    return first.select("page_id", "bookmaker", "o.*")


def total_odds(rows: DataFrame, totals: tuple[float, ...] = (1.5, 2.5, 3.5)) -> DataFrame:
    """(page_id, bookmaker, total, over, under) of rows of class odds-total: bookmaker, total, over, under; the first of a bookmaker and total counts."""
    cell = lambda i: F.get("cells", F.lit(i))
    one = rows.where(F.contains("row_class", F.lit("odds-total"))).select("page_id", "n", cell(0)["text"].alias("bookmaker"), number(cell(1)["text"]).alias("total"), *[backfilled(start_and_end(F.coalesce(cell(i)["title"], cell(i)["text"]))).alias(k) for i, k in ((2, "over"), (3, "under"))])
    first = one.where(F.col("total").isin(*totals)).groupBy("page_id", "bookmaker", "total").agg(F.min_by(F.struct("over", "under"), "n").alias("o"))
    return first.select("page_id", "bookmaker", "total", "o.*")


def stat_rows(rows: DataFrame) -> DataFrame:
    """(page_id, stat, home, away) of rows of class stat: home, label, away, of the known labels; the first of a label counts."""
    known = F.create_map(*[F.lit(x) for pair in STAT_LABELS.items() for x in pair])
    cell = lambda i: F.get("cells", F.lit(i))["text"]
    one = rows.where(F.col("row_class").rlike(r"(^|\s)stat(\s|$)")).select("page_id", "n", F.try_element_at(known, cell(1)).alias("stat"), number(cell(0)).alias("home"), number(cell(2)).alias("away")).where("stat is not null")
    return one.groupBy("page_id", "stat").agg(F.min_by(F.struct("home", "away"), "n").alias("v")).select("page_id", "stat", "v.*")


def wide_stats(stats: DataFrame, missing: float = -1.0) -> DataFrame:
    """One row a page with home_ and away_ of every known statistic; those that a page lacks are `missing`."""
    sides = [F.coalesce(F.max(F.when(F.col("stat") == s, F.col(side))), F.lit(missing)).alias(f"{side}_{s}") for s in STAT_LABELS.values() for side in ("home", "away")]
    return stats.groupBy("page_id").agg(*sides)


def url_parts(url: Column) -> Column:
    """struct(base, middle, last): scheme and host, the path between, and its last part."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/]+/?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.struct(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1).alias("base"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("middle"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("last"))

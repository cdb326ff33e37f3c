"""Data quality: missingness by any scope, distributions, coverage, and rules whose findings are one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import lineup_bucket, missing_stat, ratio

FINDING = ["code", "severity", "entity", "entity_id", "message"]


def stat_rows(matches: DataFrame, keys: list[str], stats: list[str]) -> DataFrame:
    """One row for each match and statistic: keys, stat, value."""
    return matches.select(*keys, *[F.col(s).cast("double").alias(s) for s in stats]).unpivot(keys, stats, "stat", "value")


def missingness(rows: DataFrame, keys: list[str], zero_is_missing: tuple[str, ...] = ()) -> DataFrame:
    """Missing, zero and all values of each group of stat_rows, and the missing percentage."""
    got = rows.groupBy(*keys).agg(
        F.count_if(missing_stat(F.col("stat"), F.col("value"), zero_is_missing)).alias("n_missing"), F.count_if(F.col("value") == 0).alias("n_zero"), F.count("*").alias("n_total")
    )
    return got.withColumn("missing_pct", 100 * F.col("n_missing") / F.col("n_total"))


def rolled_up(fine: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser missingness from a finer one: summed counts, and the worst of the finer percentages."""
    sums = fine.groupBy(*keys).agg(F.sum("n_missing").alias("n_missing"), F.sum("n_total").alias("n_total"), F.max("missing_pct").alias("worst_pct"), F.median("missing_pct").alias("median_pct"))
    return sums.withColumn("missing_pct", 100 * ratio(F.col("n_missing"), F.col("n_total"), 0.0))


def worst_slices(rows: DataFrame, by: str, n: int, ties: list[str]) -> DataFrame:
    """The n worst rows (a report)."""
    return rows.orderBy(F.desc(by), *ties).limit(n)


def pivoted(rows: DataFrame, keys: list[str], column: str, value: str, values: list[str]) -> DataFrame:
    """Means of value for each key (as one label) and each of the given values of column, which become columns."""
    return rows.groupBy(F.concat_ws(" | ", *keys).alias("row")).pivot(column, values).agg(F.avg(value))


def same_shape(left: DataFrame, right: DataFrame, key: str = "row") -> tuple[DataFrame, DataFrame]:
    """Both pivots with the union of their rows and columns."""
    columns = sorted({*left.columns, *right.columns} - {key})
    keys = left.select(key).union(right.select(key)).distinct()
    full = [keys.join(x, key, "left").select(key, *[F.col(c) if c in x.columns else F.lit(None).cast("double").alias(c) for c in columns]) for x in (left, right)]
    return full[0], full[1]


def distribution(rows: DataFrame, keys: list[str], value: str = "value", recommended: float = 0.99) -> DataFrame:
    """n, mean, population deviation, ends, exact percentiles (linear interpolation) and the recommended one."""
    v = F.col(value)
    cuts = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p97": 0.97, "p99": 0.99, "recommended": recommended}
    seen = rows.where(v.isNotNull() & ~F.isnan(v))
    got = seen.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.array(*[F.lit(x) for x in cuts.values()])).alias("_p"))
    return got.select(*keys, "n", "mean", "std", "least", "most", *[F.get("_p", F.lit(i)).alias(k) for i, k in enumerate(cuts)])


def with_totals(rows: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows with share: of n over all rows (one row for each key passes one window)."""
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy()))


def position_counts(players: DataFrame, column: str = "positions") -> DataFrame:
    """Players for each position of a comma list."""
    one = players.select(F.explode(F.array_distinct(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)))).alias("position")).where("position <> ''")
    return with_totals(one.groupBy("position").agg(F.count("*").alias("n")), "position")


def lineup_coverage(lineups: DataFrame, matches: DataFrame) -> DataFrame:
    """Sides of matches by competition, season and line-up bucket, with totals of each (grouping sets)."""
    sizes = lineups.groupBy("match_id", "side").agg(F.count("*").alias("size"))
    sides = matches.select("match_id", "competition", "season", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    rows = sides.join(sizes, ["match_id", "side"], "left").withColumn("bucket", lineup_bucket(F.coalesce("size", F.lit(0))))
    sets = rows.groupingSets([["competition", "season", "bucket"], ["bucket"]], "competition", "season", "bucket")
    return sets.agg(F.count("*").alias("n"))


def matrix_cells(strength: DataFrame, keys: list[str], column: str = "matrix") -> DataFrame:
    """Observed and all cells, and rows with any observed cell, of matrices by keys."""
    flat = F.flatten(column)
    rows = strength.withColumn("_o", F.size(F.filter(flat, lambda x: x >= 0))).withColumn("_n", F.size(flat)).withColumn("_r", F.size(F.filter(F.col(column), lambda r: F.exists(r, lambda x: x >= 0))))
    return rows.groupBy(*keys).agg(F.sum("_o").alias("observed"), F.sum("_n").alias("cells"), F.sum("_r").alias("rows_observed"))


def finding(rows: DataFrame, code: str, severity: str, entity: str, entity_id: Column, message: str) -> DataFrame:
    """Rows that break a rule, as findings."""
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(entity).alias("entity"), entity_id.cast("string").alias("entity_id"), F.lit(message).alias("message"))


def report(findings: list[DataFrame], examples: int = 5) -> DataFrame:
    """code, severity, count and the ids of the first examples (smallest; a bounded list however many there are) of the union of findings."""
    every = reduce(DataFrame.unionByName, findings)
    counts = every.groupBy("code").agg(F.min("severity").alias("severity"), F.max("severity").alias("_other"), F.count("*").alias("count"))
    counts = counts.withColumn("severity", F.when(F.col("severity") == F.col("_other"), F.col("severity")).otherwise(F.raise_error(F.lit("a code has two severities")))).drop("_other")
    nth = F.row_number().over(Window.partitionBy("code").orderBy("entity_id"))
    some = every.withColumn("nth", nth).where(F.col("nth") <= examples).groupBy("code").agg(F.array_sort(F.collect_list("entity_id")).alias("examples"))
    return counts.join(some, "code")


def match_findings(matches: DataFrame, teams: DataFrame, first_season: int, last_season: int) -> list[DataFrame]:
    """Rules on matches: references, goals, dates, seasons, repeated ids."""
    m = F.col("match_id")
    repeated = matches.groupBy("match_id").count().where("count > 1")
    known = teams.select(F.col("team_id"))
    out = [
        finding(matches.where("home_id = away_id"), "same_team", "critical", "match", m, "a team plays itself"),
        finding(matches.where("home_goals is null or away_goals is null or home_goals < 0 or away_goals < 0"), "bad_goals", "critical", "match", m, "goals are missing or negative"),
        finding(matches.where("dt is null"), "no_date", "critical", "match", m, "the date is missing"),
        finding(matches.where((F.col("season") < first_season) | (F.col("season") >= last_season)), "season_range", "critical", "match", m, "the season is out of range"),
        finding(repeated, "repeated_match", "critical", "match", m, "the id is there more than once"),
    ]
    for side in ("home", "away"):
        unknown = matches.where(F.col(f"{side}_id").isNotNull()).join(known, F.col(f"{side}_id") == F.col("team_id"), "left_anti")
        out.append(finding(unknown, f"unknown_{side}", "critical", "match", m, f"the {side} team is not in teams"))
        out.append(finding(matches.where(F.col(f"{side}_id").isNull()), f"missing_{side}", "warning", "match", m, f"the {side} team is missing"))
    return out


def roster_findings(rosters: DataFrame, players: DataFrame) -> list[DataFrame]:
    """Rules on rosters(team_id, season, player_id)."""
    twice = rosters.groupBy("team_id", "season", "player_id").count().where("count > 1")
    key = F.concat_ws("|", "team_id", "season", "player_id")
    return [
        finding(twice, "roster_repeats", "warning", "roster", key, "a player is listed twice"),
        finding(rosters.join(players.select("player_id"), "player_id", "left_anti"), "roster_unknown_player", "critical", "roster", key, "a player is not in players"),
    ]


def conservation(row: DataFrame, laws: dict[str, str]) -> DataFrame:
    """Findings of a one-row summary for laws (code -> SQL condition that must hold)."""
    bad = F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(code)) for code, sql in laws.items()])
    broken = row.select(F.explode(F.array_compact(bad)).alias("code"))
    return broken.select("code", F.lit("critical").alias("severity"), F.lit("summary").alias("entity"), F.lit("summary").alias("entity_id"), F.lit("a sum does not hold").alias("message"))


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame that the other lacks, repeats counted (determinism of two runs: none)."""
    return a.exceptAll(b).union(b.exceptAll(a))


def skill_missingness(skills: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and all values of skill rows (snap_date, …, skill_no, skill) by keys and skill, with the number of snapshot dates."""
    missing = F.col("skill").isNull() | (F.col("skill") < 0) | F.isnan("skill")
    got = skills.groupBy(*keys, "skill_no").agg(F.count_if(missing).alias("n_missing"), F.count("*").alias("n_total"), F.countDistinct("snap_date").alias("snapshots"))
    return got.withColumn("missing_pct", 100 * F.col("n_missing") / F.col("n_total"))


def nearest_snapshot(days: DataFrame, snapshots: DataFrame, key: list[str]) -> DataFrame:
    """For each row of days(key, day) the snapshot date nearest to it (of two the earlier).

    The window runs over distinct dates alone, whose number the calendar bounds; rows find theirs by an equi-join on the day.
    """
    dates = snapshots.select(F.col("snap_date").alias("d"), F.col("snap_date").alias("snap")).distinct()
    asked = days.select(F.col("day").alias("d"), F.lit(None).cast("date").alias("snap")).distinct()
    both = asked.union(dates)
    whole = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("snap", ignorenulls=True).over(whole(Window.orderBy("d", F.col("snap").isNull())))
    after = F.last("snap", ignorenulls=True).over(whole(Window.orderBy(F.desc("d"), F.col("snap").isNull())))
    found = both.withColumn("_b", before).withColumn("_a", after).where("snap is null")
    first = F.col("_a").isNull() | (F.datediff("d", "_b") <= F.datediff("_a", "d"))
    near = found.select(F.col("d").alias("day"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("snap_date"))
    return days.select(*key, "day").join(near, "day")


def cell_comparison(old: DataFrame, new: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Cells of two matrices of the same rows: observed in both, in one only, in neither, and those that differ, by keys."""
    paired = old.select(*on, *[k for k in keys if k not in on], F.flatten("matrix").alias("_o")).join(new.select(*on, F.flatten("matrix").alias("_n")), on)
    cells = paired.select(*keys, F.explode(F.arrays_zip("_o", "_n")).alias("c")).select(*keys, F.col("c._o").alias("o"), F.col("c._n").alias("n"))
    seen_old, seen_new = F.coalesce(F.col("o") >= 0, F.lit(False)), F.coalesce(F.col("n") >= 0, F.lit(False))
    return cells.groupBy(*keys).agg(
        F.count_if(seen_old & seen_new).alias("both"), F.count_if(seen_old & ~seen_new).alias("old_only"), F.count_if(~seen_old & seen_new).alias("new_only"),
        F.count_if(~seen_old & ~seen_new).alias("neither"), F.count_if(seen_old & seen_new & (F.col("o") != F.col("n"))).alias("differ"),
    )


def readiness(rows: DataFrame, arrays: dict[str, int], ids: dict[str, int], key: str) -> list[DataFrame]:
    """Findings on model rows: array lengths, finite values, dense ids in range."""
    out = []
    for name, n in arrays.items():
        out.append(finding(rows.where(F.coalesce(F.size(name), F.lit(-1)) != n), f"{name}_size", "critical", "row", F.col(key), f"{name} has not {n} values"))
        odd = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        out.append(finding(rows.where(F.coalesce(odd, F.lit(False))), f"{name}_finite", "critical", "row", F.col(key), f"{name} has values that are not finite"))
    for name, n in ids.items():
        out.append(finding(rows.where(F.coalesce((F.col(name) < 0) | (F.col(name) >= n), F.lit(True))), f"{name}_range", "critical", "row", F.col(key), f"{name} is not from 0 to {n - 1}"))
    return out

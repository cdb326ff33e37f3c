"""Betting utility: implied probabilities, opportunities, simulated bets by any grid of groups, calibrated methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.ordered import with_rank, with_running_profit
from touchline.functions.scalars import odds_or_null, ratio

SIDES = ("all", "under", "over")
BET_COLUMNS = ("num_bets", "wins", "hit_rate", "mean_odds", "mean_edge", "mean_ev", "mean_fair_probability", "total_profit", "roi", "max_drawdown")


def implied(predictions: DataFrame) -> DataFrame:
    """predictions(…, under_odds, over_odds) with raw and fair probabilities and the margin; rows without two prices go."""
    rows = predictions.withColumn("under_odds", odds_or_null(F.col("under_odds"))).withColumn("over_odds", odds_or_null(F.col("over_odds"))).where("under_odds is not null and over_odds is not null")
    rows = rows.withColumn("raw_under", 1 / F.col("under_odds")).withColumn("raw_over", 1 / F.col("over_odds"))
    total = F.col("raw_under") + F.col("raw_over")
    return rows.withColumn("fair_under", F.col("raw_under") / total).withColumn("fair_over", F.col("raw_over") / total).withColumn("margin", total - 1)


def opportunities(priced: DataFrame) -> DataFrame:
    """Both sides of each priced match: side, probability, odds, edge, disagreement, ev, won, profit."""

    def side(name: str, p: Column, won: Column) -> Column:
        odds, raw, fair = F.col(f"{name}_odds"), F.col(f"raw_{name}"), F.col(f"fair_{name}")
        profit = F.when(won, odds - 1).otherwise(F.lit(-1.0))
        values = {"side": F.lit(name), "probability": p, "odds": odds, "fair_probability": fair, "edge": p - raw, "disagreement": p - fair, "ev": p * odds - 1, "won": won.cast("int"), "profit": profit}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    under, over = side("under", F.col("p_under"), F.col("y_true") == 1), side("over", 1 - F.col("p_under"), F.col("y_true") == 0)
    kept = ["match_id", "season", "competition", "dt", "margin", *(["method"] if "method" in priced.columns else [])]
    return priced.select(*kept, F.explode(F.array(under, over)).alias("o")).select(*kept, "o.*")


def best_sides(rows: DataFrame, by: str = "edge", keys: tuple[str, ...] = ("match_id",)) -> DataFrame:
    """The better side of each match (and method, if that is among keys); ties go to under."""
    columns = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*columns), F.struct(F.col(by), (F.col("side") == "under").cast("int")))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def summarised(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Summary of the bets of each group, in chronological order for the drawdown."""
    rows = with_running_profit(bets, keys, "dt", ["match_id"], "profit")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("num_bets"), F.sum("won").alias("wins"), F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("odds").alias("mean_odds"), F.avg("edge").alias("mean_edge"),
        F.avg("ev").alias("mean_ev"), F.avg("fair_probability").alias("mean_fair_probability"), F.sum("profit").alias("total_profit"),
        F.avg("profit").alias("roi"), F.max("drawdown").alias("max_drawdown"),
    )


def on_grid(summary: DataFrame, grid: DataFrame, keys: list[str], eligible: Column) -> DataFrame:
    """Every cell of the grid: empty ones have no bets, no ratios and no profit. coverage: bets over the eligible matches."""
    got = grid.join(summary, keys, "left")
    for c in ("num_bets", "wins"):
        got = got.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    for c in ("total_profit", "max_drawdown"):
        got = got.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return got.withColumn("coverage", F.col("num_bets") / F.greatest(eligible, F.lit(1)))


def _threshold_cells(best: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Each bet once for each threshold that its edge reaches and for its side and 'all'."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("edge"))
    return best.withColumn("threshold", F.explode(reached)).withColumn("chosen", F.explode(F.array(F.lit("all"), F.col("side")))).drop("side").withColumnRenamed("chosen", "side")


def threshold_grid(best: DataFrame, thresholds: tuple[float, ...] = C.THRESHOLDS, by: str | None = None) -> DataFrame:
    """Thresholds x sides (x the values of a column, which then have their own eligible matches)."""
    keys = [*([by] if by else []), "threshold", "side"]
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("side")) for t in thresholds for s in SIDES])
    groups = best.groupBy(by).agg(F.count("*").alias("eligible")) if by else best.agg(F.count("*").alias("eligible"))
    grid = groups.withColumn("c", F.explode(cells)).select(*groups.columns, "c.*")
    return on_grid(summarised(_threshold_cells(best, thresholds), keys), grid, keys, F.col("eligible"))


def band(value: Column, bounds: tuple[float, ...]) -> Column:
    """Number (from 0) of the half-open band that holds a value; null below the first."""
    out = F.when(value >= bounds[-1], len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        out = out.when(value >= bounds[i], i)
    return out.cast("int")


def banded_grid(best: DataFrame, column: str, bounds: tuple[float, ...], thresholds: tuple[float, ...] = C.THRESHOLDS) -> DataFrame:
    """Thresholds x sides x bands of a column, empty cells included."""
    keys = ["threshold", "side", "band"]
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("side"), F.lit(b).alias("band")) for t in thresholds for s in SIDES for b in range(len(bounds))])
    grid = best.agg(F.count("*").alias("eligible")).withColumn("c", F.explode(cells)).select("eligible", "c.*")
    rows = _threshold_cells(best.withColumn("band", band(F.col(column), bounds)).where("band is not null"), thresholds)
    return on_grid(summarised(rows, keys), grid, keys, F.col("eligible"))


def edge_bins(best: DataFrame, bounds: tuple[float, ...] = C.EDGE_BINS) -> DataFrame:
    """Fixed edge bins, empty ones included, with the number of candidates of non-negative edge."""
    grid = best.agg(F.count("*").alias("eligible"), F.count_if(F.col("edge") >= 0).alias("positive")).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1))))
    rows = best.withColumn("band", band(F.col("edge"), bounds)).where("band is not null")
    return on_grid(summarised(rows, ["band"]), grid, ["band"], F.col("eligible"))


def _ranked(best: DataFrame, by: str, then: str, descending: bool) -> DataFrame:
    positive = best.where(F.col(by) >= 0)
    order = [F.desc(by), F.desc(then), F.asc("match_id")] if descending else [F.asc(by), F.asc("match_id")]
    return with_rank(positive, F.floor(F.col(by) * 1000), order, descending)


def quantile_bins(best: DataFrame, by: str = "edge", quantiles: int = 10) -> DataFrame:
    """Equal-count bins of the candidates with a non-negative edge (or ev), the first ones larger by one where they do not divide; ties by match_id."""
    if quantiles < 2:
        raise ValueError("at least two quantiles")
    size, extra = F.floor(F.col("n") / quantiles), F.col("n") % quantiles
    head = extra * (size + 1)
    number = F.when(F.col("rn") <= head, F.floor((F.col("rn") - 1) / (size + 1))).otherwise(extra + F.floor((F.col("rn") - 1 - head) / F.greatest(size, F.lit(1)))) + 1
    ranked = _ranked(best, by, by, False).withColumn("quantile", number.cast("int"))
    ends = ranked.groupBy("quantile").agg(F.min(by).alias("least"), F.max(by).alias("most"))
    grid = best.agg(F.count("*").alias("eligible"), F.count_if(F.col(by) >= 0).alias("positive")).withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(quantiles))))
    return on_grid(summarised(ranked, ["quantile"]), grid.where("positive > 0").join(ends, "quantile", "left"), ["quantile"], F.col("eligible"))


def coverage_curve(best: DataFrame, by: str = "edge", then: str = "ev", levels: tuple[float, ...] = C.COVERAGE_LEVELS) -> DataFrame:
    """The best candidates up to each share (at least one, rounded up); a count that an earlier level gave is left out."""
    wanted = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(x).alias("level")) for i, x in enumerate(levels)])
    totals = best.agg(F.count("*").alias("eligible"), F.count_if(F.col(by) >= 0).alias("positive")).withColumn("w", F.explode(wanted))
    counts = totals.select("eligible", "positive", "w.*").withColumn("k", F.when(F.col("positive") == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("positive") * F.col("level")))))
    levels_kept = counts.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("nth"))).where("_r = 1").drop("_r", "nth")
    ranked = _ranked(best, by, then, True)
    rows = ranked.join(F.broadcast(levels_kept.select("k", "level")), F.col("rn") <= F.col("k"))
    ends = rows.groupBy("level").agg(F.min(by).alias("least"))
    return on_grid(summarised(rows, ["level"]), levels_kept.join(ends, "level", "left"), ["level"], F.col("eligible"))


def temporal_thresholds(best: DataFrame, thresholds: tuple[float, ...] = C.THRESHOLDS, minimum: int = C.MIN_DEVELOPMENT_BETS, side: str | None = None) -> DataFrame:
    """For each season but the first: the threshold of highest ROI over earlier seasons (ties: smaller) with enough bets, and what it earns in the season."""
    if side not in (None, "under", "over"):
        raise ValueError("side must be under, over or None")
    own = best if side is None else best.where(F.col("side") == side)
    bets = own.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("edge"))))
    tests = best.select(F.col("season").alias("test_season")).distinct()
    per = summarised(bets, ["season", "threshold"]).select("season", "threshold", "num_bets", "total_profit", "max_drawdown")
    earlier = tests.join(F.broadcast(best.select("season").distinct()), F.col("season") < F.col("test_season"))
    named = earlier.groupBy("test_season").agg(F.array_join(F.array_sort(F.collect_set(F.col("season").cast("string"))), ",").alias("development_seasons"))
    sums = earlier.join(per, "season").groupBy("test_season", "threshold").agg(F.sum("num_bets").alias("dev_bets"), F.sum("total_profit").alias("dev_profit"))
    able = sums.where(F.col("dev_bets") >= minimum).withColumn("dev_roi", F.col("dev_profit") / F.col("dev_bets"))
    pick = able.withColumn("_r", F.row_number().over(Window.partitionBy("test_season").orderBy(F.desc("dev_roi"), "threshold"))).where("_r = 1").drop("_r")
    result = per.select(F.col("season").alias("test_season"), "threshold", F.col("num_bets").alias("bets"), F.col("total_profit").alias("profit"), F.col("max_drawdown").alias("drawdown"))
    got = named.join(pick, "test_season", "left").join(result, ["test_season", "threshold"], "left")
    zero = lambda c, x: F.coalesce(F.col(c), F.lit(x))
    return got.select(
        "test_season", "development_seasons", F.col("threshold").alias("selected_threshold"), F.when(F.col("threshold").isNull(), "insufficient-development-bets").otherwise("selected").alias("selection_status"),
        zero("dev_bets", 0).alias("development_bets"), F.col("dev_roi").alias("development_roi"), zero("bets", 0).alias("test_bets"),
        ratio(zero("profit", 0.0), zero("bets", 0)).alias("test_roi"), zero("profit", 0.0).alias("test_profit"), zero("drawdown", 0.0).alias("test_drawdown"),
    )


def method_betting(priced: DataFrame, thresholds: tuple[float, ...] = (0.07, 0.10), left_out: str = "bookmaker-fair") -> DataFrame:
    """Bets of each method of priced(method, …), one for each match: thresholds on the better side, on either side or on under only."""
    best = best_sides(opportunities(priced.where(F.col("method") != left_out)), keys=("method", "match_id"))
    keys = ["method", "threshold", "side"]
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(s).alias("side")) for t in thresholds for s in ("all", "under")])
    grid = best.groupBy("method").agg(F.count("*").alias("eligible")).withColumn("c", F.explode(cells)).select("method", "eligible", "c.*")
    return on_grid(summarised(_threshold_cells(best, thresholds), keys), grid, keys, F.col("eligible"))


def ledger(best: DataFrame, threshold: float, position: str) -> DataFrame:
    """The bets at a threshold in the order of position, with running profit and drawdown."""
    rows = best.where(F.col("edge") >= threshold).withColumn("_run", F.floor(F.col(position) / 4096))
    return with_running_profit(rows, [], "_run", [position], "profit").drop("_run")


def first_simulation(best: DataFrame, thresholds: tuple[float, ...], position: str) -> DataFrame:
    """Of each threshold: bets, coverage, hit rate, profit, return and drawdown in the order of position; rates are 0 without a bet."""
    reached = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col("edge"))
    cells = best.withColumn("threshold", F.explode(reached)).withColumn("_run", F.floor(F.col(position) / 4096))
    rows = with_running_profit(cells, ["threshold"], "_run", [position], "profit")
    got = rows.groupBy("threshold").agg(F.count("*").alias("num_bets"), F.avg(F.col("won").cast("double")).alias("hit_rate"), F.sum("profit").alias("total_profit"), F.avg("profit").alias("roi"), F.max("drawdown").alias("max_drawdown"))
    grid = best.agg(F.count("*").alias("eligible")).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    full = grid.join(got, "threshold", "left").na.fill(0, ["num_bets", "hit_rate", "total_profit", "roi", "max_drawdown"])
    return full.withColumn("coverage", F.col("num_bets") / F.greatest("eligible", F.lit(1)))

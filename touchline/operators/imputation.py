"""Fold-local imputation of strength cells: each fold is filled by what its own training rounds hold, and audited.

Cells are rows (…, round_index, competition, position, skill_no, value, provenance), so that a fold's training cells are an equi-join of
rounds with folds, medians are grouped aggregates of three levels, and filling is three joins on their keys. Nothing of a validation round enters its fold's medians.

Provenance: 0 unresolved, 1 and 2 observed, 3 to 5 filled by the median of competition and position, of the position, of all, 6 by the neutral value.

Defined results: null values are unresolved; a fold without training cells is filled with the neutral value; repeated cells count each; an
empty table gives no rows; columns beside those named pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.operators import ratings, validation


def fold_rounds(folds: DataFrame, window: int) -> DataFrame:
    """(fold, round_index, part): the `window` training rounds and the validation round of each of folds(fold)."""
    spans = folds.select("fold", F.explode(F.sequence(F.col("fold") - window, F.col("fold"))).alias("round_index"))
    return spans.withColumn("part", F.when(F.col("round_index") == F.col("fold"), "validation").otherwise("training"))


def impute_folds(cells: DataFrame, folds: DataFrame, window: int, config: C.Imputation = C.Imputation()) -> DataFrame:
    """The cells of each fold's training and validation rounds, with fold, part, the raw value, and value, observed and provenance after filling."""
    own = cells.withColumn("value", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(C.MISSING)))
    placed = own.join(fold_rounds(folds, window), "round_index").withColumn("raw", F.col("value"))
    return ratings.imputed(placed, ratings.skill_medians(placed.where("part = 'training'"), config), config.neutral)


def diagnostics(done: DataFrame) -> DataFrame:
    """(fold, part, provenance): cells, matches and the mean value."""
    return done.groupBy("fold", "part", F.col("provenance").cast("int").alias("provenance")).agg(F.count("*").alias("cells"), F.countDistinct("match_id").alias("matches"), F.avg("value").alias("mean_value"))


def audit(done: DataFrame, key: list[str], most: float = 100.0) -> DataFrame:
    """Findings (code, severity, entity, entity_id, n) on imputed folds: values out of range, masks and provenance that do not fit the raw value, repeats, what was filled.

    Counts of a code come as one finding; codes without a breach give none.
    """
    seen = F.col("raw") >= 0
    rules = {
        "audited_invalid_strength_values": ("critical", ~F.coalesce((F.col("value") >= 0) & (F.col("value") <= most), F.lit(False))),
        "audited_invalid_masks": ("critical", ~F.coalesce(F.col("observed").isin(0, 1), F.lit(False))),
        "audited_mask_mismatches": ("critical", ~F.col("observed").eqNullSafe(seen.cast("int"))),
        "audited_changed_observed_values": ("critical", seen & (F.col("raw") != F.col("value"))),
        "audited_provenance_conservation_failure": ("critical", ~F.coalesce(F.when(seen, F.col("provenance").isin(1, 2)).otherwise(F.col("provenance").between(3, 6)), F.lit(False))),
        "audited_neutral_fallback_cells": ("warning", F.col("provenance") == 6),
        "imputed_cells": ("warning", F.col("provenance").between(3, 5)),
    }
    counted = done.agg(*[F.count_if(bad).alias(code) for code, (_, bad) in rules.items()])
    hits = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("n")) for code, (severity, _) in rules.items()])
    found = counted.select(F.explode(hits).alias("h")).where("h.n > 0").select("h.code", "h.severity", F.lit("imputation").alias("entity"), F.lit("folds").alias("entity_id"), "h.n")
    twice = done.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.sum(F.col("c") - 1).alias("n")).where("n > 0")
    repeats = twice.select(F.lit("repeated_cells").alias("code"), F.lit("critical").alias("severity"), F.lit("imputation").alias("entity"), F.lit("folds").alias("entity_id"), "n")
    return found.unionByName(repeats)


def leaks(sources: DataFrame, max_age: int = C.MAX_AGE_DAYS) -> DataFrame:
    """Findings on observed cells(day, snap_date, value, provenance, age): sources from the future, too old ones, ages that are not the days between, observed cells without a source."""
    days = F.datediff("day", "snap_date")
    seen = F.coalesce(F.col("value") >= 0, F.lit(False))
    rules: list[validation.Rule] = [
        ("future_source_cells", "critical", F.coalesce(days < 0, F.lit(False))),
        ("source_cells_beyond_max_age", "critical", F.coalesce(days > max_age, F.lit(False))),
        ("past_only_age_marker_mismatches", "critical", F.when(seen, ~F.col("age").eqNullSafe(days)).otherwise(F.coalesce(F.col("age") != -1, F.lit(False)))),
        ("invalid_past_only_provenance", "critical", F.when(seen, ~F.coalesce(F.col("provenance").isin(1, 2), F.lit(False))).otherwise(~F.col("provenance").eqNullSafe(F.lit(0)))),
    ]
    return validation.broken(sources, rules, "cell", F.col("match_id"))


def conserved(summaries: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Findings of one-row summaries: for each code, the summary, the expression of the total and that of its parts."""
    parts = [validation.broken(df, [(code, "critical", F.expr(total) != F.expr(sums))], "summary", F.lit(code)) for code, (df, total, sums) in summaries.items()]
    return reduce(DataFrame.unionByName, parts)


def array_inputs(done: DataFrame, players: int = C.PLAYERS, skills: int = C.SKILLS) -> DataFrame:
    """(fold, part, match_id, strength): home values, home mask, away values, away mask, values as shares of 100, rows by slot and skill; cells that are not there are 0."""
    slots = F.map_from_entries(F.collect_list(F.struct((F.col("slot") * skills + F.col("skill_no")).cast("int").alias("k"), F.struct((F.col("value") / 100).alias("v"), F.col("observed").cast("double").alias("o")).alias("c"))))
    sides = done.where((F.col("slot") < players) & (F.col("skill_no") < skills)).groupBy("fold", "part", "match_id", "side").agg(slots.alias("cells"))
    grid = lambda side, field: F.transform(F.sequence(F.lit(0), F.lit(players - 1)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(skills - 1)), lambda s: F.coalesce(F.try_element_at(side, p * skills + s)[field], F.lit(0.0))))
    both = sides.groupBy("fold", "part", "match_id").agg(*[F.first(F.when(F.col("side") == i, F.col("cells")), ignorenulls=True).alias(n) for i, n in enumerate(("home", "away"))])
    return both.select("fold", "part", "match_id", F.array(*[grid(F.col(n), field) for n in ("home", "away") for field in ("v", "o")]).alias("strength"))

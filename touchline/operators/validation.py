"""Validation of a whole data set: domain rules, selection rules, coverage inventory with its laws, and the combined report.

Findings are rows (code, severity, entity, entity_id, n); a severity is critical or warning. Row rules of a table are judged in one pass over it, whatever their number;
rules across tables are equi-joins on ids. Nothing is collected: `rollup` and `combined` give one row for each code or component.

Defined results: a null where a rule asks for a value breaks it; empty tables break only rules that ask for rows; repeated rows count each; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.lineage import cut
from touchline.functions.scalars import ratio

Rule = tuple[str, str, Column]  # code, severity, condition of a breach
SIDES = ("home", "away")
REFERENCES = ("matched", "failed", "missing", "invalid")
BUCKETS = ("empty", "partial", "complete", "oversized")


def broken(rows: DataFrame, rules: list[Rule], entity: str, entity_id: Column) -> DataFrame:
    """Findings of all rules on the rows, in one pass."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, bad in rules]))
    found = rows.select(entity_id.cast("string").alias("entity_id"), F.explode(hits).alias("h"))
    return found.select("h.code", "h.severity", F.lit(entity).alias("entity"), "entity_id", F.lit(1).cast("long").alias("n"))


def rollup(findings: DataFrame, examples: int = 5) -> DataFrame:
    """code, severity, entity, n, and the first ids (as strings); a task sends at most that many rows of a code for them."""
    counts = findings.groupBy("code", "severity", "entity").agg(F.sum("n").alias("n"))
    some = findings.select("code", "entity_id").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("entity_id"))).where(F.col("nth") <= examples)
    return counts.join(some.groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ", ").alias("examples")), "code")


def match_rules(matches: DataFrame, teams: DataFrame, comp_seasons: DataFrame) -> DataFrame:
    """Rules on each match: teams, goals, date, season, and agreement with its comp-season."""
    known = teams.select(F.col("team_id").alias("known")).distinct()
    linked = matches
    for side in SIDES:
        linked = linked.join(known.withColumnRenamed("known", f"known_{side}"), F.col(f"{side}_id") == F.col(f"known_{side}"), "left")
    own = comp_seasons.select("comp_season_id", F.col("season").alias("cs_season"), F.col("name").alias("cs_name"), F.col("country").alias("cs_country"), F.lit(True).alias("cs_known"))
    linked = linked.join(own, "comp_season_id", "left")
    rules: list[Rule] = [("same_home_and_away_team", "critical", F.coalesce(F.col("home_id") == F.col("away_id"), F.lit(False)))]
    for side in SIDES:
        there = F.col(f"{side}_id").isNotNull()
        rules += [
            (f"missing_{side}_team", "warning", ~there),
            (f"unknown_{side}_team", "critical", there & F.col(f"known_{side}").isNull()),
            (f"invalid_{side}_goals", "critical", ~(F.col(f"{side}_goals") >= 0)),
        ]
    has, knows = F.col("comp_season_id").isNotNull(), F.col("cs_known").isNotNull()
    rules += [
        ("invalid_match_datetime", "critical", F.col("dt").isNull()),
        ("invalid_match_season", "critical", ~F.col("season").between(1900, 2100)),
        ("missing_comp_season_id", "critical", ~has),
        ("unknown_comp_season_id", "critical", has & ~knows),
        ("match_comp_season_year_mismatch", "critical", knows & ~F.col("season").eqNullSafe(F.col("cs_season"))),
        ("match_comp_name_mismatch", "critical", knows & ~F.col("competition").eqNullSafe(F.col("cs_name"))),
        ("match_country_mismatch", "critical", knows & ~F.col("country").eqNullSafe(F.col("cs_country"))),
    ]
    return broken(linked, rules, "match", F.col("match_id"))


def membership_rules(matches: DataFrame, membership: DataFrame) -> DataFrame:
    """Rules on membership(comp_season_id, match_id): repeats, matches that are not there or are filed elsewhere, matches in no or several comp-seasons."""
    own = matches.select("match_id", F.col("comp_season_id").alias("own"), F.lit(True).alias("there"))
    pairs = membership.groupBy("comp_season_id", "match_id").agg(F.count("*").alias("times"))
    repeats = pairs.where("times > 1").select(
        F.lit("duplicate_comp_season_match_reference").alias("code"), F.lit("critical").alias("severity"), F.lit("competition-season").alias("entity"),
        F.col("comp_season_id").cast("string").alias("entity_id"), (F.col("times") - 1).alias("n"),
    )
    joined = membership.join(own, "match_id", "left")
    rules: list[Rule] = [
        ("detached_comp_season_match_reference", "warning", F.col("there").isNull()),
        ("comp_season_match_link_mismatch", "critical", F.col("there").isNotNull() & ~F.col("own").eqNullSafe(F.col("comp_season_id"))),
    ]
    references = broken(joined, rules, "competition-season", F.col("comp_season_id"))
    n = matches.select("match_id").join(pairs.groupBy("match_id").agg(F.count("*").alias("seasons")), "match_id", "left")
    links = broken(n, [("match_missing_from_comp_season", "critical", F.col("seasons").isNull()), ("match_in_multiple_comp_seasons", "critical", F.coalesce(F.col("seasons") > 1, F.lit(False)))], "match", F.col("match_id"))
    return repeats.unionByName(references).unionByName(links)


def lineup_rules(lineups: DataFrame, players: DataFrame) -> DataFrame:
    """Rules on lineups(match_id, side 0/1, player_id): repeats on a side, unknown players, players on both sides, in one pass; n counts the rows of a player in a match."""
    here = [F.col("side") == i for i in range(len(SIDES))]
    listed = lineups.groupBy("match_id", "player_id").agg(*[F.count_if(x).alias(f"n_{side}") for x, side in zip(here, SIDES, strict=True)], *[F.count_if(F.coalesce(x, F.lit(True))).alias(f"at_{side}") for x, side in zip(here, SIDES, strict=True)])
    listed = listed.join(players.select("player_id", F.lit(True).alias("known")).distinct(), "player_id", "left")
    counts = {f"duplicate_{side}_lineup_player": ("warning", F.col(f"n_{side}") - 1) for side in SIDES}
    counts |= {f"unknown_{side}_lineup_player": ("critical", F.when(F.col("known").isNull(), F.col(f"at_{side}"))) for side in SIDES}
    counts["player_in_both_lineups"] = ("warning", F.when((F.col("n_home") > 0) & (F.col("n_away") > 0), F.lit(1).cast("long")))
    hits = F.array_compact(F.array(*[F.when(n > 0, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.alias("n"))) for code, (severity, n) in counts.items()]))
    found = listed.select(F.col("match_id").cast("string").alias("entity_id"), F.explode(hits).alias("h"))
    return found.select("h.code", "h.severity", F.lit("match").alias("entity"), "entity_id", "h.n")


def domain_findings(matches: DataFrame, teams: DataFrame, comp_seasons: DataFrame, membership: DataFrame, lineups: DataFrame, players: DataFrame) -> DataFrame:
    """All domain rules of a data set."""
    parts = [match_rules(matches, teams, comp_seasons), membership_rules(matches, membership), lineup_rules(lineups, players)]
    return reduce(DataFrame.unionByName, parts)


def selection_findings(matches: DataFrame, config: C.Selection, in_scope: DataFrame, selected: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rules on a selection: competitions without matches, seasons without listed rounds, faulty selected matches, and rounds of them.

    in_scope and selected: `league.select_matches` without and with the round filter; rounds: (match_id, round_index) of `sequential.greedy_rounds` over the selected ones.
    """
    spark = matches.sparkSession
    named = spark.createDataFrame([(c,) for c in config.competitions], "competition string").distinct()
    absent = named.join(in_scope, "competition", "left_anti")
    listed = spark.createDataFrame([*config.rounds] or [], "competition string, season long").distinct()
    unlisted = in_scope.select("competition", "season").distinct().join(listed, ["competition", "season"], "left_anti")
    core: list[Rule] = [
        *[(f"selected_match_missing_{s}_team", "critical", F.col(f"{s}_id").isNull()) for s in SIDES],
        ("selected_match_same_home_and_away_team", "critical", F.coalesce(F.col("home_id") == F.col("away_id"), F.lit(False))),
        ("selected_match_invalid_datetime", "critical", F.col("dt").isNull()),
        *[(f"selected_match_invalid_{s}_goals", "critical", ~(F.col(f"{s}_goals") >= 0)) for s in SIDES],
    ]
    everything = F.lit("all")
    counts = selected.agg(F.count("*").alias("s")).join(rounds.agg(F.count("*").alias("r")))
    placed = rounds.join(selected.select("match_id", F.explode(F.array("home_id", "away_id")).alias("team_id")), "match_id")
    twice = placed.groupBy("round_index", "team_id").agg(F.count("*").alias("times")).where("times > 1")
    return reduce(
        DataFrame.unionByName,
        [
            broken(absent, [("configured_competition_missing", "critical", F.lit(True))], "competition", F.col("competition")),
            broken(unlisted, [("missing_round_whitelist", "critical", F.lit(True))], "competition-season", F.concat_ws(" ", "competition", "season")),
            broken(selected, core, "match", F.col("match_id")),
            broken(counts, [("no_selected_matches", "critical", F.col("s") == 0)], "selection", everything),
            broken(counts, [("round_match_count_mismatch", "critical", F.col("s") != F.col("r"))], "rounds", everything),
            broken(twice, [("team_repeated_within_round", "critical", F.lit(True))], "round", F.col("round_index")),
        ],
    )


def matrix_counts(strength: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(match_id, side, ok, observed, rows_missing, rows_partial, rows_observed) of strength(match_id, side, matrix); counts of a matrix of another shape are 0."""
    valid = (F.size("matrix") == shape[0]) & F.forall("matrix", lambda r: F.size(r) == shape[1])
    seen = F.transform("matrix", lambda r: F.size(F.filter(r, lambda x: F.coalesce((x >= 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False)))))
    cells = strength.select("match_id", "side", F.coalesce(valid, F.lit(False)).alias("ok"), F.when(valid, seen).alias("seen"))
    of_rows = lambda keep: F.coalesce(F.size(F.filter("seen", keep)), F.lit(0))
    observed = F.coalesce(F.aggregate("seen", F.lit(0), lambda a, x: a + x), F.lit(0))
    rows = {"rows_missing": lambda x: x == 0, "rows_partial": lambda x: (x > 0) & (x < shape[1]), "rows_observed": lambda x: x == shape[1]}
    return cells.select("match_id", "side", "ok", F.when(F.col("ok"), observed).otherwise(0).alias("observed"), *[F.when(F.col("ok"), of_rows(keep)).otherwise(0).alias(name) for name, keep in rows.items()])


def cell_counts(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """What `matrix_counts` gives, and lost cells (below 0 or null) and rows that have no others (empty), of cells(match_id, side, slot, skill_no, value) without building the matrices."""
    value = F.col("value")
    seen, lost = F.coalesce((value >= 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False)), F.coalesce(value < 0, F.lit(True))
    rows = cells.groupBy("match_id", "side", "slot").agg(F.count("*").alias("width"), F.count_if(seen).alias("seen"), F.count_if(lost).alias("lost"))
    counts = {
        "observed": F.sum("seen"), "rows_missing": F.count_if(F.col("seen") == 0), "rows_partial": F.count_if((F.col("seen") > 0) & (F.col("seen") < shape[1])), "rows_observed": F.count_if(F.col("seen") == shape[1]),
        "lost": F.sum("lost"), "empty": F.count_if(F.col("lost") == shape[1]),
    }
    ok = (F.count("*") == shape[0]) & F.bool_and(F.col("width") == shape[1])
    made = rows.groupBy("match_id", "side").agg(ok.alias("ok"), *[c.alias(name) for name, c in counts.items()])
    return made.select("match_id", "side", "ok", *[F.when(F.col("ok"), F.col(name)).otherwise(0).alias(name) for name in counts])


def coverage_inventory(
    matches: DataFrame, lineups: DataFrame, rated: DataFrame, clubs: DataFrame, strength: DataFrame, shape: tuple[int, int] = (C.PLAYERS, C.SKILLS)
) -> DataFrame:
    """One row for each (competition, season), and one with nulls for all: what line-ups, player and team mappings and strength matrices cover.

    matches(match_id, competition, season, home_id, away_id), lineups(match_id, side 0/1, player_id, position), rated(player_id, rated_id; not positive: failed),
    clubs(team_id, club_id; not positive: unmapped on purpose), strength(match_id, side, matrix) or what `cell_counts` gives. Players and teams are counted once each,
    and in the row for all only.
    """
    sides = matches.select("match_id", "competition", "season", F.posexplode(F.array("home_id", "away_id")).alias("side", "team_id"))
    state = F.when(~F.coalesce(F.col("player_id") > 0, F.lit(False)), "invalid").when(F.col("listed").isNull(), "missing").when(F.col("rated_id") > 0, "matched").otherwise("failed")
    map_ = rated.select("player_id", "rated_id", F.lit(True).alias("listed"))
    references = lineups.join(matches.select("match_id"), "match_id", "left_semi").join(map_, "player_id", "left").select("match_id", "side", "player_id", "position", state.alias("state"))
    per_side = references.groupBy("match_id", "side").agg(
        F.count("*").alias("references"), *[F.count_if(F.col("state") == s).alias(f"references_{s}") for s in REFERENCES], F.count_if(F.col("position") == "Goalkeeper").alias("keepers")
    )
    cells = (matrix_counts(strength, shape) if "matrix" in strength.columns else strength).withColumn("there", F.lit(True))
    wide = sides.join(per_side, ["match_id", "side"], "left").join(cells, ["match_id", "side"], "left")
    wide = wide.select(
        "competition", "season", "match_id", "side", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("references", *(f"references_{s}" for s in REFERENCES), "keepers")],
        F.col("there").isNotNull().alias("there"), F.coalesce("ok", F.lit(False)).alias("ok"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "rows_missing", "rows_partial", "rows_observed")],
    )
    n = F.col("references")
    bucket = F.when(n == 0, "empty").when(n < shape[0], "partial").when(n == shape[0], "complete").otherwise("oversized")
    full = shape[0] * shape[1]
    sums = {
        "matches": F.count_if(F.col("side") == 0), "sides": F.count("*"), **{f"lineups_{b}": F.count_if(bucket == b) for b in BUCKETS}, "lineups_without_goalkeeper": F.count_if(F.col("keepers") == 0),
        "references": F.sum("references"), **{f"references_{s}": F.sum(f"references_{s}") for s in REFERENCES},
        "matrices": F.count("*"), "matrices_valid": F.count_if("ok"), "matrices_missing": F.count_if(~F.col("there")), "matrices_invalid": F.count_if(F.col("there") & ~F.col("ok")),
        "cells": F.count_if("ok") * full, "cells_observed": F.sum("observed"), "rows_missing": F.sum("rows_missing"), "rows_partial": F.sum("rows_partial"), "rows_observed": F.sum("rows_observed"),
        "matrices_unobserved": F.count_if(F.col("ok") & (F.col("observed") == 0)), "matrices_observed": F.count_if(F.col("ok") & (F.col("observed") == full)),
    }
    scoped = wide.groupingSets([["competition", "season"], []], "competition", "season").agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in sums.items()], (F.grouping_id() > 0).alias("total"))
    once = references.where("state <> 'invalid'").groupBy("player_id").agg(F.first("state").alias("state"))
    players = once.agg(F.count("*").alias("players"), *[F.count_if(F.col("state") == s).alias(f"players_{s}") for s in REFERENCES[:3]])
    asked = sides.where("team_id is not null").select("team_id").distinct().join(clubs.select("team_id", "club_id", F.lit(True).alias("listed")), "team_id", "left")
    teams = asked.agg(F.count("*").alias("teams"), F.count_if(F.col("club_id") > 0).alias("teams_mapped"), F.count_if(F.col("listed").isNull()).alias("teams_missing"), F.count_if(F.col("listed").isNotNull() & ~F.coalesce(F.col("club_id") > 0, F.lit(False))).alias("teams_unmapped"))
    out = scoped.join(players.join(teams).withColumn("total", F.lit(True)), "total", "left")
    out = out.withColumn("cells_missing", F.col("cells") - F.col("cells_observed"))
    rate = lambda a, b: F.when(F.col(b).isNotNull(), ratio(F.col(a), F.col(b), 0.0))
    return out.select("*", rate("teams_mapped", "teams").alias("team_rate"), rate("players_matched", "players").alias("player_rate"), rate("references_matched", "references").alias("reference_rate"), rate("cells_observed", "cells").alias("cell_rate"))


#: What must hold in the row for all, and counts there that are worth a warning or worse.
LAWS = {
    "lineup_side_count_mismatch": "sides = lineups_empty + lineups_partial + lineups_complete + lineups_oversized",
    "lineup_reference_count_mismatch": "references = references_matched + references_failed + references_missing + references_invalid",
    "unique_player_status_count_mismatch": "players = players_matched + players_failed + players_missing",
    "selected_team_mapping_count_mismatch": "teams = teams_mapped + teams_missing + teams_unmapped",
    "strength_matrix_count_mismatch": "matrices = matrices_valid + matrices_missing + matrices_invalid",
    "strength_side_count_mismatch": "sides = matrices",
    "strength_cell_count_mismatch": "cells = cells_observed + cells_missing",
}
COUNTS = {
    "invalid_selected_lineup_player_references": ("critical", "references_invalid"), "invalid_strength_matrices": ("critical", "matrices_invalid"), "incomplete_selected_team_mapping": ("critical", "teams_missing + teams_unmapped"),
    "noncomplete_lineups": ("warning", "lineups_empty + lineups_partial + lineups_oversized"), "lineups_without_explicit_goalkeeper": ("warning", "lineups_without_goalkeeper"),
    "unmatched_lineup_player_references": ("warning", "references_failed + references_missing"), "unmatched_unique_lineup_players": ("warning", "players_failed + players_missing"),
    "missing_strength_matrices": ("warning", "matrices_missing"), "fully_missing_strength_matrices": ("warning", "matrices_unobserved"), "missing_strength_cells": ("warning", "cells_missing"),
    "fully_missing_strength_rows": ("warning", "rows_missing"), "partially_missing_strength_rows": ("warning", "rows_partial"),
}
RATES = ("team_rate", "player_rate", "reference_rate", "cell_rate")


def coverage_findings(inventory: DataFrame) -> DataFrame:
    """Laws, counts and rates of an inventory's row for all, gaps of its scopes, and whether the scopes' matches sum to it."""
    inventory = cut(inventory)  # a row for each scope, read by several rules
    all_, scopes = inventory.where("total"), inventory.where("not total")
    scope = F.lit("selected-scope")
    laws = broken(all_, [(code, "critical", ~F.expr(law)) for code, law in LAWS.items()], "coverage", scope)
    hits = F.array_compact(F.array(*[F.when(F.expr(n) > 0, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.expr(n).cast("long").alias("n"))) for code, (severity, n) in COUNTS.items()]))
    counts = all_.select(F.explode(hits).alias("h")).select("h.code", "h.severity", F.lit("coverage").alias("entity"), scope.alias("entity_id"), "h.n")
    listed = all_.select(F.explode(F.array(*[F.struct(F.lit(r).alias("metric"), F.col(r).alias("rate")) for r in RATES])).alias("r")).select("r.*")
    rates = broken(listed, [("invalid_coverage_rate", "critical", ~F.col("rate").between(0, 1))], "metric", F.col("metric"))
    gaps = broken(scopes, [("competition_season_player_match_gap", "warning", F.col("reference_rate") < 1), ("competition_season_strength_gap", "warning", F.col("cell_rate") < 1)], "competition-season", F.concat_ws(" ", "competition", "season"))
    sums = inventory.agg(F.sum(F.when(F.col("total"), F.col("matches"))).alias("a"), F.coalesce(F.sum(F.when(~F.col("total"), F.col("matches"))), F.lit(0)).alias("b"))
    total = broken(sums, [("competition_season_match_total_mismatch", "critical", F.col("a") != F.col("b"))], "coverage", F.lit("competition-seasons"))
    return reduce(DataFrame.unionByName, [laws, counts, rates, gaps, total])


def combined(components: dict[str, DataFrame]) -> DataFrame:
    """component, critical, warnings, ok: a row for each component's findings and one (`overall`) for all."""
    spark = next(iter(components.values())).sparkSession
    sums = {name: cut(f.groupBy("severity").agg(F.sum("n").alias("n"))) for name, f in components.items()}  # two rows each; one plan after another
    rows = reduce(DataFrame.unionByName, [f.select(F.lit(name).alias("component"), "severity", "n") for name, f in sums.items()])
    every = spark.createDataFrame([(name,) for name in components], "component string")
    zero = every.select("component", F.lit("none").alias("severity"), F.lit(0).cast("long").alias("n"))
    counted = rows.unionByName(zero).rollup("component").agg(*[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(c) for c, s in (("critical", "critical"), ("warnings", "warning"))])
    return counted.select(F.coalesce("component", F.lit("overall")).alias("component"), "critical", "warnings", (F.col("critical") == 0).alias("ok"))


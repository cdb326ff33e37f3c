"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed to cells (source, language, topic), whose expected tokens in the sample start in proportion. Raking
scales them to one target marginal after another; no cell can give more than its tokens, so a full cell stays full while the others of its level make up
for it. Rounds end when no more than TOLERANCE of the budget moves: the marginals hold, or no sample can have them; after ROUNDS
at the latest. Then all cells that are not full are scaled
to the budget, and a document stays if a uniform value made from its doc_id is below its cell's rate: expected tokens over tokens. `residuals` tells what the
marginals miss. Everything after the sum runs on the cell table, whose rows are the distinct triples, whatever the documents: sums by level with partial aggregation
and joins, no window over all of them; one-row aggregates come to the driver.

Defined results: null source, language or topic is a level of its own; null and blank text has no tokens and topic 'prose'; a cell without tokens
has rate 0 (its documents go) unless the budget covers everything; rows with equal doc_id stay or go together; a null doc_id is drawn by its text; an empty table gives
an empty sample; other columns pass through, whatever their names; those named as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import deleted, fresh, stored, word_count

MARGINS = ("source", "lang", "topic")
TOPICS = (("licence", "[Ll]icen[cs]ed under"), ("contact", "[a-z0-9]@[a-z0-9]"), ("table", " [|] "), ("symbols", "[#*$%&]{3}"))
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS = 40
TOLERANCE = 1e-12
SHARE = 0.5
SEED = "mix-1"

Target = float | Mapping[str, float]


def topic_of(text: str = "text") -> Column:
    """The first topic whose pattern the text holds, or 'prose'."""
    (name, pattern), *rest = TOPICS
    found = F.when(F.col(text).rlike(pattern), name)
    for name, pattern in rest:
        found = found.when(F.col(text).rlike(pattern), name)
    return found.otherwise("prose")


def _level(margin: str) -> Column:
    """A margin's level as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(margin).cast("string")), F.lit("null"))


def _wanted(margin: str, target: Target, share: Column) -> Column:
    """Unnormalised target of a level: its share to a power, or its listed weight (its share where none is listed; None lists the null level)."""
    if isinstance(target, Mapping):
        listed = F.create_map(*[F.lit(x) for k, v in target.items() for x in ("null" if k is None else f"={k}", float(v))])
        return F.coalesce(F.element_at(listed, F.col(f"level_{margin}")), share)
    return F.pow(share, F.lit(float(target)))


def goals(cells: DataFrame, margin: str, target: Target, budget: float) -> DataFrame:
    """(level_<margin>, goal_<margin>): the tokens that each level is to have in the sample."""
    level = f"level_{margin}"
    sums = cells.groupBy(level).agg(F.sum("tokens").alias("t"))
    raw = sums.crossJoin(F.broadcast(sums.agg(F.sum("t").alias("all_t")))).select(level, _wanted(margin, target, F.col("t") / F.col("all_t")).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all_raw")))).select(level, (F.col("raw") / F.col("all_raw") * budget).alias(f"goal_{margin}"))


def _raked(cells: DataFrame, margin: str) -> DataFrame:
    """cells with expected scaled to one marginal: first the cells that are not full, all of them where the full ones alone are too many."""
    level, full = f"level_{margin}", F.col("expected") >= F.col("tokens")
    sums = cells.groupBy(level).agg(F.sum(F.when(full, F.col("expected")).otherwise(0.0)).alias("s_full"), F.sum(F.when(full, 0.0).otherwise(F.col("expected"))).alias("s_free"))
    goal, much = F.col(f"goal_{margin}"), F.col("s_full") >= F.col(f"goal_{margin}")
    factor = F.when(much, goal / (F.col("s_full") + F.col("s_free"))).when(full | (F.col("s_free") == 0), 1.0).otherwise((goal - F.col("s_full")) / F.col("s_free"))
    return cells.join(sums, level).withColumn("expected", F.least("tokens", F.col("expected") * factor)).drop("s_full", "s_free")


def residuals(cells: DataFrame) -> DataFrame:
    """(margin, level, goal, expected): what each level is to have and has of raked cells."""
    rows = [cells.groupBy(F.lit(m).alias("margin"), F.col(f"level_{m}").alias("level")).agg(F.first(f"goal_{m}").alias("goal"), F.sum("expected").alias("expected")) for m in MARGINS]
    return rows[0].union(rows[1]).union(rows[2])


def raked_cells(cells: DataFrame, targets: Mapping[str, Target], share: float, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """cells(source, lang, topic, tokens) with their levels, goals and expected tokens after raking; and the budget."""
    spark = cells.sparkSession
    cells = cells.withColumn("tokens", F.col("tokens").cast("double"))
    cells = stored(cells.select("*", *(_level(m).alias(f"level_{m}") for m in MARGINS)), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    budget, now = share * total, cells.withColumn("expected", F.lit(min(1.0, share)) * F.col("tokens"))
    for m in MARGINS:
        now = now.join(goals(cells, m, targets[m], budget), f"level_{m}")
    now = stored(now, "cells")
    deleted(spark, cells)
    for _ in range(rounds if share < 1 else 0):
        done = now.withColumn("was", F.col("expected"))
        for m in MARGINS:
            done = _raked(done, m)
        done = stored(done, "cells")
        deleted(spark, now)
        moved = done.agg(F.sum(F.abs(F.col("expected") - F.col("was")))).first()[0] or 0.0
        now = done.drop("was")
        if moved <= TOLERANCE * budget:
            break
    return now, budget


def cell_rates(cells: DataFrame, budget: float) -> DataFrame:
    """Raked cells with rate, the probability of each of its documents: expected tokens, scaled to the budget where cells are not full."""
    full, scale = F.col("expected") >= F.col("tokens"), 1.0
    while True:
        full = F.col("expected") * scale >= F.col("tokens")
        row = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("expected")))).first()
        more = max(scale, (budget - (row[0] or 0.0)) / row[1]) if row[1] else scale
        if more <= scale * (1 + 1e-15):
            break
        scale = more
    return cells.withColumn("rate", F.least(F.lit(1.0), F.col("expected") * scale / F.col("tokens")))


def uniform(seed: str) -> Column:
    """A value in [0, 1) made from doc_id (from the text where that is null)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Target] = TARGETS, share: float = SHARE, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The sampled rows of docs with n_tokens, topic, rate and weight (1 / rate); share: expected tokens of all tokens."""
    docs = docs.drop("n_tokens", "topic", "rate", "weight")
    drawn = docs.select("*", word_count("text").alias("n_tokens"), topic_of().alias("topic"))
    if share >= 1:
        return drawn.withColumn("rate", F.lit(1.0)).withColumn("weight", F.lit(1.0))
    cells = drawn.select(*MARGINS, "n_tokens").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    raked, budget = raked_cells(cells, targets, share, rounds)
    keys = fresh(drawn, *(f"of_{m}" for m in MARGINS))
    rates = cell_rates(raked, budget).select(*(F.col(f"level_{m}").alias(k) for m, k in zip(MARGINS, keys, strict=True)), "rate")
    same = [_level(m) == F.col(k) for m, k in zip(MARGINS, keys, strict=True)]
    kept = drawn.join(rates, same[0] & same[1] & same[2]).where(uniform(seed) < F.col("rate"))
    return kept.withColumn("weight", 1 / F.col("rate")).drop(*keys)


#: Rounds of the SQL, which has no loop that ends by itself.
SQL_ROUNDS = 30


def mixed_ctes(docs: str, targets: Mapping[str, float] = TARGETS, share: float = SHARE, rounds: int = SQL_ROUNDS, seed: str = SEED) -> str:
    """DuckDB CTEs after which mix_result holds what mix returns (power targets, share below one) for the relation docs."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    steps, last = [], "mix_c2"
    for i in range(rounds * len(MARGINS)):
        m = MARGINS[i % len(MARGINS)]
        sums = f"sum(CASE WHEN e >= tokens THEN e ELSE 0 END) OVER (PARTITION BY {m}) AS f, sum(CASE WHEN e >= tokens THEN 0 ELSE e END) OVER (PARTITION BY {m}) AS g"
        factor = f"CASE WHEN f >= goal_{m} THEN goal_{m} / (f + g) WHEN e >= tokens OR g = 0 THEN 1 ELSE (goal_{m} - f) / g END"
        steps.append(f"mix_r{i} AS MATERIALIZED (SELECT * EXCLUDE (f, g) REPLACE (least(tokens, e * {factor}) AS e) FROM (SELECT *, {sums} FROM {last}))")
        last = f"mix_r{i}"
    raw = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}) / sum(tokens) OVER (), {targets[m]}) AS raw_{m}, tokens / sum(tokens) OVER (PARTITION BY {m}) AS in_{m}" for m in MARGINS)
    wanted = ", ".join(f"raw_{m} / sum(raw_{m} * in_{m}) OVER () * {share} * sum(tokens) OVER () AS goal_{m}" for m in MARGINS)
    order = "ORDER BY per_token DESC, source NULLS FIRST, lang NULLS FIRST, topic NULLS FIRST"
    return f"""
mix_docs AS (SELECT *, {topic} AS topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens FROM {docs}),
mix_c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM mix_docs GROUP BY ALL HAVING sum(n_tokens) > 0),
mix_c1 AS (SELECT *, {raw} FROM mix_c0),
mix_c2 AS MATERIALIZED (SELECT source, lang, topic, tokens, {share} * tokens AS e, {wanted} FROM mix_c1),
{", ".join(steps)},
mix_p AS (SELECT *, e / tokens AS per_token FROM {last}),
mix_k AS (SELECT *, row_number() OVER ({order}) AS nth,
    ({share} * sum(tokens) OVER () - coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(e) OVER () - coalesce(sum(e) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS kappa FROM mix_p),
mix_rates AS (SELECT source, lang, topic, least(1.0, coalesce(greatest(1.0, (SELECT arg_min(kappa, nth) FROM mix_k WHERE kappa * per_token <= 1)) * per_token, 1.0)) AS rate FROM mix_k),
mix_result AS (
  SELECT d.*, r.rate FROM mix_docs d JOIN mix_rates r
    ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
  WHERE CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) / 4503599627370496.0 < r.rate)"""


ORACLE_SQL = f"WITH {mixed_ctes('documents')} SELECT doc_id, source, lang, topic, n_tokens, round(rate, 9) AS rate FROM mix_result"

"""Fold-local imputation and its audit against a plain version."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from touchline import config as C
from touchline.operators import imputation

CONFIG = C.Imputation(competition_support=2, position_support=4, global_support=8, neutral=40.0)
WINDOW = 2
SCHEMA = "match_id long, round_index long, competition string, side long, slot long, position string, skill_no int, value double, provenance int, code string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    out = []
    for m in range(40):
        for side in (0, 1):
            for slot in range(3):
                for skill in range(2):
                    value = rng.choice([None, -1.0, float("nan"), float(rng.randint(0, 100))]) if m % 3 else -1.0
                    out.append((m, m // 6, "AB"[m % 2], side, slot, ["Goalkeeper", "Forward", None][slot], skill, value, 2 if value and value >= 0 else 0, "x"))
    return out


def plain(data, fold):
    def known(v):
        return v is not None and v == v and v >= 0

    train = [r for r in data if fold - WINDOW <= r[1] < fold and known(r[7])]
    for r in [r for r in data if fold - WINDOW <= r[1] <= fold]:
        levels = [[x[7] for x in train if x[6] == r[6] and x[5] == r[5] and r[5] and x[2] == r[2]], [x[7] for x in train if x[6] == r[6] and x[5] == r[5] and r[5]], [x[7] for x in train if x[6] == r[6]]]
        value, code = CONFIG.neutral, 6
        if known(r[7]):
            value, code = r[7], 2
        else:
            for i, (some, least) in enumerate(zip(levels, (2, 4, 8), strict=True)):
                if len(some) >= least:
                    value, code = median(some), 3 + i
                    break
        yield (r[0], r[3], r[4], r[6]), ("validation" if r[1] == fold else "training", value, code, int(known(r[7])))


def test_folds_are_filled_by_their_own_training_rounds(spark, data):
    cells = spark.createDataFrame(data, SCHEMA)
    folds = spark.createDataFrame([(2,), (4,), (99,)], "fold long")
    done = imputation.impute_folds(cells, folds, WINDOW, CONFIG)
    got = {(r.fold, (r.match_id, r.side, r.slot, r.skill_no)): (r.part, r.value, r.provenance, r.observed) for r in done.collect()}
    want = {(f, k): v for f in (2, 4) for k, v in plain(data, f)}
    assert got == want and {v[2] for v in want.values()} >= {2, 3, 4, 5}
    counts = {(r.fold, r.part, r.provenance): r.cells for r in imputation.diagnostics(done).collect()}
    assert sum(counts.values()) == len(want)
    key = ["fold", "match_id", "side", "slot", "skill_no"]
    found = {r.code: r.n for r in imputation.audit(done, key).collect()}
    assert set(found) <= {"imputed_cells", "audited_neutral_fallback_cells"} and found["imputed_cells"] == sum(v[2] in (3, 4, 5) for v in want.values())
    harmed = done.withColumn("value", F.when(F.col("slot") == 0, 101.0).otherwise(F.col("value"))).withColumn("observed", F.lit(2)).withColumn("provenance", F.lit(9))
    codes = {r.code for r in imputation.audit(harmed.union(harmed.limit(1)), key).collect()}
    assert codes == {"audited_invalid_strength_values", "audited_invalid_masks", "audited_mask_mismatches", "audited_changed_observed_values", "audited_provenance_conservation_failure", "repeated_cells"}
    assert imputation.audit(done.limit(0), key).count() == 0 and imputation.impute_folds(cells.limit(0), folds, WINDOW).count() == 0


def test_array_inputs(spark, data):
    cells = spark.createDataFrame(data, SCHEMA)
    done = imputation.impute_folds(cells, spark.createDataFrame([(2,)], "fold long"), WINDOW, CONFIG)
    want = dict(plain(data, 2))
    for r in imputation.array_inputs(done, 4, 3).collect():
        for side in (0, 1):
            values, mask = r.strength[2 * side], r.strength[2 * side + 1]
            for slot in range(4):
                for skill in range(3):
                    cell = want.get((r.match_id, side, slot, skill))
                    assert (values[slot][skill], mask[slot][skill]) == ((cell[1] / 100, cell[3]) if cell else (0, 0))


def test_leaks_and_laws(spark):
    rows = [(1, "2024-01-10", "2024-01-05", 5.0, 1, 5), (2, "2024-01-10", "2024-01-11", 5.0, 1, -1), (3, "2024-06-10", "2024-01-05", 5.0, 2, 157), (4, "2024-01-10", None, -1.0, 0, -1), (5, "2024-01-10", None, None, 3, 0), (6, "2024-01-10", None, 7.0, None, None)]
    cells = spark.createDataFrame(rows, "match_id long, day string, snap_date string, value double, provenance int, age int").withColumns({c: F.to_date(c) for c in ("day", "snap_date")})
    assert {(r.code, r.entity_id) for r in imputation.leaks(cells).collect()} == {
        ("future_source_cells", "2"), ("source_cells_beyond_max_age", "3"), ("past_only_age_marker_mismatches", "5"), ("invalid_past_only_provenance", "5"), ("invalid_past_only_provenance", "6")
    }
    summary = spark.createDataFrame([(10, 7, 3)], "total long, seen long, missing long")
    found = imputation.conserved({"good": (summary, "total", "seen + missing"), "bad": (summary, "total", "seen"), "unknown": (summary, "total", "null")})
    assert {r.code for r in found.collect()} == {"bad", "unknown"}

"""Runs: predictions and folds of a model with a manifest of file hashes, checked when they are read again.

A run is a folder: tables predictions and folds, and _manifest, one row with the run's identity and the (path, length, sha256) of every file of the tables. Files are hashed by
the tasks that read them, on writing and on reading; nothing but the manifest's row comes to the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import validation
from touchline.sources.manifest import canonical_json, run_id
from touchline.sources.snapshots import file_identities

TABLES = ("folds", "predictions")
SIGNATURE = ("fold", "round_index", "match_id", "dt", "competition", "season", "y_true")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path within the run, length, sha256) of the run's table files."""
    parts = []
    for name in TABLES:
        files = file_identities(spark, f"{path}/{name}")
        inner = F.regexp_extract("path", f"/({name}/[^/]+)$", 1)
        parts.append(files.select(inner.alias("path"), "length", "sha256").where(F.col("path").endswith(".parquet")))
    return reduce(DataFrame.union, parts)


def save_run(path: str, kind: str, predictions: DataFrame, folds: DataFrame, configuration: dict, snapshot: str, seed: int | None = None, reference: dict | None = None) -> str:
    """Write a run and return its id, which follows from kind, configuration, snapshot and seed. reference: run_id and model_name of the run that this one is measured against."""
    spark = predictions.sparkSession
    identity = run_id(kind, configuration=configuration, snapshot=snapshot, seed=seed)
    for name, df in zip(TABLES, (folds, predictions), strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    texts = (canonical_json(configuration).decode(), json.dumps(reference, sort_keys=True) if reference else None)
    row = spark.createDataFrame([(identity, kind, snapshot, seed, *texts)], "run_id string, kind string, snapshot string, seed long, configuration string, reference string")
    files = artifacts(spark, path).agg(F.array_sort(F.collect_list(F.struct("path", "length", "sha256"))).alias("artifacts"))
    row.join(files).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest.parquet")
    return identity


def run_faults(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Findings: predictions of a fold or round that folds(fold, round_index) lacks, folds without predictions, matches predicted twice by a model, targets and probabilities out of range."""
    known = folds.select("fold", "round_index", F.lit(True).alias("known")).distinct()
    rows = predictions.join(known, ["fold", "round_index"], "left")
    rules: list[validation.Rule] = [
        ("prediction_of_another_fold", "critical", F.col("known").isNull()), ("prediction_target", "critical", ~F.col("y_true").isin(0, 1)), ("prediction_probability", "critical", ~F.col("probability").between(0, 1) | F.isnan("probability"))
    ]
    one = validation.broken(rows, rules, "prediction", F.col("match_id"))
    twice = predictions.groupBy("model_name", "match_id").agg(F.count("*").alias("n")).where("n > 1")
    empty = folds.select("fold").distinct().join(predictions.select("fold").distinct(), "fold", "left_anti")
    return one.union(validation.broken(twice, [("prediction_repeated", "critical", F.lit(True))], "prediction", F.col("match_id"))).union(validation.broken(empty, [("fold_without_predictions", "critical", F.lit(True))], "fold", F.col("fold")))


def load_run(spark: SparkSession, path: str, kinds: tuple[str, ...], model: str | None = None) -> dict:
    """A run's manifest fields with its tables `predictions` (of one model) and `folds`; another kind, changed, missing or new files, and faulty rows are errors."""
    manifest = spark.read.parquet(f"{path}/_manifest.parquet").first().asDict(recursive=True)
    if manifest["kind"] not in kinds:
        raise ValueError(f"a run of kind {manifest['kind']}, not {' or '.join(kinds)}")
    said = spark.createDataFrame(manifest["artifacts"] or [], "path string, length long, sha256 string")
    odd = artifacts(spark, path).exceptAll(said).union(said.exceptAll(artifacts(spark, path))).select("path").limit(5).collect()
    if odd:
        raise ValueError(f"files are not those of the manifest: {sorted({r.path for r in odd})}")
    folds, predictions = (spark.read.parquet(f"{path}/{name}") for name in TABLES)
    names = [r.model_name for r in predictions.select("model_name").distinct().limit(1000).collect()]
    if model is None and len(names) != 1 or model is not None and model not in names:
        raise ValueError(f"name one of the run's models: {sorted(names)}")
    predictions = predictions.where(F.col("model_name") == (model or names[0]))
    faults = run_faults(predictions, folds).select("code", "entity_id").limit(5).collect()
    if faults:
        raise ValueError(f"faulty rows: {[tuple(r) for r in faults]}")
    configuration, reference = json.loads(manifest["configuration"]), manifest["reference"] and json.loads(manifest["reference"])
    return manifest | {"configuration": configuration, "reference": reference, "model_name": model or names[0], "predictions": predictions, "folds": folds}


def related(run: dict, other: dict) -> None:
    """An error unless other was measured on run's snapshot, against run and its model."""
    if run["snapshot"] != other["snapshot"]:
        raise ValueError("the runs' snapshots differ")
    if (other["reference"] or {}).get("run_id") != run["run_id"] or other["reference"].get("model_name") != run["model_name"]:
        raise ValueError("the run is not measured against the other one's model")


def unlike_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures (fold, round, match, time, competition, season, target) that the two predictions do not have equally often, with how often."""
    counts = [df.groupBy(*SIGNATURE).agg(F.count("*").alias(n)) for df, n in ((a, "n_a"), (b, "n_b"))]
    same = reduce(lambda x, y: x & y, [counts[0][c].eqNullSafe(counts[1][c]) for c in SIGNATURE])
    both = counts[0].join(counts[1], same, "full")
    return both.select(*[F.coalesce(counts[0][c], counts[1][c]).alias(c) for c in SIGNATURE], F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a <> n_b")

"""Rolling models: every round from number `window` on is predicted by a model of the `window` rounds before it, for all such folds at once.

A round's rows (no team plays twice in it, so that teams bound their number) become one block. What a model needs of its training rows are sums over blocks:
counts, moments, gradients and curvatures. A block sends each sum to the `window` folds that train on it, the sums of a fold are added up with a combine on
the map side, and a small linear system is solved for each fold in the task that holds its sums. Ridge regression takes one such pass.
Logistic regression deals rounds out to stretches of folds: a task holds a stretch's rounds and the `window` before them and takes all Newton steps of its folds there.
Only where these rounds are too many rows for a task, blocks send their sums anew for each step. Predictions are a join of validation rows with their fold's weights.

Boosted or layered models have no such sums: `fitted_by_fold` runs Spark's own estimators fold by fold for chosen folds.

Defined results: rows without a target train nothing and are predicted; null features count as 0; a fold whose training rows have one class
gives that class's share; folds without training rows or without validation rows give no rows; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut
from touchline.functions.scalars import clip_probability

STEPS = 25
TOLERANCE = 1e-8

#: Folds of a stretch, at most; bytes of the rows that a task holds for it; and numbers of training rows that are worked on at once.
STRETCH, HELD, AT_ONCE = 256, 1 << 27, 1 << 15


def blocks(rows: DataFrame, features: str = "features", target: str = "y") -> DataFrame:
    """(round_index, n, x, t): a round's features, row after row, and targets of its rows that have one."""
    width = F.transform(F.col(features), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    one = rows.where(F.col(target).isNotNull()).select("round_index", F.struct(width.alias("x"), F.col(target).cast("double").alias("t")).alias("r"))
    grouped = one.groupBy("round_index").agg(F.collect_list("r").alias("rs"))
    return grouped.select("round_index", F.size("rs").alias("n"), F.flatten(F.transform("rs", lambda r: r.x)).alias("x"), F.transform("rs", lambda r: r.t).alias("t"))


def _matrix(block: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(block.x, float).reshape(block.n, -1)
    return np.column_stack([np.ones(len(x)), x]), np.asarray(block.t, float)


def _few(frames: Iterator[pd.DataFrame], most: int = 64) -> Iterator[pd.DataFrame]:
    """Frames of at most `most` rows, since what a block sends to its folds is many times the block."""
    for frame in frames:
        for a in range(0, len(frame), most):
            yield frame.iloc[a : a + most]


def _summed(parts: DataFrame, value: str = "s") -> DataFrame:
    """Sums by fold of arrays of equal length, element by element; first within tasks, then of what they send."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, s in zip(frame.fold, frame[value], strict=True):
                held[fold] = held[fold] + s if fold in held else np.array(s)
            if len(held) > 256:
                yield pd.DataFrame({"fold": list(held), value: list(held.values())})
                held = {}
        if held:
            yield pd.DataFrame({"fold": list(held), value: list(held.values())})

    schema = f"fold long, {value} array<double>"
    return parts.mapInPandas(run, schema).repartition("fold").groupBy("fold").applyInPandas(lambda g: pd.DataFrame({"fold": [g.fold.iloc[0]], value: [np.sum(np.stack(g[value].to_list()), axis=0)]}), schema)


def moments(made: DataFrame, window: int, last: int) -> DataFrame:
    """(fold, s): of the training rows of each fold, x'x with a leading 1, x't and t't, in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _few(frames):
            out = []
            for b in frame.itertuples():
                x, t = _matrix(b)
                s = np.concatenate([(x.T @ x).ravel(), x.T @ t, [t @ t]])
                out += [(f, s) for f in range(max(b.round_index + 1, window), min(b.round_index + window, last) + 1)]
            yield pd.DataFrame(out, columns=["fold", "s"])

    return _summed(made.mapInPandas(run, "fold long, s array<double>"))


def _unpacked(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x'x, x't, means and population deviations (1 where 0) of the features."""
    d = int(round((-1 + np.sqrt(1 + 4 * (len(s) - 1))) / 2))
    a, b = np.asarray(s[: d * d]).reshape(d, d), np.asarray(s[d * d : d * d + d])
    mean = a[0, 1:] / a[0, 0]
    spread = np.sqrt(np.maximum(np.diag(a)[1:] / a[0, 0] - mean**2, 0))
    return a, b, mean, np.where(spread < 1e-12, 1.0, spread)


def _weights(folds: DataFrame, solve: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(fold, w): weights of each fold (intercept first) from its sums."""
    return folds.mapInPandas(lambda frames: (pd.DataFrame({"fold": f.fold, "w": [solve(np.asarray(s)) for s in f.s]}) for f in frames if len(f)), "fold long, w array<double>")


def ridge_weights(rows: DataFrame, window: int, alpha: float = 1.0) -> DataFrame:
    """(fold, w) of ridge regressions on standardised features, the intercept free."""

    def solve(s: np.ndarray) -> np.ndarray:
        a, b, mean, spread = _unpacked(s)
        n = a[0, 0]
        cov = (a[1:, 1:] - n * np.outer(mean, mean)) / np.outer(spread, spread)
        w = np.linalg.solve(cov + alpha * np.eye(len(mean)), (b[1:] - mean * b[0]) / spread) / spread
        return np.concatenate([[b[0] / n - w @ mean], w])

    made, last = _made(rows)
    return _weights(moments(made, window, last), solve)


def _made(rows: DataFrame) -> tuple[DataFrame, int]:
    """The blocks, and the last round of the rows."""
    return cut(blocks(rows)), rows.agg(F.max("round_index")).first()[0] or 0


def logistic_weights(rows: DataFrame, window: int, c: float = 1.0, balanced: bool = False, free_intercept: bool = True, steps: int = STEPS) -> DataFrame:
    """(fold, w) of logistic regressions on standardised features: L2 strength 1 / c, classes weighted to equal sums if balanced.

    free_intercept: without a penalty on it, as most solvers have it; otherwise it is penalised like a weight. Newton steps of each fold until no weight
    moves by more than TOLERANCE; a fold of one class gets the weights 0 and, as intercept, infinity of its sign. rows are read twice.
    """
    per_round = rows.groupBy("round_index").agg(F.count("y").alias("n"), F.max(F.size("features")).alias("width"))
    last, most, width = per_round.agg(F.max("round_index"), F.max("n"), F.max("width")).first()
    stretch = min(STRETCH, HELD // (8 * max(most or 0, 1) * (max(width or 0, 0) + 3)) - window)
    if stretch < 1:
        return _by_sums(rows, window, c, balanced, free_intercept, steps)

    def run(held: pa.Table) -> pa.Table:
        number = held["stretch"][0].as_py()
        folds = np.arange(max(number * stretch, window), min(number * stretch + stretch - 1, last) + 1)
        kept, w = _fitted(held, folds, window, c, balanced, free_intercept, steps)
        return pa.table({"fold": pa.array(kept, pa.int64()), "w": pa.array(list(w), pa.list_(pa.float64()))})

    x = F.transform("features", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    reach = F.sequence(F.floor((F.col("round_index") + 1) / stretch), F.floor((F.col("round_index") + window) / stretch))
    dealt = rows.where("y is not null").select(F.explode(reach).alias("stretch"), F.col("round_index").cast("long").alias("round_index"), x.alias("x"), F.col("y").cast("double").alias("t"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "stretch").groupBy("stretch").applyInArrow(run, "fold long, w array<double>")


def _fitted(held: pa.Table, folds: np.ndarray, window: int, c: float, balanced: bool, free_intercept: bool, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The folds that have training rows among held(round_index, x, t), and their weights; some folds at once."""
    rounds = held["round_index"].to_numpy()
    order = np.argsort(rounds, kind="stable")
    rounds, t = rounds[order], held["t"].to_numpy()[order]
    x = np.vstack([np.ones(len(t)), pc.list_flatten(held["x"]).to_numpy().reshape(len(t), -1)[order].T])
    begin, end = np.searchsorted(rounds, folds - window), np.searchsorted(rounds, folds)
    some = end > begin
    folds, begin, n = folds[some], begin[some], (end - begin)[some]
    out = np.zeros((len(folds), len(x)))
    few = max(1, AT_ONCE // max(int(n.max(initial=1)), 1))
    for a in range(0, len(folds), few):
        part = slice(a, a + few)
        at = np.arange(int(n[part].max()))
        inside = at < n[part, None]
        rows = np.where(inside, begin[part, None] + at, 0)
        out[part] = _newton(np.stack([v[rows] * inside for v in x], 1), t[rows] * inside, inside, c, balanced, free_intercept, steps)
    return folds, out


def _newton(x: np.ndarray, t: np.ndarray, inside: np.ndarray, c: float, balanced: bool, free_intercept: bool, steps: int) -> np.ndarray:
    """Weights of folds with x (fold, feature with a leading 1, row) and targets t (fold, row); rows that are not inside are zeros."""
    n, positives, d = inside.sum(1), t.sum(1), x.shape[1]
    mean = x.sum(2) / n[:, None]
    spread = np.sqrt((((x - mean[:, :, None]) * inside[:, None, :]) ** 2).sum(2) / n[:, None])
    spread = np.where(spread < 1e-12, 1.0, spread)
    spread[:, 0] = 0.0
    penalty = np.eye(d) * (spread**2)[:, :, None]
    if not free_intercept:
        penalty += mean[:, :, None] * mean[:, None, :]
    weight = inside * 1.0
    if balanced:
        weight = inside * np.where(t > 0, (n / (2 * np.maximum(positives, 1)))[:, None], (n / (2 * np.maximum(n - positives, 1)))[:, None])
    out = np.zeros((len(x), d))
    one = (positives == 0) | (positives == n)
    out[one, 0] = np.where(positives[one] > 0, np.inf, -np.inf)
    left = np.nonzero(~one)[0]  # folds that still move
    x, t, weight, penalty = (v[left] for v in (x, t, weight, penalty))
    for _ in range(steps):
        if not len(left):
            break
        w = out[left]
        p = 1 / (1 + np.exp(-np.clip((w[:, None, :] @ x)[:, 0, :], -500, 500)))
        curve = (x * (weight * p * (1 - p))[:, None, :]) @ np.swapaxes(x, 1, 2)
        slope = (x @ (weight * (p - t))[:, :, None])[:, :, 0]
        step = np.linalg.solve(curve + penalty / c + 1e-12 * np.eye(d), (slope + (penalty @ w[:, :, None])[:, :, 0] / c)[:, :, None])[:, :, 0]
        out[left] = w - step
        moves = np.abs(step).max(1) > TOLERANCE
        if not moves.all():
            left, x, t, weight, penalty = (v[moves] for v in (left, x, t, weight, penalty))
    return out


def _by_sums(rows: DataFrame, window: int, c: float, balanced: bool, free_intercept: bool, steps: int) -> DataFrame:
    """`logistic_weights` where a window's rows are too many for a task: sums of blocks for each Newton step, for all folds at once."""
    made, last = _made(rows)
    sums = cut(moments(made, window, last))
    now = cut(_started(sums))
    for _ in range(steps):
        parts = made.join(_spread(now, window), "round_index").mapInPandas(lambda frames: _curved(frames, balanced), "fold long, s array<double>")
        grown = _summed(parts).withColumnRenamed("s", "g")
        moved = now.join(grown, "fold", "left").mapInPandas(lambda frames: _stepped(frames, c, free_intercept), "fold long, s array<double>, w array<double>, moved double")
        now = cut(moved)
        if now.where(F.col("moved") > TOLERANCE).isEmpty():
            break
    return now.select("fold", "w")


def _started(sums: DataFrame) -> DataFrame:
    """Sums with weights to begin with and how far they moved."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f for f in frames if len(f)):
            yield pd.DataFrame({"fold": f.fold, "s": f.s, "w": [np.zeros(len(_unpacked(np.asarray(s))[1])) for s in f.s], "moved": 1.0})

    return sums.mapInPandas(run, "fold long, s array<double>, w array<double>, moved double")


def _spread(now: DataFrame, window: int) -> DataFrame:
    """(round_index, folds): of each round the folds that train on it, with weights, counts and positives; `window` folds a round at most."""
    own = now.where("moved > 0").select(F.explode(F.sequence(F.col("fold") - window, F.col("fold") - 1)).alias("round_index"), F.struct("fold", "w", F.get("s", F.lit(0)).alias("n"), F.get("s", F.cardinality("w") * F.cardinality("w")).alias("positives")).alias("f"))
    return own.groupBy("round_index").agg(F.collect_list("f").alias("folds"))


def _curved(frames: Iterator[pd.DataFrame], balanced: bool) -> Iterator[pd.DataFrame]:
    """Curvature and gradient of each fold on a block."""
    for frame in _few(frames):
        out = []
        for b in frame.itertuples():
            x, t = _matrix(b)
            for f in b.folds:
                p = 1 / (1 + np.exp(-np.clip(x @ np.asarray(f["w"]), -500, 500)))
                weight = np.where(t > 0, f["n"] / (2 * max(f["positives"], 1)), f["n"] / (2 * max(f["n"] - f["positives"], 1))) if balanced else np.ones(len(t))
                out.append((f["fold"], np.concatenate([((x * (weight * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (weight * (p - t))])))
        yield pd.DataFrame(out, columns=["fold", "s"])


def _stepped(frames: Iterator[pd.DataFrame], c: float, free_intercept: bool) -> Iterator[pd.DataFrame]:
    """A Newton step of each fold whose sums have come; folds of one class are done at once."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            a, b, mean, spread = _unpacked(np.asarray(r.s))
            w, moved, n = np.asarray(r.w, float), 0.0, a[0, 0]
            if b[0] in (0, n):
                w = np.concatenate([[np.inf if b[0] else -np.inf], np.zeros(len(mean))])
            elif r.g is not None:
                d = len(w)
                g = np.asarray(r.g)
                penalty = np.diag(np.concatenate([[0.0], spread**2]))
                if not free_intercept:
                    level = np.concatenate([[1.0], mean])
                    penalty += np.outer(level, level)
                step = np.linalg.solve(g[: d * d].reshape(d, d) + penalty / c + 1e-12 * np.eye(d), g[d * d :] + penalty @ w / c)
                w, moved = w - step, float(np.abs(step).max())
                moved = moved if moved > TOLERANCE else 0.0
            out.append((r.fold, r.s, w, moved))
        yield pd.DataFrame(out, columns=["fold", "s", "w", "moved"])


def predicted(rows: DataFrame, weights: DataFrame, link: str = "identity", features: str = "features") -> DataFrame:
    """rows of the folds' validation rounds with fold and prediction; link: identity or logit."""
    x = F.transform(F.col(features), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    score = F.get("w", F.lit(0)) + F.aggregate(F.zip_with(x, F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    value = 1 / (1 + F.exp(-score)) if link == "logit" else score
    return rows.join(weights, rows.round_index == weights.fold).select(*[rows[c] for c in rows.columns], "fold", value.alias("prediction"))


def shares(rows: DataFrame, window: int, classes: int | None = None) -> DataFrame:
    """(fold, n, mean, dist): rows with a target in each fold's training rounds, their mean, and the shares of the classes 0 to classes - 1 (null without classes)."""
    one = rows.where("y is not null").groupBy("round_index").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("t"), *[F.count_if(F.col("y") == i).alias(f"c{i}") for i in range(classes or 0)])
    last = rows.agg(F.max("round_index").alias("last"))
    spread = one.join(last).select("*", F.explode(F.sequence(F.col("round_index") + 1, F.col("round_index") + window)).alias("fold")).where((F.col("fold") >= window) & (F.col("fold") <= F.col("last")))
    summed = spread.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(classes or 0)])
    dist = F.array(*[F.col(f"c{i}") / F.col("n") for i in range(classes)]) if classes else F.lit(None).cast("array<double>")
    return summed.select("fold", "n", (F.col("t") / F.col("n")).alias("mean"), dist.alias("dist"))


def majority(rows: DataFrame, window: int, classes: int) -> DataFrame:
    """rows of validation rounds with the training rounds' mean, the least of their most frequent classes, the class shares and the expected class."""
    found = shares(rows, window, classes)
    top = F.array_position("dist", F.array_max("dist")) - 1
    expected = F.aggregate(F.transform("dist", lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    return rows.join(found.select("fold", "n", "mean", top.alias("top"), "dist", expected.alias("expected")), rows.round_index == found.fold).drop("fold")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """Of predictions(fold, y, prediction): n, mean absolute and root mean squared error of each fold, and of all (fold null)."""
    gap = F.col("prediction") - F.col("y")
    return predictions.where("y is not null").groupingSets([["fold"], []], "fold").agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def fitted_by_fold(rows: DataFrame, folds: list[int], window: int, fit: Callable[[DataFrame, int, object], tuple[object, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Validation rows of chosen folds with the columns that fit's second result adds; fit(training, fold, state) gives the next fold's state.

    One Spark fit after another, since a fold may start from the one before (weights carried on); each fold's rows are written before the next begins.
    """
    out, state = None, None
    for fold in folds:
        training = rows.where((F.col("round_index") >= fold - window) & (F.col("round_index") < fold) & F.col("y").isNotNull())
        state, apply = fit(training, fold, state)
        got = cut(apply(rows.where(F.col("round_index") == fold)).withColumn("fold", F.lit(fold).cast("long")))
        out = got if out is None else out.unionByName(got)
    return out if out is not None else rows.where("false").withColumn("fold", F.lit(None).cast("long"))


def balanced_weights(training: DataFrame, column: str = "weight") -> DataFrame:
    """training with a weight for each row that gives all classes of y equal sums; one row for each class is joined."""
    counts = training.groupBy("y").agg(F.count("*").alias("_c"))
    whole = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return training.join(counts.join(whole), "y").withColumn(column, F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def _ready(df: DataFrame) -> DataFrame:
    """df with its features as a vector."""
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector(F.transform("features", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))))


def forest(trees: int = 250, depth: int = 12, least: int = 10, seed: int = 42) -> Callable:
    """fit of `fitted_by_fold`: a random forest of balanced classes; adds probability."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    def fit(training: DataFrame, fold: int, state: object) -> tuple[object, Callable[[DataFrame], DataFrame]]:
        own = RandomForestClassifier(featuresCol="_v", labelCol="y", weightCol="weight", probabilityCol="_p", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)
        model = own.fit(_ready(balanced_weights(training)))
        return None, lambda df: model.transform(_ready(df)).select(*df.columns, vector_to_array("_p")[1].alias("probability"))

    return fit


def multinomial(classes: int, c: float = 1.0) -> Callable:
    """fit of `fitted_by_fold`: multinomial logistic regression of balanced classes on standardised features; adds dist over 0 to classes - 1, absent ones 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    def fit(training: DataFrame, fold: int, state: object) -> tuple[object, Callable[[DataFrame], DataFrame]]:
        weighed = balanced_weights(training)
        n = max(weighed.count(), 1)
        model = LogisticRegression(featuresCol="_v", labelCol="y", weightCol="weight", family="multinomial", regParam=1 / (c * n), standardization=True, maxIter=1000).fit(_ready(weighed))
        seen = vector_to_array("probability")
        kept = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get("_p", i), F.lit(0.0)))
        return None, lambda df: model.transform(_ready(df)).withColumn("_p", seen).select(*df.columns, kept.alias("dist"))

    return fit


def layered(layers: list[int], rate: Callable[[int], float], step: int = 20, epochs: int = 5, patience: int = 2, seed: int = 42) -> Callable:
    """fit of `fitted_by_fold`: Spark's multilayer perceptron, its weights carried from fold to fold; adds probability.

    A fold trains for up to `epochs` runs of `step` iterations at the round's rate, each from the last one's weights, and keeps the best by log loss on the last
    training round; `patience` runs without a gain end it.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import vector_to_array

    def fit(training: DataFrame, fold: int, state: object) -> tuple[object, Callable[[DataFrame], DataFrame]]:
        data = cut(_ready(training))
        held = data.where(F.col("round_index") == fold - 1)
        best, weights, left = None, state, patience
        for _ in range(epochs):
            own = MultilayerPerceptronClassifier(featuresCol="_v", labelCol="y", layers=layers, maxIter=step, stepSize=rate(fold), solver="gd" if weights is not None else "l-bfgs", seed=seed)
            if weights is not None:
                own.setInitialWeights(weights)
            model = own.fit(data)
            weights = model.weights
            p = clip_probability(vector_to_array("probability")[1])
            loss = model.transform(held).agg(F.avg(-F.when(F.col("y") == 1, F.ln(p)).otherwise(F.ln(1 - p)))).first()[0]
            if best is None or (loss is not None and loss < best[0] - 1e-6):
                best, left = (loss if loss is not None else 0.0, model), patience
            else:
                left -= 1
                if not left:
                    break
        model = best[1]
        return model.weights, lambda df: model.transform(_ready(df)).withColumn("_p", vector_to_array("probability")[1]).select(*df.columns, F.col("_p").alias("probability"))

    return fit


def first_folds(rounds: DataFrame, window: int, count: int, offset: int = 0) -> list[int]:
    """The first `count` folds from the offset-th on, for a trial run; their number is the caller's."""
    last = rounds.agg(F.max("round_index")).first()[0]
    return list(range(window + offset, min(window + offset + count, (-1 if last is None else last) + 1)))


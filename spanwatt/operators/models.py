"""Residual models: one small ensemble of trees for each line, tower and target."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwatt.config import BOUNDS

from .features import DERIVED, KEYS

# Fixed values of the fit.
ROUNDS, DEPTH, RATE, SAMPLING, SEED = 120, 3, 0.05, 0.9, 42
COLUMNS = ("physical", *DERIVED)
FIT_SCHEMA = (
    "line_id string, tower_id string, target string, evaluation string, outcome string, rows long, train_rows long, holdout_rows long, baseline_mae double, corrected_mae double, "
    "baseline_rmse double, corrected_rmse double, lower double, upper double, model binary"
)


#: Rows times columns that numpy takes at once, so that they stay near the processor.
CHUNK = 120_000
#: Rows whose keys are fitted or scored together.
PACK = 60_000


class Boosted:
    """Squared-error boosting of shallow trees.

    feature, cut, value: arrays by tree and node, where node k has the children 2 k + 1 (below the cut) and 2 k + 2; the feature
    is -1 at a leaf.
    """

    def __init__(self, base: float, feature: np.ndarray | None = None, cut: np.ndarray | None = None, value: np.ndarray | None = None):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None or not len(x):
            return np.full(len(x), self.base)
        at, tree = np.zeros((len(self.feature), len(x)), np.int64), np.arange(len(self.feature))[:, None]
        for _ in range(DEPTH):
            f = self.feature[tree, at]
            below = x[np.arange(len(x)), np.maximum(f, 0)] < self.cut[tree, at]
            at = np.where(f >= 0, 2 * at + np.where(below, 1, 2), at)
        return self.base + RATE * np.cumsum(self.value[tree, at], axis=0)[-1]


def _sums(y: np.ndarray, node: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the y of each job (row) and node, each summed as the array of its own values is."""
    jobs = len(y)
    key = (np.arange(jobs)[:, None] * (nodes + 1) + np.where(node < 0, nodes, node)).ravel()
    order = np.argsort(key, kind="stable")
    count = np.bincount(key, minlength=jobs * (nodes + 1))
    start, values, total = np.cumsum(count) - count, y.ravel()[order], np.zeros(len(count))
    for m in np.unique(count[count > 0]):
        who = np.flatnonzero(count == m)
        total[who] = values[start[who][:, None] + np.arange(m)].sum(axis=1)
    return count.reshape(jobs, -1)[:, :nodes], total.reshape(jobs, -1)[:, :nodes]


def _boosted(x: np.ndarray, y: np.ndarray, base: np.ndarray) -> list[Boosted]:
    """The models of jobs of equally many rows, side by side.  x: jobs, rows, columns; y: jobs, rows.

    The samples of rows and columns come from the seed and the number of rows, so they are common to all jobs.  A level of a tree is
    a running sum over every column's rows in their order, for each node of the level by itself.
    """
    jobs, n, width = x.shape
    rng = np.random.default_rng(SEED)
    left, each = y - base[:, None], np.arange(jobs)
    order = np.argsort(x, axis=1, kind="stable").transpose(0, 2, 1)  # jobs, columns, rows
    x_ = np.ascontiguousarray(x.transpose(0, 2, 1))
    ranked = np.take_along_axis(x_, order, 2)
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        sampled = rng.random(n) < SAMPLING
        cols = np.sort(rng.permutation(width)[: max(1, int(SAMPLING * width))])
        if not sampled.any():
            continue
        m = int(sampled.sum())
        place, columns = np.arange(m), np.arange(len(cols))
        own = order[:, cols]
        keep = sampled[own].ravel()
        own = own.ravel()[keep].reshape(jobs, len(cols), m)
        value = ranked[:, cols].ravel()[keep].reshape(jobs, len(cols), m)
        in_order = left[each[:, None, None], own]
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, leaf = np.full((jobs, size), -1, np.int8), np.zeros((jobs, size)), np.zeros((jobs, size))
        node, open_ = np.zeros((jobs, n), np.int8), np.ones(jobs, bool)
        last = np.zeros((jobs, len(cols), m))  # rules out places where a column's value goes on
        last[:, :, :-1][~(value[:, :, :-1] < value[:, :, 1:])] = -np.inf
        for depth in range(DEPTH):
            where = node[each[:, None, None], own] if depth else None
            for k in range(2**depth - 1, 2 ** (depth + 1) - 1):
                live = open_ if not depth else (node == k).any(axis=1)
                if not live.any():
                    continue
                who = np.flatnonzero(live)
                some = slice(None) if len(who) == jobs else who
                inside = where[some] == k if depth else np.ones((1, 1, m), bool)
                run = np.cumsum(in_order[some] * inside if depth else in_order, axis=2)
                count = np.cumsum(inside, axis=2, dtype=float)
                whole, full = count[:, :1, -1:], run[:, :, -1:].copy()
                # with no row on one side this is the score of no cut at all
                gain, rows = run * run, count + 1.0
                gain /= rows
                np.subtract(full, run, out=run)
                run *= run
                run /= np.subtract(whole + 1.0, count, out=rows)
                gain += run
                gain += last[some]
                # the best gain; of equal ones that with the fewest rows below, then the first column
                at, pick = gain.argmax(axis=2), np.arange(len(who))
                best, below = gain[pick[:, None], columns, at], count[pick[:, None], columns, at] if depth else at
                f = np.where(best == best.max(axis=1, keepdims=True), below, np.inf).argmin(axis=1)
                good = best[pick, f] > full[pick, f, 0] ** 2 / (whole[:, 0, 0] + 1.0) + 1e-12
                who, pick, f, at = who[good], pick[good], f[good], at[pick[good], f[good]]
                if not len(who):
                    continue
                # the cut lies between the last row below and the first one above
                in_node = inside[pick, f] if depth else inside[0]
                low = np.where(in_node & (place <= at[:, None]), place, -1).max(axis=1)
                high = np.where(in_node & (place > at[:, None]), place, m).min(axis=1)
                middle = (value[who, f, low] + value[who, f, high]) / 2
                feature[who, k], cut[who, k] = cols[f], middle
                go = x_[who, cols[f]] < middle[:, None]
                node[who] = np.where(node[who] == k, np.where(go, 2 * k + 1, 2 * k + 2), node[who])
        count, total = _sums(left, np.where(sampled, node, -1), size)
        leaf = total / (count + 1.0)
        left = left - RATE * np.take_along_axis(leaf, node.astype(np.int64), 1)
        made.append((feature, cut, leaf))
    if not made:
        return [Boosted(float(b)) for b in base]
    inner = 2**DEPTH - 1
    feature, cut, leaf = (np.stack(a, axis=1) for a in zip(*made, strict=True))
    feature, cut = feature[:, :, :inner].copy(), cut[:, :, :inner].copy()
    return [Boosted(float(base[j]), feature[j], cut[j], leaf[j]) for j in range(jobs)]


def new_models(data: list[tuple[np.ndarray, np.ndarray]]) -> list[Boosted]:
    """For each (x, y) a constant where all residuals are alike, else boosted trees; those of equally many rows are fitted side by side."""
    out: list[Boosted | None] = [None] * len(data)
    sizes: dict[int, list[int]] = {}
    for k, (_, y) in enumerate(data):
        if len(y) and np.abs(y - y[0]).max() <= 1e-12:
            out[k] = Boosted(float(np.median(y)))
        elif not len(y):
            out[k] = Boosted(float("nan"))
        else:
            sizes.setdefault(len(y), []).append(k)
    for n, who in sizes.items():
        step = max(1, CHUNK // (n * data[who[0]][0].shape[1]))
        for a in range(0, len(who), step):
            part = who[a : a + step]
            base = np.array([float(data[k][1].mean()) for k in part])
            for k, model in zip(part, _boosted(np.stack([data[k][0] for k in part]), np.stack([data[k][1] for k in part]), base), strict=True):
                out[k] = model
    return out  # type: ignore[return-value]


def new_model(x: np.ndarray, y: np.ndarray) -> Boosted:
    return new_models([(x, y)])[0]


def robust_bounds(y: np.ndarray) -> tuple[float, float]:
    low, mid, high = np.quantile(y, [0.01, 0.5, 0.99])
    reach = 5 * 1.4826 * np.median(np.abs(y - mid))
    if reach > 0:
        low, high = max(low, mid - reach), min(high, mid + reach)
    return (low, high) if low <= high else (mid, mid)


def _corrected(physical: np.ndarray, residual: np.ndarray, bounds: tuple[float, float], target: str) -> np.ndarray:
    value = physical + np.clip(residual, *bounds)
    low, high = BOUNDS[target]
    return np.where(np.isfinite(value) & (value >= low) & (value <= high), value, physical)


def _packs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[slice]]]:
    """Whole keys out of rows sorted by key, many at a time, and where each of them lies."""
    held: list[pd.DataFrame] = []
    rows, enough = 0, PACK

    def keys(pdf: pd.DataFrame) -> list[slice]:
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in KEYS:
            values = pdf[k].to_numpy(object)
            new[1:] |= values[1:] != values[:-1]
        start = np.flatnonzero(new).tolist()
        return [slice(a, b) for a, b in zip(start, [*start[1:], len(pdf)], strict=True)]

    for batch in batches:
        if not len(batch):
            continue
        held, rows = [*held, batch], rows + len(batch)
        if rows >= enough:
            pdf = pd.concat(held, ignore_index=True)
            *whole, last = keys(pdf)
            if whole:
                yield pdf.iloc[: last.start], whole
                pdf = pdf.iloc[last.start :]
            held, rows = [pdf], len(pdf)
            enough = max(PACK, 2 * rows)
    if held:
        pdf = pd.concat(held, ignore_index=True)
        yield pdf, keys(pdf)


def fit(rows: DataFrame, factory: Callable[[np.ndarray, np.ndarray], Boosted] = new_model) -> DataFrame:
    """A row with the packed model for each key; rows hold the model's columns, residual,
    truth and split (see ``features.holdout``).

    The order of the input does not matter.  A model that is judged on held-out rows is fitted
    on the earlier ones, and the kept one on all; without a holdout it is judged on all rows.
    Where the fit fails, the median is the model and the outcome names the failure.  A key's
    rows are one tower's matched readings; keys don't affect each other, many are fitted side by side.
    """

    def fitted(jobs: list[tuple[np.ndarray, np.ndarray]]) -> list[Boosted | Exception]:
        if factory is new_model:
            try:
                return list(new_models(jobs))
            except Exception:  # one by one, to tell whose it is
                pass
        out: list[Boosted | Exception] = []
        for x, y in jobs:
            try:
                out.append(factory(x, y))
            except Exception as error:
                out.append(error)
        return out

    def judged(keys: list[str], columns: dict[str, np.ndarray], x: np.ndarray, learn: np.ndarray, judge: np.ndarray, full: bool, trial: Boosted | Exception, model: Boosted | Exception) -> list:
        y, physical, truth, outcome = columns["residual"], columns["physical"], columns["truth"], "trained"
        failed = next((m for m in (trial, model) if isinstance(m, Exception)), None)
        if failed is not None:
            outcome = f"data_fallback:{type(failed).__name__}"
            trial, model = Boosted(float(np.median(y[learn]))), Boosted(float(np.median(y)))
        made = _corrected(physical[judge], trial.predict(x[judge]), robust_bounds(y[learn]), keys[KEYS.index("target")])
        before, after, bounds = physical[judge] - truth[judge], made - truth[judge], robust_bounds(y)
        error = lambda e: (float(np.abs(e).mean()), float(np.sqrt((e * e).mean())))
        (mae0, rmse0), (mae1, rmse1) = error(before), error(after)
        return [*keys, "full_fit" if full else "holdout", outcome, len(y), int(learn.sum()), int(judge.sum()) if not full else 0, mae0, mae1, rmse0, rmse1, float(bounds[0]), float(bounds[1]), zlib.compress(pickle.dumps(model), 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, places in _packs(batches):
            names, split, all_x = pdf[list(KEYS)].to_numpy(object), pdf["split"].to_numpy(object), pdf[list(COLUMNS)].to_numpy(float)
            values, todo, jobs = {c: pdf[c].to_numpy(float) for c in ("residual", "physical", "truth")}, [], []
            for at in places:
                held, x, y = split[at] == "holdout", all_x[at], values["residual"][at]
                full = not held.any()
                learn = np.ones(len(y), bool) if full else split[at] == "train"
                todo.append((names[at.start].tolist(), {c: v[at] for c, v in values.items()}, x, learn, np.ones(len(y), bool) if full else held, full))
                jobs += [(x[learn], y[learn]), (x, y)]
            models = fitted(jobs)
            made = [judged(*one, trial, model) for one, trial, model in zip(todo, models[::2], models[1::2], strict=True)]
            yield pd.DataFrame(made, columns=[c.strip().split(" ")[0] for c in FIT_SCHEMA.split(", ")])

    order = ["source_file_hash", "timestamp", *COLUMNS, "residual"]
    need = list(dict.fromkeys([*KEYS, *order, "truth", "split"]))
    return rows.where("features_finite").select(need).repartition(*KEYS).sortWithinPartitions(*KEYS, *order).mapInPandas(run, FIT_SCHEMA)


def score(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Adds raw_residual (null without a model): a key's model comes before its rows, sorted within a task."""
    out = rows.select(*KEYS, "timestamp", "source_file_hash", *COLUMNS, "sentinel_collision")
    schema = out.schema.simpleString()[7:-1].replace(":", " ") + ", raw_residual double"
    columns = out.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, places in _packs(batches):
            packed, own = pdf["model"].to_numpy(object), pdf["_own"].to_numpy(bool)
            x, values = pdf[list(COLUMNS)].to_numpy(float), np.full(len(pdf), np.nan)
            for at in places:
                if not own[at.start]:
                    values[at] = pickle.loads(zlib.decompress(packed[at.start])).predict(x[at])
            made = pdf[columns].assign(raw_residual=values)[own]
            yield made.assign(sentinel_collision=made["sentinel_collision"].astype(bool))

    both = out.withColumns({"model": F.lit(None).cast("binary"), "_own": F.lit(True)}).unionByName(models.select(*KEYS, "model", F.lit(False).alias("_own")), allowMissingColumns=True)
    scored = both.repartition(*KEYS).sortWithinPartitions(*KEYS, "_own").mapInPandas(run, schema)
    return scored.join(models.select(*KEYS, "lower", "upper", F.lit(True).alias("has_model")), list(KEYS), "left")


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """residual, final, used_ai and fallback_reason for every row; clipped to the model's
    bounds, and physical where the model fails a test.  A key with a row that breaks the
    contract final = physical + residual goes back to physical as a whole."""
    df = score(rows, models)
    low = F.when(F.col("target") == "wind_speed", BOUNDS["wind_speed"][0]).otherwise(BOUNDS["ambient_temp"][0])
    high = F.when(F.col("target") == "wind_speed", BOUNDS["wind_speed"][1]).otherwise(BOUNDS["ambient_temp"][1])
    clipped = F.least(F.greatest(F.col("raw_residual"), F.col("lower")), F.col("upper"))
    value = F.col("physical") + clipped
    reason = (
        F.when(F.col("has_model").isNull(), "model_unavailable").when(F.col("sentinel_collision"), "feature_missing_collision")
        .when(F.col("raw_residual").isNull() | F.isnan("raw_residual") | (F.abs("raw_residual") > 1e300), "non_finite_prediction").when(~value.between(low, high), "physical_bounds_exceeded")
    )
    df = df.withColumn("fallback_reason", reason).withColumn("residual", F.when(reason.isNull(), clipped).otherwise(0.0))
    df = df.withColumn("final", F.col("physical") + F.col("residual"))
    fine = (F.abs(F.col("final") - F.col("physical") - F.col("residual")) <= 1e-9) & (F.col("fallback_reason").isNull() | (F.col("residual") == 0.0))
    whole = F.bool_and(fine).over(Window.partitionBy(*KEYS))
    df = df.withColumns({"residual": F.when(whole, F.col("residual")).otherwise(0.0), "final": F.when(whole, F.col("final")).otherwise(F.col("physical")), "fallback_reason": F.when(whole, F.col("fallback_reason")).otherwise("contract_violated")})
    return df.withColumn("used_ai", F.col("fallback_reason").isNull()).drop("raw_residual", "lower", "upper", "has_model")


def final_weather(corrected: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """The weather that is rated: predicted where a model was used, else local."""
    if predictions is None:
        return corrected.withColumns({"used_ai": F.lit(False), "fallback_reason": F.lit("ai_disabled")})
    both = corrected
    for target, column in (("wind_speed", "wind_speed_local"), ("ambient_temp", "ambient_temp_local")):
        own = predictions.where(F.col("target") == target).select("line_id", "tower_id", "timestamp", F.col("final").alias("_final"), F.col("used_ai").alias(f"{target}_used_ai"), F.col("fallback_reason").alias(f"{target}_fallback_reason"))
        both = both.join(own, ["line_id", "tower_id", "timestamp"], "left").withColumn(column, F.coalesce("_final", column)).drop("_final")
        both = both.withColumns({f"{target}_used_ai": F.coalesce(f"{target}_used_ai", F.lit(False)), f"{target}_fallback_reason": F.when(F.coalesce(f"{target}_used_ai", F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"{target}_fallback_reason", F.lit("model_unavailable")))})
    return both


def comparison(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Physical, predicted and true value of each target and row."""
    return predictions.join(truth.select(*KEYS, "timestamp", "truth"), [*KEYS, "timestamp"], "left").select(*KEYS, "timestamp", "physical", "final", "used_ai", "fallback_reason", "truth")


def run_report(fitted: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: models trained, models used, targets used."""
    made = fitted.agg(F.count_if(F.col("outcome") == "trained").alias("trained"), F.count("*").alias("models"))
    used = predictions.where("used_ai").agg(F.count_distinct("line_id", "tower_id", "target").alias("used_models"), F.array_join(F.array_sort(F.collect_set("target")), ",").alias("used_targets"))
    return made.crossJoin(used)


def to_train(keys: DataFrame, heads: DataFrame, rejections: DataFrame) -> DataFrame:
    """Keys without a model, or with a provisional one and new data with a holdout, whose
    attempt was not rejected before.  keys: KEYS, data_hash, has_holdout, attempt_fingerprint;
    heads: KEYS, evaluation, data_hash."""
    h = heads.select(*KEYS, F.col("evaluation").alias("head_evaluation"), F.col("data_hash").alias("head_hash"))
    both = keys.join(h, list(KEYS), "left").where("head_evaluation is null or (head_evaluation = 'full_fit' and has_holdout and data_hash <> head_hash)")
    return both.join(rejections.select(*KEYS, "attempt_fingerprint"), [*KEYS, "attempt_fingerprint"], "left_anti").select(keys.columns)

"""Boosted regression trees for every step ahead and every trial at once.

Features are cut into at most 64 bins by quantiles of all training rows. A tree grows level by level; what a
level needs of the rows are sums of residuals and counts per node, feature and bin. Tasks add these up for all models
(a model is one step ahead of one trial) in one pass, Spark adds the tasks' sums, and only split tables, whose size the
settings bound, reach the driver. Where the binned rows are small (``LOCAL_BYTES``) each model grows in one task by the same
rules instead, and all models grow in one job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.blocks import SERIES, TS
from gridcast.functions.time import add_seconds
from gridcast.session import settle

# The defaults of a forecaster.
DEFAULTS = {"n_estimators": 40, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0}
BINS, RIDGE, LEAST_GAIN = 64, 1.0, 1e-9
# Binned rows up to this size travel to the tasks whole; models grown in one pass; rounds between two written states; model size of one scan.
LOCAL_BYTES, MODELS_AT_ONCE, ROUNDS_HELD, SCAN_BYTES = 32 << 20, 256, 4, 32 << 20
TREES = "trial int, h int, round int, feature array<int>, threshold array<double>, value array<double>"
_ARROW = pa.schema([("trial", pa.int32()), ("h", pa.int32()), ("round", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("value", pa.list_(pa.float64()))])


def settings(params: dict | None) -> dict:
    """The defaults with the given parameters; unknown names and values out of range are refused."""
    given = dict(params or {})
    unknown = [k for k in given if k not in DEFAULTS]
    if unknown:
        raise ValueError(f"unknown parameters: {unknown}")
    out = {k: type(v)(given.get(k, v)) for k, v in DEFAULTS.items()}
    if out["n_estimators"] < 1 or not 1 <= out["max_depth"] <= 12 or out["learning_rate"] <= 0 or not 0 < out["subsample"] <= 1 or not 0 < out["colsample_bytree"] <= 1:
        raise ValueError(f"parameters out of range: {out}")
    return out


# --- one tree --------------------------------------------------------------------------------------------------------


def _mix(ids: np.ndarray, *keys: int) -> np.ndarray:
    """Numbers in [0, 1) that the row and the keys decide."""
    x = ids.view(np.uint64).copy()
    for k in keys:
        x = (x ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _columns(conf: dict, width: int, seed: int, trial: int, turn: int) -> np.ndarray:
    """The features a round may split on."""
    k = max(1, round(conf["colsample_bytree"] * width))
    return np.arange(width) if k == width else np.sort(np.random.default_rng([seed, trial, turn]).choice(width, k, replace=False))


def _histogram(flat: np.ndarray, node: np.ndarray, residual: np.ndarray, nodes: int) -> np.ndarray:
    """Sums and counts ``(2, nodes, features, BINS)`` of rows at their nodes (negative: not at this level)."""
    at = np.flatnonzero(node >= 0)
    width = flat.shape[1]
    index = (node[at, None] * (width * BINS) + flat[at]).ravel()
    size = nodes * width * BINS
    sums = np.bincount(index, np.repeat(residual[at], width), size)
    return np.stack([sums, np.bincount(index, minlength=size)]).reshape(2, nodes, width, BINS)


def best_splits(hist: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node of ``hist`` over the features ``columns``: feature (-1: a leaf), last bin on the left, sum and count of all and of the left rows.

    Of splits that are equally good but for rounding the first feature and bin is taken.
    """
    left, n_left = hist.cumsum(3)
    total, n = left[:, 0, -1].copy(), n_left[:, 0, -1].copy()  # every row is in one bin of each feature
    whole = total**2 / (n + RIDGE)
    gain = left**2 / (n_left + RIDGE)
    gain += (total[:, None, None] - left) ** 2 / (n[:, None, None] - n_left + RIDGE)
    gain = gain[:, :, :-1].reshape(len(total), -1)  # a split that leaves a side empty gains nothing
    top = gain.max(1)
    best = (gain >= (top * (1 - LEAST_GAIN))[:, None]).argmax(1)
    place, cut = best // (BINS - 1), best % (BINS - 1)
    rows = np.arange(len(total))
    feature = np.where(top - whole > LEAST_GAIN * (1 + whole), columns[place], -1)
    return feature, cut, total, n, left[rows, place, cut], n_left[rows, place, cut]


class Tree:
    """Nodes of a binary tree by level order: children of node i are 2i+1 and 2i+2."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut, self.value = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size)

    def split(self, level: int, nodes: np.ndarray, found: tuple[np.ndarray, ...], rate: float) -> None:
        """Take the splits of a level's ``nodes`` (numbered from 0) and the values of their children."""
        feature, cut, total, n, left, n_left = found
        at = 2**level - 1 + nodes
        if level == 0:
            self.value[0] = rate * total[0] / (n[0] + RIDGE)
        self.feature[at], self.cut[at] = feature, cut
        on = feature >= 0
        self.value[2 * at[on] + 1] = rate * left[on] / (n_left[on] + RIDGE)
        self.value[2 * at[on] + 2] = rate * (total - left)[on] / ((n - n_left)[on] + RIDGE)


def walk(x: np.ndarray, feature: np.ndarray, limit: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of ``x`` reaches in each tree after at most ``levels`` steps: rows by trees."""
    trees = np.arange(len(feature))
    node = np.zeros((len(x), len(feature)), np.int64)
    rows = np.arange(len(x))[:, None]
    for _ in range(levels):
        f = feature[trees, node]
        right = x[rows, np.maximum(f, 0)] > limit[trees, node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _at_level(tree: Tree, bins: np.ndarray, level: int) -> np.ndarray:
    """Number of the level's node that each row is at, negative where it stopped above."""
    return walk(bins, tree.feature[None], tree.cut[None], level)[:, 0] - (2**level - 1)


# --- rows ------------------------------------------------------------------------------------------------------------


def bin_edges(rows: DataFrame, width: int) -> list[list[float]]:
    """Per feature at most ``BINS - 1`` values that cut it, from one pass over all rows."""
    wanted = [(i + 1) / BINS for i in range(BINS - 1)]
    found = rows.agg(*[F.percentile_approx(F.col("x")[i], wanted, 2000).alias(f"q{i}") for i in range(width)]).first()
    return [sorted(set(q or [])) for q in found]


def binned(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """``id, bins, y``: a byte per feature; ``id`` stands for the row where rounds sample rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = [np.array(e) for e in edges]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8) if batch.num_rows else np.empty((0, len(cuts)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column("y")], names=["id", "bins", "y"])

    keys = [c for c in (SERIES, TS) if c in rows.columns]
    return rows.select(F.xxhash64(*(keys or ["x"])).alias("id"), "x", "y").mapInArrow(run, "id bigint, bins binary, y array<double>")


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    if kind is np.uint8:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind)


# --- all rows in each task -------------------------------------------------------------------------------------------


def grow_model(bins: np.ndarray, y: np.ndarray, ids: np.ndarray, conf: dict, trial: int, base: float, seed: int) -> list[Tree]:
    """All rounds of one model over rows that are at hand."""
    width, depth, rate = bins.shape[1], conf["max_depth"], conf["learning_rate"]
    guess, trees = np.full(len(y), base), []
    for turn in range(conf["n_estimators"]):
        tree, columns = Tree(depth), _columns(conf, width, seed, trial, turn)
        flat = bins[:, columns].astype(np.int64) + np.arange(len(columns)) * BINS
        residual = y - guess
        inside = np.ones(len(y), bool) if conf["subsample"] == 1 else _mix(ids, seed, trial, turn) < conf["subsample"]
        place = np.where(inside, 0, -1)  # of a row's node in ``nodes``
        nodes = np.zeros(int(inside.any()), np.int64)
        hist = _histogram(flat, place, residual, len(nodes)) if len(nodes) else None
        for level in range(depth):
            if not len(nodes):
                break
            found = best_splits(hist, columns)
            tree.split(level, nodes, found, rate)
            on = np.flatnonzero(found[0] >= 0)
            if level + 1 == depth or not len(on):
                break
            # Rows go to the children of the nodes that split; the larger child's sums are the parent's less the smaller's.
            child = np.full(len(nodes), -1)
            child[on] = 2 * np.arange(len(on))
            right = bins[np.arange(len(y)), np.maximum(found[0], 0)[place]] > found[1][place]
            place = np.where((place >= 0) & (child[place] >= 0), child[place] + right, -1)
            lighter = (2 * found[5] > found[3])[on].astype(int)
            small = np.where((place >= 0) & (lighter[place // 2] == place % 2), place // 2, -1)
            part = _histogram(flat, small, residual, len(on))
            whole, hist = hist[:, on], np.empty((2, 2 * len(on), *hist.shape[2:]))
            hist[:, 2 * np.arange(len(on)) + lighter] = part
            hist[:, 2 * np.arange(len(on)) + 1 - lighter] = whole - part
            nodes = np.stack([2 * nodes[on], 2 * nodes[on] + 1], 1).ravel()
        guess = guess + tree.value[walk(bins, tree.feature[None], tree.cut[None], depth)[:, 0]]
        trees.append(tree)
    return trees


def _as_rows(trial: int, h: int, base: float, trees: Sequence[Tree], edges: list[list[float]]) -> pa.RecordBatch:
    """A model as table rows; round 0 is the mean it starts from."""
    rows = [{"trial": trial, "h": h, "round": 0, "feature": [-1], "threshold": [0.0], "value": [base]}]
    for turn, t in enumerate(trees, 1):
        limit = [edges[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature.tolist(), t.cut.tolist(), strict=True)]
        rows.append({"trial": trial, "h": h, "round": turn, "feature": t.feature.tolist(), "threshold": limit, "value": t.value.tolist()})
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _fit_in_tasks(rows: DataFrame, confs: dict[int, dict], horizon: int, edges: list[list[float]], means: list[float], seed: int) -> DataFrame:
    spark = rows.sparkSession
    table = rows.toArrow().combine_chunks()  # at most LOCAL_BYTES, as fit_boosted has checked
    column = lambda name: table.column(name).combine_chunks()
    shared = spark.sparkContext.broadcast((_matrix(column("bins")), _matrix(column("y"), float), column("id").to_numpy()))
    # One task each, the longest first.
    work = {m: confs[m]["n_estimators"] * 2 ** confs[m]["max_depth"] for m in confs}
    models = sorted(((m, h) for m in confs for h in range(1, horizon + 1)), key=lambda x: -work[x[0]])
    tasks = min(len(models), 4 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(i % tasks, m, h) for i, (m, h) in enumerate(models)], "task int, trial int, h int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, ids = shared.value
        for batch in batches:
            for m, h in zip(batch.column("trial").to_pylist(), batch.column("h").to_pylist(), strict=True):
                yield _as_rows(m, h, means[h - 1], grow_model(bins, y[:, h - 1], ids, confs[m], m, means[h - 1], seed), edges)

    return settle(dealt.repartitionByRange(tasks, "task").mapInArrow(run, TREES))


# --- rows spread over tasks ------------------------------------------------------------------------------------------


def _fit_spread(rows: DataFrame, confs: dict[int, dict], horizon: int, edges: list[list[float]], means: list[float], seed: int) -> DataFrame:
    """Level by level over all tasks, for as many models at once as ``MODELS_AT_ONCE`` allows."""
    spark, width, out = rows.sparkSession, len(edges), None
    every = [(m, h) for m in confs for h in range(1, horizon + 1)]
    for lo in range(0, len(every), MODELS_AT_ONCE):
        models = every[lo : lo + MODELS_AT_ONCE]
        state = rows.withColumn("guess", F.array(*[F.lit(float(means[h - 1])) for _, h in models]))
        grown: list[list[Tree]] = [[] for _ in models]
        held: list[list[tuple[int, Tree]]] = []  # rounds that the written state does not hold yet
        for turn in range(max(confs[m]["n_estimators"] for m, _ in models)):
            active = [i for i, (m, _) in enumerate(models) if turn < confs[m]["n_estimators"]]
            trees = {i: Tree(confs[models[i][0]]["max_depth"]) for i in active}
            columns = {i: _columns(confs[models[i][0]], width, seed, models[i][0], turn) for i in active}
            for level in range(max(confs[models[i][0]]["max_depth"] for i in active)):
                growing = [i for i in active if level < confs[models[i][0]]["max_depth"]]
                for i, nodes, splits in _level(state, models, confs, held, trees, columns, growing, level, turn, seed):
                    trees[i].split(level, nodes, splits, confs[models[i][0]]["learning_rate"])
            held.append(list(trees.items()))
            for i in active:
                grown[i].append(trees[i])
            if len(held) == ROUNDS_HELD:
                state, held = settle(_advanced(state, held)), []
        batches = [_as_rows(m, h, means[h - 1], t, edges) for (m, h), t in zip(models, grown, strict=True)]
        part = spark.createDataFrame(pa.Table.from_batches(batches, _ARROW), TREES)  # as large as the settings say
        out = part if out is None else out.unionByName(part)
    return settle(out)


def _guessed(guess: np.ndarray, bins: np.ndarray, held: list[list[tuple[int, Tree]]]) -> np.ndarray:
    guess = guess.copy()
    for trees in held:
        for i, t in trees:
            guess[:, i] += t.value[walk(bins, t.feature[None], t.cut[None], len(t.feature).bit_length() - 1)[:, 0]]
    return guess


def _advanced(state: DataFrame, held: list[list[tuple[int, Tree]]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                guess = _guessed(_matrix(batch.column("guess"), float), _matrix(batch.column("bins")), held)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(guess), pa.list_(pa.float64()))], names=batch.schema.names)

    return state.mapInArrow(run, "id bigint, bins binary, y array<double>, guess array<double>")


def _level(state, models, confs, held, trees, columns, growing, level, turn, seed) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """The nodes and splits of one level of the growing models: one pass over the rows, one row per model and node to the driver."""
    nodes = 2**level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, ids = _matrix(batch.column("bins")), batch.column("id").to_numpy()
            residual = _matrix(batch.column("y"), float)[:, [h - 1 for _, h in models]] - _guessed(_matrix(batch.column("guess"), float), bins, held)
            for i in growing:
                m = models[i][0]
                inside = np.ones(len(ids), bool) if confs[m]["subsample"] == 1 else _mix(ids, seed, m, turn) < confs[m]["subsample"]
                node = np.where(inside, _at_level(trees[i], bins, level), -1)
                flat = bins[:, columns[i]].astype(np.int64) + np.arange(len(columns[i])) * BINS
                hist = _histogram(flat, node, residual[:, i], nodes)
                total[i] = total[i] + hist if i in total else hist
        for i, hist in total.items():
            full = np.flatnonzero(hist[1, :, 0].sum(1) > 0)
            rows = hist[:, full].transpose(1, 0, 2, 3).reshape(len(full), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), i, np.int32)), pa.array(full.astype(np.int32)), pa.array(list(rows), pa.list_(pa.float64()))], names=["model", "node", "hist"]
            )

    @F.pandas_udf("feature int, cut int, total double, n double, l double, nl double")
    def splits(model: pd.Series, hist: pd.Series) -> pd.DataFrame:
        found = [best_splits(np.asarray(x).reshape(2, 1, -1, BINS), columns[i]) for i, x in zip(model, hist, strict=True)]
        return pd.DataFrame([[v[0] for v in f] for f in found], columns=["feature", "cut", "total", "n", "l", "nl"])

    summed = state.mapInArrow(sums, "model int, node int, hist array<double>").groupBy("model", "node").agg(Summarizer.sum(array_to_vector("hist")).alias("hist"))
    found = summed.select("model", "node", splits("model", vector_to_array("hist")).alias("s")).select("model", "node", "s.*").orderBy("model", "node").collect()
    for i, rows in groupby(found, key=lambda r: r["model"]):
        node, *columns_of = (np.array(c) for c in zip(*(r[1:] for r in rows), strict=True))
        yield i, node, tuple(columns_of)


# --- fit and forecast ------------------------------------------------------------------------------------------------


def fit_boosted(rows: DataFrame, horizon: int, trials: Sequence[dict | None] = (None,), seed: int = 42, local_bytes: int | None = None) -> DataFrame:
    """Trees of every step ahead for every setting in ``trials``, over ``rows(x, y, ...)`` of all series: the settled table
    ``trial, h, round, feature, threshold, value``, a plain table that can be stored.

    Squared loss; leaves are shrunk means of residuals; rounds sample rows and features by hashes, so fits agree between runs
    but for the order of floating-point sums.
    """
    confs = {i: settings(t) for i, t in enumerate(trials)}
    rows = settle(rows.select(*[c for c in (SERIES, TS) if c in rows.columns], "x", "y"))  # read for the means, the edges and the bins
    first = rows.agg(F.max(F.size("x")).alias("width"), F.count(F.lit(1)).alias("n"), *[F.avg(F.col("y")[h]).alias(f"m{h}") for h in range(horizon)]).first()
    if not first["n"]:
        return rows.sparkSession.createDataFrame([], TREES)
    edges = bin_edges(rows, first["width"])
    ready = settle(binned(rows, edges))
    size = first["n"] * (first["width"] + 8 * (horizon + 1))
    fit = _fit_in_tasks if size <= (LOCAL_BYTES if local_bytes is None else local_bytes) else _fit_spread
    return fit(ready, confs, horizon, edges, [first[f"m{h}"] for h in range(horizon)], seed)


def predict_boosted(trees: DataFrame, origins_x: DataFrame, step_seconds: int, by_trial: bool = False, model: str = "GradientBoosting") -> DataFrame:
    """Forecast rows of every origin ``(series_id, ts, x)`` for all steps, of one trial or (``by_trial``, a column more) of each.

    The models are applied in one scan of the origins, or in several where they are larger than ``SCAN_BYTES`` together.
    """
    rows = origins_x.select(SERIES, F.col(TS).alias("origin_ts"), "x")
    sizes = trees.groupBy("trial", "h").agg(F.sum(F.size("value") * 20).alias("b")).orderBy("trial", "h").collect()
    parts: list[list] = []
    held = 0
    for r in sizes:
        if not parts or held + r["b"] > SCAN_BYTES:
            parts.append([])
            held = 0
        parts[-1].append((r["trial"], r["h"]))
        held += r["b"]
    found = None
    for part in parts:
        wanted = trees.where(F.struct("trial", "h").isin([F.struct(F.lit(t), F.lit(h)) for t, h in part]))
        scored = rows.mapInArrow(_applied(_grouped(wanted)), f"{SERIES} {dict(rows.dtypes)[SERIES]}, origin_ts timestamp_ntz, trial int, h int, yhat double")
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = rows.sparkSession.createDataFrame([], f"{SERIES} string, origin_ts timestamp_ntz, trial int, h int, yhat double")
    columns = [SERIES, F.lit(model).alias("model"), "origin_ts", "h", add_seconds("origin_ts", (F.col("h") - 1) * step_seconds).alias(TS), "yhat"]
    return found.select(*(["trial"] if by_trial else []), *columns)


def _grouped(trees: DataFrame) -> dict[tuple[int, int], list[tuple[np.ndarray, ...]]]:
    """Per model its trees as arrays, those of one size together."""
    out: dict[tuple[int, int], dict[int, list]] = {}
    for r in trees.collect():  # at most SCAN_BYTES, or one model
        out.setdefault((r["trial"], r["h"]), {}).setdefault(len(r["value"]), []).append((r["feature"], r["threshold"], r["value"]))
    return {k: [tuple(np.array(x) for x in zip(*same, strict=True)) for same in v.values()] for k, v in out.items()}


def _applied(models: dict[tuple[int, int], list[tuple[np.ndarray, ...]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = list(models)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                x = _matrix(batch.column("x"), float)
                yhat = np.zeros((len(x), len(keys)))
                for j, key in enumerate(keys):
                    for feature, limit, value in models[key]:
                        node = walk(x, feature, limit, value.shape[1].bit_length() - 1)
                        yhat[:, j] += value[np.arange(len(value)), node].sum(1)
                at = pa.array(np.repeat(np.arange(len(x)), len(keys)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(SERIES).take(at), batch.column("origin_ts").take(at), pa.array(np.tile([k[0] for k in keys], len(x)), pa.int32()),
                     pa.array(np.tile([k[1] for k in keys], len(x)), pa.int32()), pa.array(yhat.ravel())],
                    names=[SERIES, "origin_ts", "trial", "h", "yhat"],
                )

    return run


def learning_curve(trees: DataFrame, train: DataFrame, validation: DataFrame, horizon: int) -> DataFrame:
    """``model_id, x, train, val``: mean squared error after each round of each step's model, on rows of both parts."""
    models = _grouped_by_round(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("x"), float), _matrix(batch.column("y"), float)
            for h, rounds in models.items():
                guess, losses = np.zeros(len(x)), []
                for feature, limit, value in rounds:
                    guess = guess + value[walk(x, feature[None], limit[None], len(value).bit_length() - 1)[:, 0]]
                    losses.append(float(((y[:, h - 1] - guess) ** 2).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(losses), pa.int32()), pa.array(range(len(losses)), pa.int32()), pa.array(losses), pa.array([len(x)] * len(losses), pa.int64())], names=["h", "x", "loss", "n"])

    def part(rows: DataFrame, name: str) -> DataFrame:
        sums = rows.where(F.size("y") >= horizon).select("x", "y").mapInArrow(run, "h int, x int, loss double, n bigint").where("x > 0").groupBy("h", "x")
        return sums.agg((F.sum("loss") / F.sum("n")).alias(name))

    both = part(train, "train").join(part(validation, "val"), ["h", "x"], "full")
    return both.select(F.concat(F.lit("h"), "h").alias("model_id"), "x", "train", "val")


def _grouped_by_round(trees: DataFrame) -> dict[int, list[tuple[np.ndarray, ...]]]:
    out: dict[int, list] = {}
    for r in trees.orderBy("h", "round").collect():  # one model of each step
        out.setdefault(r["h"], []).append(tuple(np.array(r[c]) for c in ("feature", "threshold", "value")))
    return out

"""Model tokens. Fitting is in the state: supervised models see the target that they are scored on."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.state import Port, Signal, State, kernel
from .base import FeatureToken, ModelToken
from .prepare import ARRAY, CLEAN_FIRST, SCALED_FIRST, history_of

#: Series of one dense solve, at most; more different inputs are solved by steps of this many.
MOST_DENSE, BLOCK = 4_000, 250
#: Rows of a record of that solve, columns of a piece that is shuffled, bytes of a step's rows at most (a task holds two such panels), and bytes
#: of stale shuffles after which Spark is asked to delete them.
ROWS, WIDE, PANEL_BYTES, STALE_BYTES = 50, 2_000, 96 << 20, 1 << 28


class LastValue(ModelToken):
    name, max_uses = "last_value", 1

    def apply(self, state: State) -> State:
        source = history_of(state, CLEAN_FIRST)
        return state.push(state.df.withColumn("new__", F.array_repeat(F.element_at(source, -1), state.horizon)), "new__", self.name)


class Zero(ModelToken):
    name, max_uses = "zero", 1

    def apply(self, state: State) -> State:
        return state.push(state.df.withColumn("new__", F.array_repeat(F.lit(0.0), state.horizon)), "new__", self.name)


class Parrot(ModelToken):
    """The continuation of the series' own window that is most like its end."""

    name, max_uses = "parrot", 1

    def __init__(self, source_feature: str | None = None) -> None:
        self.source = source_feature

    def history(self, state: State) -> str:
        return self.source or history_of(state, SCALED_FIRST)

    def ready(self, state: State) -> bool:
        return "history_filled" in state.flags or not state.df.where(F.exists(F.col(self.history(state)), lambda x: x.isNull() | F.isnan(x))).limit(1).count()

    def apply(self, state: State) -> State:
        h = state.horizon
        return state.push(kernel(state.df, lambda x: (K.parrot(x, h),), [self.history(state)], {"new__": ARRAY}), "new__", self.name)


def shared_series(state: State, source: str, most: int, seed: int) -> list[np.ndarray]:
    """At most `most` series, by a seeded hash of their ids: what is sent to every task is bounded by the token's parameter."""
    rows = state.df.orderBy(F.xxhash64(F.lit(seed), "series_id"), "ord").limit(most).select("ord", source).collect()
    return [np.asarray(r[1], float) for r in sorted(rows, key=lambda r: r[0])]


def drawn_windows(state: State, source: str, width: int, most: int, most_series: int | None, seed: int) -> np.ndarray:
    """(windows, width): a seeded draw without repeats of at most `most` from all windows of all series, in the order of series and start."""
    n, count = state.length - width + 1, state.df.count()
    rng = np.random.default_rng(seed)
    own = np.sort(rng.choice(count, min(most_series or count, count), replace=False)) if most_series else None
    total = n * (count if own is None else len(own))
    ids = np.sort(rng.choice(total, min(most, total), replace=False))
    which = ids // n if own is None else own[ids // n]
    spark = state.df.sparkSession
    chosen = spark.createDataFrame([(int(o), int(i)) for o, i in zip(which, ids % n, strict=True)], "ord int, start int").groupBy("ord").agg(F.collect_list("start").alias("starts"))
    pieces = state.df.select(F.col("ord").cast("int").alias("ord"), source).join(F.broadcast(chosen), "ord")
    rows = pieces.select("ord", F.explode("starts").alias("start"), source).select("ord", "start", F.slice(source, F.col("start") + 1, width).alias("piece")).collect()
    return np.array([r["piece"] for r in sorted(rows, key=lambda r: (r["ord"], r["start"]))], float).reshape(-1, width)


class ParrotDataset(Parrot):
    """The continuation of the window of any series that is most like the series' end.

    By default a seeded draw from all series' windows is tried, in an order of the series' own, until one is like
    enough. With max_candidates=None every window of every series is: series are dealt into blocks, each block meets
    slices of the queries once, as one matrix against another, and the best of a query's answers wins.
    """

    name = "parrot_dataset"

    def __init__(self, min_corr: float | None = 0.97, max_candidates: int | None = 10_000, max_series_candidates: int | None = None, seed: int = 0, block: int = 256, queries: int = 4096) -> None:
        super().__init__()
        self.min_corr, self.most, self.most_series, self.seed, self.block, self.queries = min_corr, max_candidates, max_series_candidates, seed, block, queries

    def apply(self, state: State) -> State:
        h, source = state.horizon, self.history(state)
        if state.length < 2 * h:
            return state.push(kernel(state.df, lambda x: (K.persistence(np.asarray(x), h),), [source], {"new__": ARRAY}), "new__", self.name)
        return self._sampled(state, source) if self.most is not None else self._all(state, source)

    def _sampled(self, state: State, source: str) -> State:
        h, least, seed = state.horizon, self.min_corr, self.seed
        pool = drawn_windows(state, source, 2 * h, self.most, self.most_series, seed)

        def run(x: np.ndarray, ord_: int) -> tuple:
            query = np.asarray(x, float)[-h:]
            tried = np.random.default_rng([seed, int(ord_)]).permutation(len(pool))
            r = np.abs(K.correlations(pool[tried, :h], query))
            enough = np.flatnonzero(r >= least) if least is not None else []
            piece = pool[tried[enough[0] if len(enough) else r.argmax()]]
            a, b = K.affine_map(piece[:h], query)
            return (a * piece[h:] + b,)

        return state.push(kernel(state.df, run, [source, "ord"], {"new__": ARRAY}), "new__", self.name)

    def _all(self, state: State, source: str) -> State:
        h, count = state.horizon, state.df.count()
        blocks, slices = -(-count // self.block), -(-count // self.queries)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
        held = state.df.select((F.col("ord") % max(blocks, 1)).cast("int").alias("block"), F.col("ord").cast("int").alias("ord"), F.col(source).alias("x")).withColumn("slice", each(slices))
        asked = state.df.select("series_id", (F.col("ord") % max(slices, 1)).cast("int").alias("to_slice"), F.slice(source, state.length - h + 1, h).alias("q")).withColumn("to_block", each(blocks))

        def run(own: pa.Table, queried: pa.Table) -> pa.Table:
            stack = lambda table, name: np.array(table.column(name).to_pylist(), float)
            n = queried.num_rows
            best, whose, start, ahead = np.full(n, -1.0), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros((n, h))
            if n and own.num_rows:
                q = stack(queried, "q")
                for ord_, x in sorted(zip(own.column("ord").to_pylist(), stack(own, "x"), strict=True), key=lambda r: r[0]):
                    pieces = K.windows(x, h, len(x) - 2 * h + 1)
                    r = K.cross_correlations(q, pieces).round(12)  # equal windows tie
                    i = r.argmax(1)
                    better = np.flatnonzero(r[np.arange(n), i] > best)
                    best[better], whose[better], start[better] = r[better, i[better]], ord_, i[better]
                    for k in better.tolist():
                        a, b = K.affine_map(pieces[i[k]], q[k])
                        ahead[k] = a * x[i[k] + h : i[k] + 2 * h] + b
            return pa.table({"series_id": queried.column("series_id"), "r": best, "o": whose, "i": start, "ahead": pa.array(list(ahead), pa.list_(pa.float64()))})

        kind = state.df.schema["series_id"].dataType.simpleString()
        found = held.groupBy("block", "slice").cogroup(asked.groupBy("to_block", "to_slice")).applyInArrow(run, f"series_id {kind}, r double, o int, i int, ahead array<double>")
        first = F.struct(F.col("r"), -F.col("o"), -F.col("i"))
        best = found.groupBy("series_id").agg(F.max_by("ahead", first).alias("new__"))
        return state.push(state.df.join(best, "series_id"), "new__", self.name)


class WindowKernel(ModelToken):
    """Blend of the best windows' continuations over a bounded, seeded set of series and the series itself."""

    name = "window_kernel"

    def __init__(self, window: int | None = None, gamma: float | str = 10.0, target_meff: float = 8, top_k_per_series: int = 1, max_series: int = 64, space: str = "value", seed: int = 0) -> None:
        self.window, self.gamma, self.target, self.top, self.most, self.log, self.seed = window, gamma, target_meff, top_k_per_series, max_series, space == "log", seed

    def ready(self, state: State) -> bool:
        return state.length >= (self.window or state.horizon) + state.horizon

    def apply(self, state: State) -> State:
        source, h, w = history_of(state, CLEAN_FIRST), state.horizon, self.window or state.horizon
        pool = shared_series(state, source, self.most, self.seed)
        gamma, target, top, log = self.gamma, self.target, self.top, self.log

        def run(x: np.ndarray) -> tuple:
            x = np.asarray(x, float)
            own = pool if any(np.array_equal(x, s) for s in pool) else [x, *pool]
            return (K.window_kernel(x, own, w, h, gamma, target, top, log),)

        return state.push(kernel(state.df, run, [source], {"new__": ARRAY}), "new__", self.name)


def _kept(rows: RDD) -> RDD:
    """rows, computed and cut off from what made them: in the checkpoint folder if there is one, else on executors' disks."""
    rows.persist(StorageLevel.DISK_ONLY)
    if rows.context.getCheckpointDir() is None:
        rows.localCheckpoint()
        rows.count()
    else:
        rows.checkpoint()
        rows.count()
        rows.unpersist()
    return RDD(rows._jrdd, rows.ctx, rows._jrdd_deserializer)  # without rows' own parents, whose shuffles can go


def _drop(rows: RDD) -> None:
    rows.unpersist()
    if (file := rows.getCheckpointFile()) is not None:
        path = rows.context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(rows.context._jsc.hadoopConfiguration()).delete(path, True)


def bordered_ridge(sc: SparkContext, x: np.ndarray, y: np.ndarray, ridge: np.ndarray, length: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """K.rbf_ridge(x, y, ridge, length), without the whole matrix in a task and with half of one on disk.

    Z, the inverse of the Cholesky factor, gets `size` more rows in each step and is never moved: tasks hold x, make the
    new rows of the matrix from it and meet them with the rows of Z that lie there, and what each task has summed over
    its rows is all that is shuffled. The driver holds x and y.
    """
    n, tasks = len(x), sc.defaultParallelism
    size = max(1, min(size, PANEL_BYTES // (8 * n)))
    per = -(-size // ROWS)
    shared = sc.broadcast((x, y, ridge))
    deal = lambda key: key  # noqa: E731  one function for all steps, so that the union of their rows has as many partitions as each
    made: list[RDD] = []

    def step(lo: int, hi: int) -> RDD:
        starts = range(0, lo, WIDE)
        parts = max(1, min(tasks, len(starts)))

        def meet(records: Iterable[tuple]) -> Iterator[tuple]:
            """L, the new rows of the factor, times the rows of Z here, and L L^T."""
            x, across = shared.value[0], None
            for _, z in records:
                if across is None:
                    across, total, square = np.empty((hi - lo, lo)), np.zeros((hi - lo, lo)), np.zeros((hi - lo, hi - lo))
                    for at in starts:
                        across[:, at : at + WIDE] = K.rbf(x[lo:hi], x[at : min(at + WIDE, lo)], length)
                w = z.shape[1]
                factor = across[:, :w] @ z.T
                square += factor @ factor.T
                for at in range(0, w, WIDE):
                    total[:, at : min(at + WIDE, w)] += factor @ z[:, at : at + WIDE]
            if across is not None:
                yield from ((part, (None, square)) for part in range(parts))
                yield from ((c, (at, total[:, at : at + WIDE])) for c, at in enumerate(starts))

        def border(records: Iterable[tuple]) -> Iterator[tuple]:
            """The new rows of Z, in pieces."""
            square, pieces = 0, {}
            for _, (at, piece) in records:
                if at is None:
                    square = square + piece
                else:
                    pieces[at] = pieces[at] + piece if at in pieces else piece
            if not pieces and lo:
                return
            x, _, ridge = shared.value
            low = np.linalg.inv(np.linalg.cholesky(K.rbf(x[lo:hi], x[lo:hi], length) + np.diag(ridge[lo:hi]) - square))
            pieces = {at: -low @ piece for at, piece in pieces.items()} | ({lo: np.tril(low)} if not lo or 0 in pieces else {})
            for at, piece in pieces.items():
                yield from ((lo // size * per + r, (at, piece[r * ROWS : (r + 1) * ROWS])) for r in range(-(-(hi - lo) // ROWS)))

        def whole(records: Iterable[tuple]) -> Iterator[tuple]:
            found: dict[int, dict] = {}
            for key, (at, piece) in records:
                found.setdefault(key, {})[at] = piece
            yield from ((key, np.hstack([pieces[at] for at in sorted(pieces)])) for key, pieces in found.items())

        sums = sc.union(made).mapPartitions(meet).partitionBy(parts, deal) if lo else sc.parallelize([(0, (None, np.zeros((hi, hi))))], 1)
        return _kept(sums.mapPartitions(border).partitionBy(tasks, deal).mapPartitions(whole, True))

    def shares(records: Iterable[tuple]) -> Iterator[np.ndarray]:
        y = shared.value[1]
        out = np.zeros((n, 1 + y.shape[1]))
        for _, z in records:
            w = z.shape[1]
            out[:w, 0] += (z * z).sum(0)
            out[:w, 1:] += z.T @ (z @ y[:w])
        yield out

    try:
        stale = 0
        for lo in range(0, n, size):
            made.append(step(lo, min(lo + size, n)))
            stale += 8 * (tasks + 1) * size * lo
            if stale > STALE_BYTES:  # Spark deletes shuffles when their objects are collected, here and in the JVM
                stale = 0
                gc.collect()
                sc._jvm.System.gc()
        out = sc.union(made).mapPartitions(shares).treeReduce(np.add)
    finally:
        for rows in made:
            _drop(rows)
        shared.destroy()
    return out[:, 0], out[:, 1:]


class KernelRBF(ModelToken):
    """Leave-one-out kernel ridge on the residual: one dense solve for few series or inputs, one by steps for more."""

    name = "kernel_rbf"

    def __init__(self, alpha: float = 1e-2, median_subset: int = 24, seed: int = 0) -> None:
        self.alpha, self.subset, self.seed = alpha, median_subset, seed

    def ready(self, state: State) -> bool:
        return bool(state.bundle())

    def apply(self, state: State) -> State:
        n = state.df.count()
        alpha, subset, seed = self.alpha, self.subset, self.seed
        rows = state.df.select("series_id", "ord", state.bundle_column().alias("x"), state.residual().alias("y"))
        if n > MOST_DENSE:
            return state.push(state.df.join(self._by_input(rows, n, state.horizon), "series_id"), "new__", self.name)

        def solve(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("ord")
            x, y = np.array(g["x"].tolist(), float), np.array(g["y"].tolist(), float)
            some = x if len(x) <= subset else x[np.random.default_rng(seed).choice(len(x), subset, replace=False)]
            return pd.DataFrame({"series_id": g["series_id"], "new__": list(K.rbf_leave_one_out(x, y, alpha, K.median_distance(some)))})

        kind = state.df.schema["series_id"].dataType.simpleString()
        fit = rows.groupBy(F.lit(0).alias("all")).applyInPandas(solve, f"series_id {kind}, new__ array<double>")
        return state.push(state.df.join(fit, "series_id"), "new__", self.name)

    def _by_input(self, rows: DataFrame, n: int, horizon: int) -> DataFrame:
        """(series_id, new__) of many series: equal inputs are one row of the matrix with a smaller ridge, which is exact."""
        places = rows.select("series_id", (F.row_number().over(Window.orderBy("ord")) - 1).cast("long").alias("at"))
        placed = rows.join(places, "series_id").persist(StorageLevel.DISK_ONLY)
        chosen = np.random.default_rng(self.seed).choice(n, self.subset, replace=False).tolist() if n > self.subset else list(range(n))
        found = {r["at"]: r["x"] for r in placed.where(F.col("at").isin(chosen)).select("at", "x").collect()}
        alpha, length = self.alpha, K.median_distance(np.array([found[at] for at in chosen], float))
        mean = F.array(*[F.avg(F.get("y", F.lit(h))) for h in range(horizon)])
        inputs = placed.groupBy("x").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("copies"), mean.alias("mean")).persist(StorageLevel.DISK_ONLY)

        def numbers(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
            t = t.sort_by("first")
            x, y = (np.array(t.column(c).to_pylist(), float) for c in ("x", "mean"))
            return t, x, y, alpha / t.column("copies").to_numpy()

        def answer(t: pa.Table, diagonal: np.ndarray, solved: np.ndarray) -> pa.Table:
            return pa.table({"first": t.column("first"), "diagonal": diagonal, "solved": pa.array(list(solved), pa.list_(pa.float64()))})

        def solve(t: pa.Table) -> pa.Table:
            t, x, y, ridge = numbers(t)
            return answer(t, *K.rbf_ridge(x, y, ridge, length))

        if inputs.count() <= MOST_DENSE:
            solved = inputs.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "first long, diagonal double, solved array<double>")
        else:
            t, x, y, ridge = numbers(inputs.toArrow())
            spark = rows.sparkSession
            solved = spark.createDataFrame(answer(t, *bordered_ridge(spark.sparkContext, x, y, ridge, length, BLOCK)))
        # one large input is dealt to no task of its own: what was solved goes to the series
        each = placed.join(F.broadcast(inputs.join(F.broadcast(solved), "first")), "x")
        out = kernel(each, lambda y, *of: (K.rbf_held_out(y, *of, alpha),), ["y", "mean", "copies", "diagonal", "solved"], {"new__": ARRAY}).select("series_id", "new__")
        fit = out.localCheckpoint() if rows.sparkSession.sparkContext.getCheckpointDir() is None else out.checkpoint()
        inputs.unpersist()
        placed.unpersist()
        return fit


def fit_steps(state: State, regressor: RandomForestRegressor | GBTRegressor, tags: tuple[str, ...] = ()) -> DataFrame:
    """Adds new__: a distributed regressor for each step of the horizon, on the bundle, predicting the rows it saw."""
    rows = state.df.select("series_id", array_to_vector(state.bundle_column(tags)).alias("features"), state.residual().alias("y")).cache()
    out = rows
    for h in range(state.horizon):
        model = regressor.copy({regressor.labelCol: "label", regressor.predictionCol: f"p{h}"}).fit(rows.withColumn("label", F.get("y", F.lit(h))))
        out = model.transform(out)
    return state.df.join(out.select("series_id", F.array(*[f"p{h}" for h in range(state.horizon)]).alias("new__")), "series_id")


class _Tabular(ModelToken):
    requires = (Port("features", ("sample", "feature"), "history", "current", coerce=True),)
    tags: tuple[str, ...] = ()

    def ready(self, state: State) -> bool:
        return bool(state.bundle(self.tags))

    def apply(self, state: State) -> State:
        return state.push(fit_steps(state, self.regressor(), self.tags), "new__", self.name)


class RandomForestTabular(_Tabular):
    name = "rf_tabular"

    def __init__(self, n_estimators: int = 120, max_depth: int = 6, min_samples_leaf: int = 2, seed: int = 0) -> None:
        self.how = {"numTrees": n_estimators, "maxDepth": max_depth, "minInstancesPerNode": min_samples_leaf, "seed": seed}

    def regressor(self) -> RandomForestRegressor:
        return RandomForestRegressor(**self.how)


class LightGBMTabular(_Tabular):
    """Boosted trees with row and column sampling; leaves are bounded through the depth."""

    name = "lightgbm_tabular"

    def __init__(self, n_estimators: int = 200, learning_rate: float = 0.05, num_leaves: int = 31, min_child_samples: int = 20, subsample: float = 0.9, colsample: float = 0.9, seed: int = 0) -> None:
        self.how = {"maxIter": n_estimators, "stepSize": learning_rate, "maxDepth": math.ceil(math.log2(num_leaves)), "minInstancesPerNode": min_child_samples, "subsamplingRate": subsample, "featureSubsetStrategy": str(colsample), "seed": seed}

    def regressor(self) -> GBTRegressor:
        return GBTRegressor(**self.how)


class VersatileGB(_Tabular):
    name = "versatile_gb"

    def __init__(self, max_iter: int = 150, learning_rate: float = 0.06, max_depth: int | None = None, seed: int = 0, select_tags: tuple[str, ...] = ()) -> None:
        self.how, self.tags = {"maxIter": max_iter, "stepSize": learning_rate, "maxDepth": max_depth or 5, "seed": seed}, tuple(select_tags)

    def regressor(self) -> GBTRegressor:
        return GBTRegressor(**self.how)


class LevelShapeRidge(ModelToken):
    """Levels by Box-Cox innovations and averaged ridge, times their shapes."""

    name, reads = "level_shape_ridge", ("level_series", "shape_vector", "period")

    def __init__(self, alpha_log_min: float = -6, alpha_log_max: float = 3, n_alphas: int = 25, n_lambda_grid: int = 21, eps: float = 1e-6) -> None:
        self.alphas, self.grid, self.eps = (alpha_log_min, alpha_log_max, n_alphas), n_lambda_grid, eps

    def ready(self, state: State) -> bool:
        return not state.predictions

    def _run(self, state: State, outputs: dict[str, str]) -> DataFrame:
        cp, h, alphas, grid, eps = state.metadata.get("flair_cross_period", 1), state.horizon, self.alphas, self.grid, self.eps

        def run(level: np.ndarray, shape: np.ndarray, ahead: np.ndarray) -> tuple:
            made = K.level_forecast(np.asarray(level, float), np.asarray(shape, float), np.asarray(ahead, float), cp, h, alphas, grid, eps)
            return tuple(made.values())[: len(outputs)]

        return kernel(state.df, run, ["flair_level_work", "shape_vector", "flair_level_future_shape2"], outputs)

    def apply(self, state: State) -> State:
        return state.push(self._run(state, {"new__": ARRAY}), "new__", self.name)


class FlairRidgeLevel(LevelShapeRidge):
    """The same, keeping the fit for sample paths; for untransformed histories only."""

    name, reads = "FlairRidgeLevel", ("flair_level_work", "shape_vector", "period")

    def ready(self, state: State) -> bool:
        return not state.predictions and not state.transforms

    def apply(self, state: State) -> State:
        fits = {"flair_ridge_beta": ARRAY, "flair_residuals": ARRAY, "flair_phi": "double", "flair_lambda": "double", "flair_offset": "double", "flair_last": "double"}
        df = self._run(state, {"new__": ARRAY, **fits}).withColumn("flair_point_forecast", F.col("new__"))
        after = state.push(df, "new__", self.name)
        return after.emit(Signal("flair_point_forecast", "forecast", ("sample", "horizon"), "future", state.space, state.horizon, self.name)).note(flair_ridge_beta=True)


class FlairSamplePaths(FeatureToken):
    """Sample paths around the level model; they are no prediction of their own."""

    name, reads = "FlairSamplePaths", ("flair_level_work", "shape_vector", "flair_ridge_beta")

    def __init__(self, n_paths: int = 100, seed: int = 0, phase_noise_scale: float = 1.0, clip_to_history: bool = True, max_sample_values: float = 5e6) -> None:
        self.paths, self.seed, self.noise, self.clip, self.most = n_paths, seed, phase_noise_scale, clip_to_history, max_sample_values

    def ready(self, state: State) -> bool:
        return "FlairRidgeLevel" in state.sequence

    def apply(self, state: State) -> State:
        cp, h, p, seed, noise, clip = state.metadata["flair_cross_period"], state.horizon, state.metadata["period"], self.seed, self.noise, self.clip
        paths = min(max(1, self.paths), max(1, int(self.most // max(state.horizon * max(state.df.count(), 1), 1))))

        def run(level, raw, matrix, shape, ahead, beta, resid, phi, lam, offset, last, history, ord_) -> tuple:
            model = {"beta": np.asarray(beta), "residuals": resid, "phi": phi, "lambda": lam, "offset": offset, "last": last}
            m = np.asarray(matrix, float).reshape(p, -1)
            ends = (float(np.min(history)), float(np.max(history))) if clip else None
            return (K.sample_paths(model, np.asarray(level, float), np.asarray(raw, float), m, np.asarray(shape, float), np.asarray(ahead, float), cp, h, paths, [seed, int(ord_)], noise, ends).ravel(),)

        inputs = ["flair_level_work", "flair_level_raw", "flair_period_matrix", "shape_vector", "flair_level_future_shape2", "flair_ridge_beta", "flair_residuals", "flair_phi", "flair_lambda", "flair_offset", "flair_last", "original_history", "ord"]
        df = kernel(state.df, run, inputs, {"flair_samples": ARRAY})
        mean = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(paths - 1)), F.lit(0.0), lambda s, k: s + F.get("flair_samples", k * h + j)) / F.lit(float(paths)))
        df = df.withColumn("flair_sample_mean", mean)
        return state.emit(Signal("flair_samples", "samples", ("sample", "path", "horizon"), "future", state.space, paths * h, self.name), df=df).note(FlairSamplePaths={"n_paths": paths, "seed": seed})


def sample_rows(state: State) -> DataFrame:
    """(series_id, path, h, y) of the sample paths."""
    h = state.horizon
    return state.df.select("series_id", F.posexplode("flair_samples").alias("i", "y")).select("series_id", F.floor(F.col("i") / h).cast("int").alias("path"), (F.col("i") % h).alias("h"), "y")


class GBLevelForecast(ModelToken):
    """Boosted trees from the last levels to the next, pooled over all series; rolled forward and given their shape."""

    name, reads = "gb_level_forecast", ("level_series", "shape_vector", "period")
    requires = (Port("level"), Port("shape"))

    def __init__(self, n_lags: int = 3, max_iter: int = 120, learning_rate: float = 0.08, seed: int = 0) -> None:
        self.lags, self.how = n_lags, {"maxIter": max_iter, "stepSize": learning_rate, "seed": seed, "maxDepth": 5}

    def ready(self, state: State) -> bool:
        return not state.predictions and not state.transforms

    def apply(self, state: State) -> State:
        p, cycles, h = state.metadata["period"], state.metadata["n_complete_periods"], state.horizon
        m, lags = math.ceil(h / p), max(1, min(self.lags, cycles - 1))
        df = state.df.withColumn("roll__", F.slice("level_series", cycles - lags + 1, lags))
        if cycles > lags:
            pairs = state.df.select(F.explode(F.transform(F.sequence(F.lit(lags), F.lit(cycles - 1)), lambda t: F.struct(F.slice("level_series", t - lags + 1, lags).alias("x"), F.get("level_series", t).alias("label")))).alias("r"))
            pairs = pairs.select(array_to_vector("r.x").alias("features"), "r.label").cache()
            model = GBTRegressor(**self.how).fit(pairs)
            pairs.unpersist()
            for _ in range(m):
                ahead = model.transform(df.withColumn("features", array_to_vector(F.slice("roll__", F.size("roll__") - lags + 1, lags))))
                df = ahead.withColumn("roll__", F.concat("roll__", F.array("prediction"))).drop("features", "prediction")
            df = df.withColumn("roll__", F.slice("roll__", lags + 1, m))
        else:
            df = df.withColumn("roll__", F.array_repeat(F.element_at("level_series", -1), m))
        each = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda t: F.get("roll__", F.floor(t / p).cast("int")) * F.get("shape_vector", t % p))
        return state.push(df.withColumn("new__", each).withColumnRenamed("roll__", "gb_level_point"), "new__", self.name)


def paired_covariates(state: State) -> list[tuple[Signal, Signal]]:
    """History and future signals of one source with as many channels, the first match of each."""
    out = []
    for past in state.board:
        if past.alignment == "history" and past.axes == ("sample", "time", "feature"):
            for ahead in state.board:
                if ahead.alignment == "future" and ahead.axes == ("sample", "horizon", "feature") and ahead.source == past.source and ahead.size * state.length == past.size * state.horizon:
                    out.append((past, ahead))
                    break
    return out


class StepRegression(ModelToken):
    """Trees on known covariates and time: a series' history is fitted, its future predicted."""

    name = "step_regression"

    def __init__(self, estimator: str = "rf", per_series: bool = True, include_index: bool = True, n_estimators: int = 60, max_depth: int = 12, learning_rate: float = 0.08, max_iter: int = 150, seed: int = 0, target_feature: str | None = None) -> None:
        self.gb, self.per_series, self.index, self.trees, self.depth, self.rate, self.rounds, self.seed, self.target = estimator == "gb", per_series, include_index, n_estimators, max_depth, learning_rate, max_iter, seed, target_feature

    def ready(self, state: State) -> bool:
        return self.index or bool(paired_covariates(state))

    def apply(self, state: State) -> State:
        pairs, t, h, index = paired_covariates(state), state.length, state.horizon, self.index
        target = self.target or state.first_of("scaled_history") or "raw_history"
        gb, trees, depth, rate, rounds, seed = self.gb, self.trees, self.depth, self.rate, self.rounds, self.seed

        def design(blocks: tuple, start: int, count: int) -> np.ndarray:
            parts = [np.asarray(b, float).reshape(count, -1) for b in blocks]
            return np.concatenate([*parts, *([(np.arange(start, start + count) / t)[:, None]] if index else [])], 1)

        if not self.per_series:
            return self._pooled(state, pairs, target)

        def run(y: np.ndarray, *blocks: np.ndarray) -> tuple:
            x, new = design(blocks[: len(pairs)], 0, t), design(blocks[len(pairs) :], t, h)
            y = np.asarray(y, float)[:, None]
            made = K.boosted(x, y, new, rounds, rate, min(depth, 5), 2) if gb else K.forest(x, y, new, trees, depth, 1, seed)
            return (made[:, 0],)

        df = kernel(state.df, run, [target, *[a.name for a, _ in pairs], *[b.name for _, b in pairs]], {"new__": ARRAY})
        return state.push(df, "new__", self.name)

    def _pooled(self, state: State, pairs: list[tuple[Signal, Signal]], target: str) -> State:
        def rows(side: int, start: int, count: int) -> DataFrame:
            def at(j: Column) -> Column:
                blocks = [F.slice(p[side].name, j * (p[side].size // count) + 1, p[side].size // count) for p in pairs]
                own = [F.array((j + start).cast("double") / F.lit(float(state.length)))] if self.index else []
                return F.struct(j.alias("j"), F.concat(*blocks, *own).alias("x"), *([F.get(target, j).alias("label")] if side == 0 else []))

            each = state.df.select("series_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)).alias("r"))
            return each.select("series_id", "r.*").withColumn("features", array_to_vector("x"))

        how = {"maxDepth": min(self.depth, 12), "seed": self.seed}
        model = (GBTRegressor(maxIter=self.rounds, stepSize=self.rate, **how) if self.gb else RandomForestRegressor(numTrees=self.trees, **how)).fit(rows(0, 0, state.length))
        made = model.transform(rows(1, state.length, state.horizon)).groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "prediction"))), lambda r: r["prediction"]).alias("new__"))
        return state.push(state.df.join(made, "series_id"), "new__", self.name)


class AffineForecast(ModelToken):
    name, reads = "affine_forecast", ("affine_shift", "affine_scale", "affine_shape", "period")

    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def ready(self, state: State) -> bool:
        return state.metadata["period"] > 0

    def apply(self, state: State) -> State:
        h, p, alpha = state.horizon, state.metadata["period"], self.alpha
        m, j = math.ceil(h / p), np.arange(h)

        def run(shift: np.ndarray, scale: np.ndarray, shape: np.ndarray) -> tuple:
            return (K.ridge_ar(shift, m, alpha)[:, j // p] + np.maximum(K.ridge_ar(scale, m, alpha), 0)[:, j // p] * shape[:, j % p],)

        return state.push(kernel(state.df, run, ["affine_shift", "affine_scale", "affine_shape"], {"new__": ARRAY}, stacked=True), "new__", self.name)

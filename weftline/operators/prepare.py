"""Cleaning, scaling and feature tokens."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.state import Port, Signal, State, kernel
from .base import CleaningToken, FeatureToken, TransformToken

ARRAY = "array<double>"
#: Where each family of tokens looks for its history first.
CLEAN_FIRST = ("clean_history", "scaled_history", "raw_history")
SCALED_FIRST = ("scaled_history", "clean_history", "raw_history")


def history_of(state: State, names: tuple[str, ...]) -> str:
    """The first of the named histories on the board; in a strict space none but those of the present space."""
    for n in names:
        s = next((x for x in state.board if x.name == n), None)
        if s is not None and not (state.strict_space and len(state.transforms) and n == "clean_history" and any(x.name == "scaled_history" for x in state.board)):
            return n
    return "raw_history"


class _Fill(CleaningToken):
    reads, max_uses = ("raw_history",), 1
    fill: Callable[[np.ndarray], np.ndarray]

    def ready(self, state: State) -> bool:
        return "history_filled" not in state.flags

    def apply(self, state: State) -> State:
        fill = type(self).fill
        df = kernel(state.df, lambda y: (fill(np.asarray(y, float)),), ["raw_history"], {"raw_history": ARRAY}).withColumn("clean_history", F.col("raw_history"))
        raw = Signal("raw_history", "series", ("sample", "time"), "history", state.space, state.length, self.name, ("raw_scale",))
        clean = Signal("clean_history", "series", ("sample", "time"), "history", state.space, state.length, self.name, ("no_bundle",))
        return state.emit(raw, clean, df=df).note(("history_filled",))


class LinearFill(_Fill):
    """Missing values on the line between their neighbours."""

    name = "LinearFill"
    fill = staticmethod(K.linear_fill)


class ForwardFill(_Fill):
    """Missing values as the last known one."""

    name = "ForwardFill"
    fill = staticmethod(K.forward_fill)


class FlairPreprocess(LinearFill):
    name = "FlairPreprocess"


class _Scale(TransformToken):
    reads = ("raw_history",)
    flag = ""

    def ready(self, state: State) -> bool:
        return self.flag not in state.flags

    def fit(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def forward(self, y: Column) -> Column:
        raise NotImplementedError

    def inverse(self, y: Column) -> Column:
        raise NotImplementedError

    def apply(self, state: State) -> State:
        df = self.fit(state.df)
        df = df.withColumn("scaled_history", self.forward(F.col("raw_history")))
        after = state.emit(df=df).register_transform(self.name, self.forward, self.inverse)
        return after.emit(Signal("scaled_history", "series", ("sample", "time"), "history", after.space, state.length, self.name)).note((self.flag,))


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row; named in a lambda, it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class ZNormalization(_Scale):
    """(y - mean) / (population deviation + 1e-8) of the active history."""

    name, flag = "ZNormalization", "is_z_normalized"

    def fit(self, df: DataFrame) -> DataFrame:
        y, n = F.col("raw_history"), F.size("raw_history").cast("double")
        spread = lambda m: F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n) + F.lit(1e-8)
        return df.withColumn("z_fit", bound(total(y) / n, lambda m: F.struct(m.alias("mu"), spread(m).alias("sigma"))))

    def forward(self, y: Column) -> Column:
        return bound(F.col("z_fit"), lambda z: F.transform(y, lambda x: (x - z["mu"]) / z["sigma"]))

    def inverse(self, y: Column) -> Column:
        return bound(F.col("z_fit"), lambda z: F.transform(y, lambda x: x * z["sigma"] + z["mu"]))


class MeanAbsScaling(_Scale):
    """y / (mean of |y| + 1e-8) of the active history."""

    name, flag = "MeanAbsScaling", "is_mean_abs_scaled"

    def fit(self, df: DataFrame) -> DataFrame:
        size = F.aggregate("raw_history", F.lit(0.0), lambda s, x: s + F.abs(x))
        return df.withColumn("abs_scale", size / F.size("raw_history").cast("double") + F.lit(1e-8))

    def forward(self, y: Column) -> Column:
        return bound(F.col("abs_scale"), lambda z: F.transform(y, lambda x: x / z))

    def inverse(self, y: Column) -> Column:
        return bound(F.col("abs_scale"), lambda z: F.transform(y, lambda x: x * z))


class FourierFeatures(FeatureToken):
    name, max_uses = "FourierFeatures", 1

    def __init__(self, n_harmonics: int = 16, source_feature: str = "scaled_history", fallback_to_raw: bool = True, include_summary: bool = True, center: bool = True) -> None:
        self.n_harmonics, self.source, self.fallback, self.summary, self.center = n_harmonics, source_feature, fallback_to_raw, include_summary, center

    def _source(self, state: State) -> str | None:
        return state.first_of(self.source, *(("raw_history",) if self.fallback else ()))

    def ready(self, state: State) -> bool:
        return "fourier_features" not in state.metadata and self._source(state) is not None and state.length >= 3

    def apply(self, state: State) -> State:
        n, summary, center = self.n_harmonics, self.summary, self.center
        df = kernel(state.df, lambda y: (K.fourier(y, n, summary, center),), [self._source(state)], {"fourier_features": ARRAY})
        width = 4 * min(n, state.length // 2) + 6 * summary
        return state.emit(Signal("fourier_features", "features", ("sample", "feature"), "history", state.space, width, self.name), df=df).note(fourier_features=width)


class PeriodDetect(FeatureToken):
    """The candidate period of the smallest mean BIC over the first series; a collect of at most max_series rows."""

    name, max_uses, reads = "PeriodDetect", 1, ("raw_history",)
    provides = (Port("param:periods", (), "static"),)

    def __init__(self, freq: str = "H", max_series: int = 8, min_complete: int = 3, source_feature: str = "scaled_history", margin: float = 0.1, max_periods: int = 4) -> None:
        self.freq, self.max_series, self.min_complete, self.source = freq, max_series, min_complete, source_feature

    def ready(self, state: State) -> bool:
        return "periods" not in state.metadata

    def choose(self, rows: list[np.ndarray], candidates: list[int]) -> tuple[int, dict[int, float]]:
        scores = {p: float(np.mean([K.period_bic(x, p) for x in rows])) for p in [1, *candidates]}
        return min(candidates, key=lambda p: (scores[p], p)), scores

    def apply(self, state: State) -> State:
        source = state.first_of("clean_history", "flair_history", self.source) or "raw_history"
        candidates = K.candidate_periods(self.freq, state.length, self.min_complete)
        rows = [np.asarray(r[0], float) for r in state.df.orderBy("ord").limit(self.max_series).select(source).collect()] if candidates else []
        period, scores = self.choose(rows, candidates) if rows else (0, {})
        periods = K.period_chain(period, self.freq, state.length, self.min_complete)
        return state.put_param("periods", periods, self.name).note(("periods_detected",), period=period, period_scores=scores, freq=self.freq)


class PeriodDetectBIC(PeriodDetect):
    name = "PeriodDetectBIC"


class PeriodDetectSpectral(PeriodDetect):
    """The candidate period around whose bin most of the power lies."""

    name = "PeriodDetectSpectral"

    def __init__(self, *args: object, power_threshold: float = 0.05, band: int = 1, **kwargs: object) -> None:
        super().__init__(*args, **kwargs)
        self.band = band

    def choose(self, rows: list[np.ndarray], candidates: list[int]) -> tuple[int, dict[int, float]]:
        scores = {p: float(np.mean([K.spectral_share(x, p, self.band) for x in rows])) for p in candidates}
        return min(candidates, key=lambda p: (-scores[p], p)), scores


def phase_ids(length: int, horizon: int, period: int, anchor: str = "fold") -> tuple[Column, Column]:
    """Phases of history and future: closed forms of time, the same for all series."""
    shift = length % period if anchor == "fold" else 0
    ahead = 0 if anchor == "fold" else length
    past = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.pmod(t - F.lit(shift), F.lit(period)))
    return past, F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda j: F.pmod(j + F.lit(ahead), F.lit(period)))


def one_hot(phases: Column, period: int) -> Column:
    return F.flatten(F.transform(phases, lambda p: F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda k: F.when(k == p, F.lit(1.0)).otherwise(F.lit(0.0)))))


class PeriodPhaseOneHot(FeatureToken):
    name, max_uses, reads = "PeriodPhaseOneHot", 1, ("raw_history", "period")

    def __init__(self, anchor: str = "fold", include_history_onehot: bool | str = "auto", max_history_onehot_cells: float = 2e7, max_future_onehot_cells: float = 5e7) -> None:
        self.anchor, self.include, self.most_past, self.most_ahead = anchor, include_history_onehot, max_history_onehot_cells, max_future_onehot_cells

    def ready(self, state: State) -> bool:
        p = state.metadata["period"]
        fits = p > 0 and state.horizon * p <= self.most_ahead and (self.include is not True or state.length * p <= self.most_past)
        return fits and "period_phase_encoded" not in state.flags

    def apply(self, state: State) -> State:
        p = state.metadata["period"]
        past, ahead = phase_ids(state.length, state.horizon, p, self.anchor)
        columns = {"phase_id_history": F.transform(past, lambda x: x.cast("double")), "phase_onehot_future": one_hot(ahead, p)}
        signals = [
            Signal("phase_id_history", "features", ("sample", "feature"), "history", state.space, state.length, self.name),
            Signal("phase_onehot_future", "features", ("sample", "time", "feature"), "future", state.space, state.horizon * p, self.name, ("no_bundle",)),
        ]
        if self.include is True or (self.include == "auto" and state.length * p <= self.most_past):
            columns["phase_onehot_history"] = one_hot(past, p)
            signals.append(Signal("phase_onehot_history", "features", ("sample", "time", "feature"), "history", state.space, state.length * p, self.name))
        return state.emit(*signals, df=state.df.withColumns(columns)).note(("period_phase_encoded",))


class SeasonalFold(FeatureToken):
    """Folds the history by the primary period, then takes second shapes of coarser periods out of the levels."""

    name, max_uses, reads = "SeasonalFold", 6, ("raw_history",)
    requires = (Port("param:periods", (), "static"),)

    def __init__(self, shape_k: int = 2, shrink_level: bool = False, min_factor: float = 0.05, secondary_min_strength: float = 0.05) -> None:
        self.shape_k, self.shrink, self.min_factor, self.strength = shape_k, shrink_level, min_factor, secondary_min_strength

    def ready(self, state: State) -> bool:
        periods, depth = state.metadata["periods"], state.metadata.get("fold_depth", 0)
        if depth >= len(periods) or state.length // periods[0] < 2:
            return False
        return depth == 0 or self._secondary(state) is not None

    def _secondary(self, state: State) -> int | None:
        """The unused coarser period, in cycles, that shapes the mean level most: one row of sums."""
        p, cycles = state.metadata["period"], state.metadata["n_complete_periods"]
        used = state.metadata["flair_cross_periods"]
        level = np.array(state.df.agg(*[F.avg(F.get("flair_level_work", F.lit(i))) for i in range(cycles)]).first(), float)
        best = None
        for coarse in state.metadata["periods"][1:]:
            cp = coarse // p
            if cp >= 2 and cp not in used and cycles // cp >= 2:
                shape = K.second_shape(level, cp)
                if shape is not None:
                    size = float(np.abs(shape - 1).max())
                    if size > self.strength and (best is None or size > best[0]):
                        best = size, cp
        return best and best[1]

    def apply(self, state: State) -> State:
        return self._again(state) if state.metadata.get("fold_depth", 0) else self._first(state)

    def _first(self, state: State) -> State:
        p = state.metadata["periods"][0]
        cycles, m = state.length // p, math.ceil(state.horizon / p)
        k, shrink, least = self.shape_k, self.shrink, self.min_factor

        def run(x: np.ndarray) -> tuple:
            matrix = K.fold(x, p)
            level = matrix.sum(0)
            factor = K.level_shrink(matrix, least) if shrink else 1.0
            return matrix.ravel(), level * factor, K.shape_of(matrix, k), np.ones(m)

        source = history_of(state, ("clean_history", "flair_history", "raw_history"))
        df = kernel(state.df, run, [source], {"period_matrix": ARRAY, "level_series": ARRAY, "shape_vector": ARRAY, "flair_level_future_shape2": ARRAY})
        df = df.withColumns({"flair_level_work": F.col("level_series"), "flair_level_raw": F.col("level_series"), "flair_period_matrix": F.col("period_matrix"), "flair_shape": F.col("shape_vector")})
        made = lambda name, sem, axes, size: Signal(name, sem, axes, "history", state.space, size, self.name)
        flat = ("sample", "feature")
        out = state.emit(
            made("period_matrix", "features", flat, p * cycles), made("level_series", "level", ("sample", "period_idx"), cycles), made("shape_vector", "shape", ("sample", "phase"), p),
            made("flair_period_matrix", "features", flat, p * cycles), made("flair_level_raw", "features", flat, cycles), made("flair_level_work", "level", ("sample", "period_idx"), cycles), made("flair_shape", "features", flat, p), df=df,
        )
        return out.note(period=p, n_complete_periods=cycles, shape_k=min(max(k, 1), cycles), fold_depth=1, flair_cross_period=1, flair_cross_periods=())

    def _again(self, state: State) -> State:
        cp, m = self._secondary(state), math.ceil(state.horizon / state.metadata["period"])

        def run(level: np.ndarray, future: np.ndarray) -> tuple:
            shape = K.second_shape(level, cp)
            if shape is None:
                return level, future
            level = np.asarray(level, float)
            return level / shape[np.arange(len(level)) % cp], np.asarray(future) * shape[(len(level) + np.arange(m)) % cp]

        df = kernel(state.df, run, ["flair_level_work", "flair_level_future_shape2"], {"flair_level_work": ARRAY, "flair_level_future_shape2": ARRAY})
        used = (*state.metadata["flair_cross_periods"], cp)
        return state.emit(df=df).note(fold_depth=state.metadata["fold_depth"] + 1, flair_cross_periods=used, flair_cross_period=max(used))


def channels(start: int, count: int, periods: list[int], harmonics: int) -> Column:
    """sin and cos of each period's harmonics from a time on, time by time: closed forms."""
    turn = lambda t, p, h: F.lit(2 * math.pi * h) * t.cast("double") / F.lit(float(p))
    pairs = [(p, h) for p in periods for h in range(1, harmonics + 1)]
    return F.flatten(F.transform(F.sequence(F.lit(start), F.lit(start + count - 1)), lambda t: F.array(*[f(turn(t, p, h)) for p, h in pairs for f in (F.sin, F.cos)])))


class SeasonalFeatures(FeatureToken):
    name, max_uses, reads = "SeasonalFeatures", 1, ("raw_history",)
    requires = (Port("param:periods", (), "static"),)

    def __init__(self, n_harmonics: int = 2, source_feature: str = "scaled_history") -> None:
        self.n_harmonics, self.source = n_harmonics, source_feature

    def ready(self, state: State) -> bool:
        return "seasonal_features_built" not in state.flags

    def apply(self, state: State) -> State:
        periods, n = state.metadata["periods"], self.n_harmonics
        if not periods:
            raise ValueError("no period was found, so there are no seasonal features")
        width = 2 * len(periods) * n
        df = state.df.withColumns({"seasonal_history": channels(0, state.length, periods, n), "seasonal_future": channels(state.length, state.horizon, periods, n)})
        df = kernel(df, lambda y: (K.projection(y, periods, n),), [state.first_of(self.source) or "raw_history"], {"seasonal_projection": ARRAY})
        return state.emit(
            Signal("seasonal_history", "features", ("sample", "time", "feature"), "history", state.space, state.length * width, self.name, ("no_bundle",)),
            Signal("seasonal_future", "features", ("sample", "horizon", "feature"), "future", state.space, state.horizon * width, self.name, ("no_bundle",)),
            Signal("seasonal_projection", "features", ("sample", "feature"), "history", state.space, 3 * len(periods) * n + 1, self.name), df=df,
        ).note(("seasonal_features_built",), seasonal_width=width)


class AffineFold(FeatureToken):
    name, max_uses, reads = "affine_fold", 1, ("raw_history",)
    requires = (Port("param:periods", (), "static"),)

    def __init__(self, shape_k: int = 2, min_complete: int = 2) -> None:
        self.shape_k, self.min_complete = shape_k, min_complete

    def ready(self, state: State) -> bool:
        periods = state.metadata["periods"]
        return "affine_shape_k" not in state.metadata and bool(periods) and state.length // periods[0] >= self.min_complete

    def apply(self, state: State) -> State:
        p, k = state.metadata["periods"][0], self.shape_k
        df = kernel(state.df, lambda x: K.affine_parts(x, p, k), [history_of(state, CLEAN_FIRST)], {"affine_shift": ARRAY, "affine_scale": ARRAY, "affine_shape": ARRAY})
        made = lambda name, size: Signal(name, "features", ("sample", "feature"), "history", state.space, size, self.name)
        cycles = state.length // p
        return state.emit(made("affine_shift", cycles), made("affine_scale", cycles), made("affine_shape", p), df=df).note(period=p, affine_shape_k=k)

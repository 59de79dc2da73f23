"""The state of a pipeline: a lazy DataFrame of one row per series, and what is known of its columns.

States are values: an operator returns a new one, so a common prefix of pipelines is planned once and shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

SEMS = ("series", "features", "level", "shape", "forecast", "samples", "mask", "param")
AXES = ("sample", "time", "horizon", "feature", "phase", "period_idx", "path")
ALIGNMENTS = ("history", "future", "static")
RAW = ("raw",)


@dataclass(frozen=True)
class Signal:
    """What a column of the state holds. space: the transforms it has been through; size: its flat length for a series."""

    name: str
    sem: str
    axes: tuple[str, ...]
    alignment: str = "history"
    space: tuple[str, ...] = RAW
    size: int = 0
    source: str = ""
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.sem.split(":")[0] not in SEMS or any(a not in AXES for a in self.axes) or self.alignment not in ALIGNMENTS:
            raise ValueError(f"unknown sem, axis or alignment in {self}")

    @property
    def root(self) -> str:
        return self.sem.split(":")[0]


@dataclass(frozen=True)
class Port:
    """What an operator needs on the board; custom spaces count as any."""

    sem: str
    axes: tuple[str, ...] | None = None
    alignment: str | None = None
    space: str = "any"
    tags: tuple[str, ...] = ()
    optional: bool = False
    coerce: bool = False

    def matches(self, signal: Signal, current: tuple[str, ...]) -> bool:
        return matches(signal, self.sem, self.axes, self.alignment, current if self.space == "current" else None, self.tags)


def matches(s: Signal, sem: str | None, axes: tuple | None, alignment: str | None, space: tuple | None, tags: tuple) -> bool:
    same = sem is None or (s.sem == sem if ":" in sem else s.root == sem)
    return same and (axes is None or s.axes == axes) and alignment in (None, s.alignment) and space in (None, s.space) and set(tags) <= set(s.tags)


#: Coercions of a column to (sample, feature): row-major flattening, which flat columns are already in.
ADAPTERS: dict[tuple[str, tuple[str, ...]], Callable[[Column], Column]] = {
    ("series", ("sample", "time")): lambda c: c,
    ("level", ("sample", "period_idx")): lambda c: c,
    ("shape", ("sample", "phase")): lambda c: c,
    ("features", ("sample", "time", "feature")): lambda c: c,
}


def register_adapter(sem: str, axes: tuple[str, ...], adapter: Callable[[Column], Column]) -> None:
    ADAPTERS[sem, axes] = adapter


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _values(column: pa.Array) -> list:
    """A batch's column by rows; lists as arrays, with NaN for missing values."""
    if not (pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type)):
        return column.to_pylist()
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [None if none else flat[a:z] for a, z, none in zip(at[:-1], at[1:], column.is_null().to_pylist(), strict=True)]


def kernel(df: DataFrame, function: Callable[..., tuple], inputs: list[str], outputs: dict[str, str], stacked: bool = False) -> DataFrame:
    """df with the outputs of a function of one series' values (stacked: of all series of a batch, one below the other).

    It is a node of the plan with Arrow batches in and out, and without a shuffle: no expression before or after it can
    be moved into it. So all other columns pass through it.
    """
    made = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in outputs.items())).fields
    rest = [f for f in df.schema.fields if f.name not in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_values(batch.column(c)) for c in inputs]
            if not batch.num_rows:
                found = [[]] * len(outputs)
            elif stacked:
                found = [list(x) for x in function(*map(np.stack, columns))]
            else:
                found = list(zip(*(function(*row) for row in zip(*columns, strict=True)), strict=True))
            new = [pa.array(x, pa.list_(pa.float64()) if isinstance(f.dataType, ArrayType) else pa.float64()) for x, f in zip(found, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *new], [f.name for f in [*rest, *made]])

    return df.select(*[f.name for f in rest], *[c for c in inputs if c in outputs]).mapInArrow(run, StructType([*rest, *made]))


@dataclass(frozen=True)
class State:
    """df: series_id, ord, original_history, raw_history, original_future, target_base, artifacts, pred_1, pred_2, ..."""

    df: DataFrame
    length: int
    horizon: int
    board: tuple[Signal, ...] = ()
    transforms: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    predictions: tuple[tuple[str, str], ...] = ()
    flags: frozenset[str] = frozenset()
    metadata: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))
    sequence: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    log: tuple[dict, ...] = ()
    strict_space: bool = False

    @property
    def space(self) -> tuple[str, ...]:
        names = tuple(t[0] for t in self.transforms)
        return names or RAW

    @property
    def features(self) -> list[Signal]:
        """Historical features: what operators have added, but for the raw history itself."""
        return [s for s in self.board if s.alignment == "history" and s.name != "raw_history" and s.root not in ("forecast", "param", "samples")]

    def has(self, name: str) -> bool:
        return any(s.name == name for s in self.board) or name in self.metadata

    def emit(self, *signals: Signal, df: DataFrame | None = None) -> State:
        """Signals of new columns; one of a known name takes its place."""
        board = list(self.board)
        for s in signals:
            at = next((i for i, old in enumerate(board) if old.name == s.name), None)
            if at is None:
                board.append(s)
            else:
                board[at] = s
        return replace(self, board=tuple(board), df=self.df if df is None else df)

    def note(self, flags: tuple[str, ...] = (), **metadata: object) -> State:
        return replace(self, flags=self.flags | set(flags), metadata=MappingProxyType({**self.metadata, **metadata}))

    def put_param(self, name: str, value: object, source: str) -> State:
        return self.emit(Signal(f"param:{name}", f"param:{name}", (), "static", RAW, 0, source)).note(**{name: value})

    def query(self, sem: str | None = None, axes: tuple | None = None, alignment: str | None = None, space: tuple | None = None, tags: tuple = ()) -> list[Signal]:
        """Matching signals, the most recent first."""
        return [s for s in reversed(self.board) if matches(s, sem, axes, alignment, space, tags)]

    def one(self, **what: object) -> Signal:
        found = self.query(**what)
        if not found:
            raise KeyError(f"no signal {what}")
        return found[0]

    def first_of(self, *names: str) -> str | None:
        return next((n for n in names if any(s.name == n for s in self.board)), None)

    def register_transform(self, name: str, forward: Callable[[Column], Column], inverse: Callable[[Column], Column]) -> State:
        """Moves the target and all signals of the present space, but parameters, predictions and raw scale, into a new one."""
        old, df = self.space, self.df.withColumn("target_base", forward(F.col("target_base")))
        space = (*[t[0] for t in self.transforms], name)
        board = tuple(replace(s, space=space) if s.space == old and s.root not in ("param", "forecast", "samples") and "raw_scale" not in s.tags else s for s in self.board)
        return replace(self, df=df, transforms=(*self.transforms, (name, inverse)), board=board)

    def cumulative(self) -> Column:
        """Sum of all predictions so far, in the present space."""
        zeros = F.array_repeat(F.lit(0.0), self.horizon)
        return reduce(add, [F.col(c) for _, c in self.predictions], zeros)

    def residual(self) -> Column:
        """What is left of the target."""
        return subtract(F.col("target_base"), self.cumulative())

    def push(self, df: DataFrame, column: str, token: str) -> State:
        name = f"pred_{len(self.predictions) + 1}"
        signal = Signal(f"forecast#{token}#{len(self.predictions) + 1}", "forecast", ("sample", "horizon"), "future", self.space, self.horizon, token)
        return replace(self, df=df.withColumnRenamed(column, name), predictions=(*self.predictions, (token, name))).emit(signal)

    def decoded(self) -> Column:
        """The forecast: inverse transforms, last first, of the sum of predictions."""
        out = self.cumulative()
        for _, inverse in reversed(self.transforms):
            out = inverse(out)
        return out

    def record(self, token: str, kind: str, reads: list[str], writes: list[str]) -> State:
        entry = {"step": len(self.sequence) + 1, "token": token, "reads": reads, "writes": writes}
        return replace(self, sequence=(*self.sequence, token), classes=(*self.classes, kind), log=(*self.log, entry))

    def set_model_input(self, *names: str) -> State:
        """Has models see these signals, in this order, in place of the bundle; none: the bundle again."""
        for n in names:
            self.one_named(n)
        return replace(self, metadata=MappingProxyType({**self.metadata, "model_input": names or None}))

    def one_named(self, name: str) -> Signal:
        found = next((s for s in self.board if s.name == name), None)
        if found is None:
            raise KeyError(f"no signal {name}")
        return found

    def bundle(self, tags: tuple[str, ...] = ()) -> list[Signal]:
        """History-aligned blocks that a model sees: coercible, in the present space if series, each name once.

        What set_model_input has named wins over all of them.
        """
        if self.metadata.get("model_input"):
            return [self.one_named(n) for n in self.metadata["model_input"]]
        out, names = [], set()
        for s in self.board:
            fits = s.alignment == "history" and s.root not in ("forecast", "samples", "param", "mask") and "no_bundle" not in s.tags and s.size > 0
            fits = fits and (s.root != "series" or s.space == self.space) and (not tags or s.name in tags or set(tags) & set(s.tags))
            if fits and s.name not in names and (s.axes == ("sample", "feature") or (s.root, s.axes) in ADAPTERS):
                out.append(s)
                names.add(s.name)
        return out

    def bundle_column(self, tags: tuple[str, ...] = ()) -> Column:
        blocks = self.bundle(tags)
        if not blocks:
            raise ValueError("no block on the board can be given to a model")
        return F.concat(*[ADAPTERS.get((s.root, s.axes), lambda c: c)(F.col(s.name)) for s in blocks])

    def board_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.name, s.sem, list(s.axes), s.alignment, "/".join(s.space), s.size, s.source, list(s.tags)) for i, s in enumerate(self.board)]
        return spark.createDataFrame(rows, "pos int, name string, sem string, axes array<string>, alignment string, space string, size int, source string, tags array<string>")

    def bundle_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s.name, s.sem, s.size) for i, s in enumerate(self.bundle())], "pos int, name string, sem string, width int")

    def log_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["step"], e["token"], e["reads"], e["writes"]) for e in self.log], "step int, token string, reads array<string>, writes array<string>")


def start(panel: DataFrame, length: int, horizon: int, strict_space: bool = False) -> State:
    """The state of a panel (series_id, ord, history, future)."""
    df = panel.select("series_id", "ord", F.col("history").alias("original_history"), F.col("history").alias("raw_history"), F.col("future").alias("original_future"), F.col("future").alias("target_base"))
    raw = Signal("raw_history", "series", ("sample", "time"), "history", RAW, length, "input", ("raw_scale",))
    return State(df, length, horizon, (raw,), strict_space=strict_space)


def difference(before: State, after: State) -> dict[str, list[str]]:
    """Names of signals and metadata that a step has added, removed and changed."""
    a = {s.name: s for s in before.board} | {f"meta:{k}": v for k, v in before.metadata.items()}
    z = {s.name: s for s in after.board} | {f"meta:{k}": v for k, v in after.metadata.items()}
    return {"added": sorted(z.keys() - a.keys()), "removed": sorted(a.keys() - z.keys()), "changed": sorted(k for k in a.keys() & z.keys() if a[k] is not z[k] and a[k] != z[k])}


def residual_norm(state: State) -> float:
    """L2 norm of the residual over all series."""
    squares = F.aggregate(state.residual(), F.lit(0.0), lambda s, x: s + x * x)
    return float(np.sqrt(state.df.agg(F.sum(squares)).first()[0] or 0.0))


def step_report(states: list[State], norms: bool = False) -> list[dict]:
    """A row for each step of run_sequence's states: token, space, what it has added, removed and changed, and the bundle's widths.

    norms: the L2 norm of the residual before and after too, which takes a job for each state.
    """
    out = []
    sizes = [residual_norm(s) if norms else None for s in states]
    for i, (before, now) in enumerate(zip(states, states[1:], strict=False)):
        widths = {s.name: s.size for s in now.bundle()}
        row = {"step": i + 1, "token": now.sequence[-1], "space": "/".join(now.space), **difference(before, now), "bundle": widths, "bundle_width": sum(widths.values())}
        out.append(row | {"predictions": len(now.predictions), "norm_before": sizes[i], "norm_after": sizes[i + 1]})
    return out

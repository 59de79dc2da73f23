"""Enumerating pipelines, sweeping them over panels, scoring, and the analytics of sweep results."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grammar import DETECTORS, STOP, TOKENS, Grammar
from .state import State

# structural enumeration

FILLS, SCALES, LEVEL_MODELS = ("LinearFill", "ForwardFill", "FlairPreprocess"), ("ZNormalization", "MeanAbsScaling"), ("FlairRidgeLevel", "gb_level_forecast")
#: Tokens that an enumeration leaves out: they are no part of the five core registries, or no step of their own.
LEFT_OUT = ("affine_fold", "affine_forecast", "window_kernel", "last_value", "zero", "FlairSamplePaths", "SeasonalFeatures", "step_regression")


def token_table(spark: SparkSession) -> DataFrame:
    """Per token its phase, place in the canonical order, exclusive group, and what it needs and gives."""
    rows = []
    for at, (name, kind) in enumerate((n, t.kind) for n, t in TOKENS.items() if n not in LEFT_OUT):
        phase = {"cleaning": 0, "transform": 1, "feature": 2, "model": 3}[kind]
        at += 100 * (name == "FourierFeatures")  # after the tokens that need a period
        group = "fill" if name in FILLS else "scale" if name in SCALES else "detect" if name in DETECTORS else name
        feature = name in FILLS or name in SCALES or name in ("FourierFeatures", "PeriodPhaseOneHot", "SeasonalFold")
        rows.append((name, phase, at, group, feature, name in DETECTORS, name == "SeasonalFold", name in SCALES, name in ("PeriodPhaseOneHot", "SeasonalFold", "SeasonalFeatures"), name in (*LEVEL_MODELS, "level_shape_ridge"), name in LEVEL_MODELS))
    return spark.createDataFrame(rows, "name string, phase int, canon int, grp string, gives boolean, detects boolean, folds boolean, scales boolean, needs_period boolean, needs_fold boolean, unscaled boolean")


def enumerate_sequences(tokens: DataFrame, most: int = 3) -> DataFrame:
    """(length, sequence): every chain in canonical order that ends in its one model and whose needs are met."""
    start = tokens.sparkSession.createDataFrame([("", -1, -1, [], False, False, False, False, 0)], "seq string, phase int, canon int, groups array<string>, has_feature boolean, has_period boolean, has_fold boolean, scaled boolean, n int")
    ends, level = None, start
    for _ in range(most):
        t = tokens.alias("t")
        fits = ((F.col("t.phase") > F.col("l.phase")) | ((F.col("t.phase") == F.col("l.phase")) & (F.col("t.canon") > F.col("l.canon")))) & ~F.array_contains("groups", F.col("t.grp"))
        needs = (~F.col("needs_period") | F.col("has_period")) & (~F.col("needs_fold") | F.col("has_fold")) & ~(F.col("unscaled") & F.col("scaled")) & ((F.col("t.phase") < 3) | F.col("has_feature"))
        grown = level.alias("l").join(F.broadcast(t), fits & needs).select(
            F.when(F.col("seq") == "", F.col("name")).otherwise(F.concat_ws(" -> ", "seq", "name")).alias("seq"), F.col("t.phase").alias("phase"), F.col("t.canon").alias("canon"), F.concat("groups", F.array("grp")).alias("groups"),
            (F.col("has_feature") | F.col("gives")).alias("has_feature"), (F.col("has_period") | F.col("detects")).alias("has_period"), (F.col("has_fold") | F.col("folds")).alias("has_fold"), (F.col("scaled") | F.col("scales")).alias("scaled"), (F.col("n") + 1).alias("n"),
        )
        done = grown.where("phase = 3").select(F.col("n").alias("length"), F.col("seq").alias("sequence"))
        ends = done if ends is None else ends.union(done)
        level = grown.where("phase < 3")
    return ends


def boxed(sequence: Column) -> Column:
    """`a -> b` as `[ a ] -> [ b ]`."""
    return F.concat_ws(" -> ", F.transform(F.split(sequence, " -> "), lambda t: F.concat(F.lit("[ "), t, F.lit(" ]"))))


# scoring


def naive_scale(history: Column, season: int) -> Column:
    """Mean absolute difference at a lag of one season; null where no pair is known."""
    pairs = F.transform(F.slice(history, season + 1, 1 << 30), lambda y, t: F.abs(y - F.get(history, t)))
    known = F.filter(pairs, lambda d: d.isNotNull() & ~F.isnan(d))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, d: s + d) / F.size(known))


def score(state: State, season: int = 1) -> DataFrame:
    """One row: mae, rmse, max_abs_error over all cells, and mase over the series whose naive error isn't nothing."""
    errors = F.zip_with(state.decoded(), "original_future", lambda p, y: p - y)
    each = state.df.select(errors.alias("e"), naive_scale(F.col("original_history"), season).alias("scale"))
    each = each.select("scale", F.size("e").alias("n"), F.aggregate("e", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("a"), F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x).alias("q"), F.array_max(F.transform("e", lambda x: F.abs(x))).alias("m"))
    return each.agg((F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), F.max("m").alias("max_abs_error"), F.avg(F.when(F.col("scale") > 1e-12, F.col("a") / F.col("n") / F.col("scale"))).alias("mase"))


def signature(forecasts: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """One hash of all rounded forecasts (ord, h, yhat) for each of by, whatever the order of rows."""
    cell = F.xxhash64("ord", "h", F.round("yhat", digits) + F.lit(0.0))
    return forecasts.groupBy(*by).agg(F.bit_xor(cell).alias("x"), F.bit_xor(F.xxhash64(cell)).alias("y"), F.count(F.lit(1)).alias("n"))


def dedupe(forecasts: DataFrame, order: str = "pos", digits: int = 6) -> DataFrame:
    """(dataset, sequence, pos) of the first pipeline of each distinct forecast, by dataset."""
    marks = signature(forecasts, ["dataset", "sequence", order], digits)
    first = Window.partitionBy("dataset", "x", "y", "n").orderBy(order)
    return marks.withColumn("k", F.row_number().over(first)).where("k = 1").select("dataset", "sequence", order)


@dataclass(frozen=True)
class Chain:
    """A planned pipeline that ends in a model, or one whose token failed (status)."""

    dataset: str
    pos: int
    sequence: tuple[str, ...]
    state: State | None
    status: str = "ok"


def plan_chains(state: State, grammar: Grammar, dataset: str = "panel", most: int = 5, most_models: int = 1, held_out: tuple[str, ...] = (), until: float = math.inf) -> list[Chain]:
    """Every chain that the grammar allows and that ends in a model, depth first; states are lazy plans, and prefixes are shared."""
    out: list[Chain] = []

    def visit(now: State) -> None:
        for name in grammar.valid_actions(now):
            if name == STOP or name in held_out or time.time() > until or len(now.sequence) >= most:
                continue
            token = grammar.tokens[name]
            if token.kind == "model" and len(now.predictions) >= most_models:
                continue
            try:
                after = token.run(now)
            except Exception as e:  # noqa: BLE001  recorded as the pipeline's status
                out.append(Chain(dataset, len(out), (*now.sequence, name), None, type(e).__name__))
                continue
            if token.kind == "model":
                out.append(Chain(dataset, len(out), after.sequence, after))
            visit(after)

    visit(state)
    return out


def _cells(chain: Chain, season: int) -> DataFrame:
    """A row for each series: sums of errors, and a hash of its rounded forecast."""
    s = chain.state
    rows = s.df.select("ord", s.decoded().alias("p"), "original_future", naive_scale(F.col("original_history"), season).alias("scale"))
    errors = F.zip_with("p", "original_future", lambda p, y: p - y)
    marks = F.transform("p", lambda p, h: F.xxhash64(F.col("ord"), h, F.round(p, 6) + F.lit(0.0)))
    rows = rows.select(errors.alias("e"), "scale", F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias("x"), F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.xxhash64(x))).alias("y"))
    each = rows.select("scale", "x", "y", F.size("e").alias("n"), F.aggregate("e", F.lit(0.0), lambda s, x: s + F.abs(x)).alias("a"), F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    return each.select(F.lit(chain.dataset).alias("dataset"), F.lit(chain.pos).alias("pos"), F.lit(len(chain.sequence)).alias("length"), F.lit(" -> ".join(chain.sequence)).alias("sequence"), "*")


def _scored(chains: list[Chain], season: int) -> list[dict]:
    """One job over (dataset, pipeline, series) for all chains; if it fails, one for each, whose failure is its status."""
    by = ["dataset", "pos", "length", "sequence"]
    began = time.time()
    try:
        rows = reduce(DataFrame.union, [_cells(c, season) for c in chains]).groupBy(*by).agg(
            (F.sum("a") / F.sum("n")).alias("mae"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), F.avg(F.when(F.col("scale") > 1e-12, F.col("a") / F.col("n") / F.col("scale"))).alias("mase"),
            F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("series"),
        ).collect()  # fmt: skip  a row for each chain
    except Exception as e:  # noqa: BLE001
        if len(chains) > 1:
            return [r for c in chains for r in _scored([c], season)]
        c = chains[0]
        return [{"dataset": c.dataset, "pos": c.pos, "length": len(c.sequence), "sequence": " -> ".join(c.sequence), "status": type(e).__name__, "seconds": time.time() - began}]
    return [r.asDict() | {"status": "ok", "seconds": (time.time() - began) / len(chains)} for r in rows]


def sweep(panels: dict[str, State] | State, grammar: Grammar, most: int = 5, most_models: int = 1, held_out: tuple[str, ...] = (), seconds: float = 1200.0, season: int = 1, at_once: int = 24) -> list[dict]:
    """Scores every chain that the grammar allows on every dataset's panel, at_once chains to a job.

    Errors are rows too. Of a dataset's chains with equal forecasts to six digits the first counts. seconds is each
    dataset's budget: chains that it doesn't reach have no row.
    """
    out: list[dict] = []
    for dataset, state in (panels.items() if isinstance(panels, dict) else [("panel", panels)]):
        until, seen = time.time() + seconds, set()
        chains = plan_chains(state, grammar, dataset, most, most_models, held_out, until)
        found = [{"dataset": c.dataset, "pos": c.pos, "length": len(c.sequence), "sequence": " -> ".join(c.sequence), "status": c.status, "seconds": 0.0} for c in chains if c.state is None]
        planned = [c for c in chains if c.state is not None]
        for i in range(0, len(planned), at_once):
            if time.time() > until:
                break
            found += _scored(planned[i : i + at_once], season)
        for r in sorted(found, key=lambda r: r["pos"]):
            mark = (r["x"], r["y"], r["series"]) if r["status"] == "ok" else None
            if mark is None or mark not in seen:
                seen.add(mark)
                out.append({k: r.get(k) for k in ("dataset", "length", "mase", "rmse", "mae", "seconds", "status", "sequence")})
    return out


RESULT = "dataset string, length int, mase double, rmse double, mae double, seconds double, status string, sequence string"


def results_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


# analytics of (dataset, sequence, length, mase, status)


def tokens_of(sequence: Column) -> Column:
    return F.transform(F.split(sequence, "->"), lambda t: F.trim(t))


def filtered(results: DataFrame, lengths: list[int] | None = None, contains: str = "", required: list[str] | None = None, blocked: list[str] | None = None, datasets: list[str] | None = None) -> DataFrame:
    """Rows of status ok that meet all conditions."""
    out, tokens = results.where("status = 'ok'"), tokens_of(F.col("sequence"))
    if lengths:
        out = out.where(F.col("length").isin(lengths))
    if contains:
        out = out.where(F.lower("sequence").contains(contains.lower()))
    for t in required or ():
        out = out.where(F.array_contains(tokens, t))
    for t in blocked or ():
        out = out.where(~F.array_contains(tokens, t))
    return out.where(F.col("dataset").isin(datasets)) if datasets else out


def ranked(results: DataFrame, top: int | None = None) -> DataFrame:
    """Results with their rank by mase; a sweep has a row for each dataset and pipeline, which one task can order. top: only so many, by a distributed top-k."""
    by = [F.col("mase").asc_nulls_last(), "dataset", "sequence"]
    rows = results if top is None else results.orderBy(*by).limit(top)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def pivot(results: DataFrame, datasets: list[str]) -> DataFrame:
    """A row for each sequence, a column of mase for each dataset."""
    return results.groupBy("sequence").pivot("dataset", datasets).agg(F.max("mase"))


def coverage(results: DataFrame) -> DataFrame:
    return results.groupBy("sequence").agg(F.avg("mase").alias("mean_mase"), F.count("mase").alias("coverage"))


def collapse(results: DataFrame) -> DataFrame:
    """Of sequences with the same mase on every dataset to six digits, the one of fewest tokens, shortest, first by name."""
    cell = F.concat(F.col("dataset"), F.lit("="), F.coalesce(F.format_string("%.6f", F.round("mase", 6)), F.lit("NA")))
    marks = results.groupBy("sequence").agg(F.concat_ws("|", F.array_sort(F.collect_list(cell))).alias("mark"))
    order = Window.partitionBy("mark").orderBy(F.size(tokens_of(F.col("sequence"))), F.length("sequence"), "sequence")
    return marks.withColumn("k", F.row_number().over(order)).where("k = 1").select("sequence")


def wins(results: DataFrame) -> DataFrame:
    """How many datasets each sequence is best on, within 1e-9."""
    best = results.groupBy("dataset").agg(F.min("mase").alias("best"))
    return results.join(best, "dataset").groupBy("sequence").agg(F.sum(F.when(F.col("mase") <= F.col("best") + F.lit(1e-9), 1).otherwise(0)).cast("long").alias("wins"))


def board(results: DataFrame, by: str = "mean", top: int = 80) -> DataFrame:
    """The explorer's rows: collapsed, with mean, coverage and wins, in the order asked for, to a limit."""
    own = results.join(collapse(results), "sequence", "left_semi")
    rows = coverage(own).join(wins(own), "sequence")
    mean = F.coalesce("mean_mase", F.lit(9e9))
    keys = {"mean": [mean], "coverage": [F.col("coverage").desc(), mean], "wins": [F.col("wins").desc(), mean]}[by]
    return rows.orderBy(*keys, "sequence").limit(top)


def colours(results: DataFrame) -> DataFrame:
    """Hue of each cell, 140 (least mase of its dataset) to 0."""
    w = Window.partitionBy("dataset")
    lo, hi = F.min("mase").over(w), F.max("mase").over(w)
    share = F.when(hi > lo, (F.col("mase") - lo) / (hi - lo)).otherwise(0.0)
    return results.select("dataset", "sequence", (F.lit(140.0) * (F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))).alias("hue"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Per token: rows, and mean, median and best mase of those that have one."""
    each = results.withColumn("token", F.explode(tokens_of(F.col("sequence"))))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.avg("mase").alias("mean_mase"), F.median("mase").alias("median_mase"), F.min("mase").alias("best_mase"))


def cards(results: DataFrame) -> DataFrame:
    return results.agg(F.countDistinct("sequence").alias("pipelines"), F.countDistinct("dataset").alias("datasets"), F.min("mase").alias("best_mase"))


def champion(results: DataFrame) -> DataFrame:
    return results.where("mase is not null").orderBy("mase", "dataset", "sequence").limit(1).select("dataset", "sequence", "mase")

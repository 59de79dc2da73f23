"""The engine's queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kernels as K
from .operators import models as M
from .operators import prepare as P
from .plans import grammar as G
from .plans import sweep as S
from .plans.language import apply_pipeline, run_sequence
from .plans.state import State, kernel, start
from .sources import panel as B
from .sources import sinks

T, H = 672, 48
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# SQL that queries share

LONG = """
WITH RECURSIVE sums AS (SELECT event_type AS series_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts)::INTEGER AS t, round(sum(value), 6) AS y FROM events GROUP BY 1, 2),
ids AS (SELECT series_id, (row_number() OVER (ORDER BY series_id) - 1)::INTEGER AS ord FROM (SELECT DISTINCT series_id FROM sums WHERE t BETWEEN 0 AND 719)),
cells AS (SELECT i.series_id, i.ord, r.t, s.y FROM ids i CROSS JOIN (SELECT unnest(range(720))::INTEGER AS t) r LEFT JOIN sums s ON s.series_id = i.series_id AND s.t = r.t),
near AS (SELECT *, t < 672 AS past, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NULL THEN NULL ELSE t END IGNORE NULLS) OVER b AS t0,
    first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NULL THEN NULL ELSE t END IGNORE NULLS) OVER a AS t1 FROM cells
  WINDOW b AS (PARTITION BY series_id, t < 672 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id, t < 672 ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
line AS (SELECT series_id, ord, t, past, y AS raw, coalesce(y, CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (t - t0)::DOUBLE / (t1 - t0)::DOUBLE END, 0e0) AS y, coalesce(y0, y1, 0e0) AS carried FROM near),
hist AS (SELECT series_id, ord, t, raw, y, carried FROM line WHERE past),
fut AS (SELECT series_id, ord, t - 672 AS h, y FROM line WHERE NOT past),
stats AS (SELECT series_id, avg(y) AS mu, stddev_pop(y) + 1e-8 AS sigma, avg(abs(y)) + 1e-8 AS scale FROM hist GROUP BY series_id)"""
RESULTS = LONG + """,
ends AS (SELECT h.series_id, h.y AS line_end, h.carried AS carried_end, s.mu, s.sigma FROM hist h JOIN stats s USING (series_id) WHERE t = 671),
guess AS (SELECT series_id, 'LinearFill -> last_value' AS sequence, line_end AS c FROM ends UNION ALL SELECT series_id, 'ForwardFill -> last_value', carried_end FROM ends
  UNION ALL SELECT series_id, 'LinearFill -> zero', 0e0 FROM ends UNION ALL SELECT series_id, 'LinearFill -> ZNormalization -> last_value', line_end * sigma + mu FROM ends
  UNION ALL SELECT series_id, 'LinearFill -> ZNormalization -> zero', mu FROM ends),
naive AS (SELECT series_id, avg(abs(d)) AS scale FROM (SELECT series_id, raw - lag(raw) OVER (PARTITION BY series_id ORDER BY t) AS d FROM hist) GROUP BY series_id),
results AS (SELECT g.series_id AS dataset, g.sequence, len(string_split(g.sequence, '->'))::INTEGER AS length, 'ok' AS status, round(avg(abs(f.y - g.c)) / any_value(n.scale), 6) AS mase
  FROM guess g JOIN fut f USING (series_id) JOIN naive n USING (series_id) GROUP BY g.series_id, g.sequence)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# what queries share


def hourly(spark: SparkSession, sf_dir: str) -> State:
    return start(B.events_hourly(spark, sf_dir, T, H), T, H)


def daily(spark: SparkSession, sf_dir: str) -> State:
    return start(B.users_daily(spark, sf_dir, 24, 6), 24, 6)


def after(state: State, *tokens: object) -> State:
    for t in tokens:
        state = t.run(state)
    return state


def long(state: State, column: str, at: str = "t", value: str = "y", digits: int = 6) -> DataFrame:
    return state.df.select("series_id", F.posexplode(column).alias(at, value)).withColumn(value, F.round(value, digits))


def forecasts(state: State, digits: int = 6) -> DataFrame:
    return long(State(state.df.withColumn("f__", state.decoded()), state.length, state.horizon), "f__", "h", "yhat", digits)


def folded(state: State, periods: list[int]) -> State:
    """A state with given periods, as a detector would leave it."""
    return state.put_param("periods", periods, "given").note(period=periods[0])


GRAMMAR = G.build_grammar(affine=True, window_kernel=True, baselines=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(apply_pipeline("LinearFill -> ZNormalization -> last_value -> STOP", GRAMMAR, hourly(spark, sf_dir)))


query("pipeline_z_last_value", LONG + " SELECT h.series_id, f.h, round(h.y * s.sigma + s.mu, 6) AS yhat FROM hist h JOIN stats s USING (series_id) JOIN fut f USING (series_id) WHERE h.t = 671")(flagship)

# sources


@query("panel_events_hourly", LONG + " SELECT series_id, ord, t, raw AS y FROM hist UNION ALL SELECT series_id, ord, h + 672, round(y, 6) FROM fut")
def panel_events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events_hourly(spark, sf_dir, T, H).select("series_id", "ord", F.posexplode(F.concat("history", "future")).alias("t", "y")).withColumn("y", F.round("y", 6))


@query("panel_mode_length", """WITH d AS (SELECT user_id AS series_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS t FROM events), n AS (SELECT series_id, count(DISTINCT t)::INTEGER AS n_history FROM d WHERE t BETWEEN 0 AND 23 GROUP BY 1),
m AS (SELECT n_history FROM n GROUP BY 1 HAVING count(*) >= 2 ORDER BY count(*) DESC, n_history DESC LIMIT 1) SELECT series_id, n_history FROM n WHERE n_history IN (SELECT n_history FROM m)""")  # fmt: skip
def panel_mode_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = F.filter("history", lambda y: y.isNotNull())
    records = B.users_daily(spark, sf_dir, 24, 6).withColumn("history", observed)
    return B.mode_lengths(records).select("series_id", F.size("history").alias("n_history"))


@query("sliding_windows", LONG + """ SELECT series_id, w.s AS window_start, w.s + 192 AS window_end, round(sum(CASE WHEN t < w.s + 168 THEN y ELSE 0 END), 4) AS past, round(sum(CASE WHEN t >= w.s + 168 THEN y ELSE 0 END), 4) AS ahead
FROM hist JOIN (SELECT unnest(range(0, 481, 60))::INTEGER AS s) w ON hist.t BETWEEN w.s AND w.s + 191 GROUP BY series_id, w.s""")  # fmt: skip
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = after(hourly(spark, sf_dir), P.LinearFill()).df.select("series_id", F.col("raw_history").alias("y"))
    w = B.sliding_windows(series, 168, 24, 60)
    return w.select("series_id", "window_start", "window_end", F.round(P.total(F.col("history")), 4).alias("past"), F.round(P.total(F.col("future")), 4).alias("ahead"))


@query("record_series", LONG + " SELECT series_id, ord, t, round(y, 6) AS y FROM line")
def record_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = after(hourly(spark, sf_dir), P.LinearFill()).df.select("series_id", "ord", F.col("raw_history").alias("history"), F.col("original_future").alias("future"))
    return B.record_series(B.of_lengths(records, T, H)).select("series_id", "ord", F.posexplode("y").alias("t", "y")).withColumn("y", F.round("y", 6))


@query("manifest_filter", "SELECT n_nationkey, n_name AS tag FROM nation WHERE contains(lower(n_name), 'on_1')")
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.manifest(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("tag")), "ON_1")


@query("synthetic_panel", """SELECT format('s{:05d}', k) AS series_id, k::INTEGER AS ord, t::INTEGER AS t, round(8e0 + 5e-1 * k + 2e0 * sin(2e0 * pi() * t / 24e0), 6) AS y
FROM (SELECT unnest(range(5)) AS k) CROSS JOIN (SELECT unnest(range(96)) AS t)""")  # fmt: skip
def synthetic_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.synthetic(spark).select("series_id", "ord", F.posexplode(F.concat("history", "future")).alias("t", "y")).withColumn("y", F.round("y", 6))


@query("ranked_records", """SELECT ref, trim(regexp_replace(lower(ref), '[^a-z0-9]+', '-', 'g'), '-') AS slug, string_agg(DISTINCT source, ' ' ORDER BY source) AS queries, count(*) AS votes,
(CASE WHEN contains(lower(ref), 'en') THEN 1 ELSE 0 END + CASE WHEN contains(lower(ref), '_1') THEN 1 ELSE 0 END)::INTEGER AS relevance FROM (SELECT lang || '__' || (n_chars // 1000)::VARCHAR AS ref, source FROM documents)
GROUP BY ref HAVING contains(lower(ref), 'en') OR contains(lower(ref), '_1') ORDER BY relevance DESC, votes DESC, ref LIMIT 10""")  # fmt: skip
def ranked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select(F.concat_ws("__", "lang", F.floor(F.col("n_chars") / 1000).cast("string")).alias("ref"), F.col("source").alias("query"))
    return sinks.rank_records(found, ["EN", "_1"], 1, 10)


# cleaning and scaling


@query("linear_fill", LONG + " SELECT series_id, t, round(y, 6) AS y FROM hist")
def linear_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(after(hourly(spark, sf_dir), P.LinearFill()), "raw_history")


@query("forward_fill", LONG + " SELECT series_id, t, round(carried, 6) AS y FROM hist")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(after(hourly(spark, sf_dir), P.ForwardFill()), "raw_history")


@query("z_normalize", LONG + " SELECT series_id, t, round((y - mu) / sigma, 6) AS y FROM hist JOIN stats USING (series_id)")
def z_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(after(hourly(spark, sf_dir), P.LinearFill(), P.ZNormalization()), "scaled_history")


@query("mean_abs_scale", LONG + " SELECT series_id, t, round(y / scale, 6) AS y FROM hist JOIN stats USING (series_id)")
def mean_abs_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(after(hourly(spark, sf_dir), P.FlairPreprocess(), P.MeanAbsScaling()), "scaled_history")


@query("decode_roundtrip", LONG + " SELECT series_id, h, round(y, 6) AS y FROM fut")
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(hourly(spark, sf_dir), P.LinearFill(), P.ZNormalization())
    exact = s.push(s.df.withColumn("new__", F.col("target_base")), "new__", "target")
    return forecasts(exact).withColumnRenamed("yhat", "y")


@query("residual_stack_two_models", LONG + " SELECT f.series_id, f.h, round(f.y - h.y, 6) AS y FROM fut f JOIN hist h USING (series_id) WHERE h.t = 671")
def residual_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = run_sequence(["LinearFill", "last_value", "zero"], GRAMMAR, hourly(spark, sf_dir))[-1]
    return long(State(s.df.withColumn("r__", s.residual()), T, H), "r__", "h")


# features

_DFT = LONG + """, waves AS (SELECT series_id, k, sum(z * cos(2e0 * pi() * k * t / 672e0)) AS c, sum(z * sin(2e0 * pi() * k * t / 672e0)) AS s
  FROM (SELECT h.series_id, t, h.y - mu AS z FROM hist h JOIN stats USING (series_id)) CROSS JOIN (SELECT unnest(range(1, 337)) AS k) GROUP BY 1, 2),
power AS (SELECT series_id, sum(c * c + s * s) AS total FROM waves GROUP BY 1)"""


@query("fourier_features", _DFT + """ SELECT series_id, k::INTEGER AS k, round(c / 672e0, 6) AS re, round(-s / 672e0, 6) AS im, round(2e0 * sqrt(c * c + s * s) / 672e0, 6) AS amplitude, round((c * c + s * s) / (total + 1e-8), 6) AS share
FROM waves JOIN power USING (series_id) WHERE k <= 16""")  # fmt: skip
def fourier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(hourly(spark, sf_dir), P.LinearFill(), P.FourierFeatures(16))
    at = lambda b: F.round(F.get("fourier_features", F.col("k") - 1 + 16 * b), 6)
    return s.df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(16)))).select("series_id", "k", at(0).alias("re"), at(1).alias("im"), at(2).alias("amplitude"), at(3).alias("share"))


@query("period_power", _DFT + """ SELECT p::INTEGER AS p, round(avg(share), 6) AS score FROM (SELECT p, w.series_id, sum(c * c + s * s) / any_value(total) AS share
FROM waves w JOIN power USING (series_id) JOIN (SELECT unnest([6, 8, 12, 24, 72, 168]) AS p) ON abs(k - 672 // p) <= 1 GROUP BY 1, 2) GROUP BY p""")  # fmt: skip
def period_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(hourly(spark, sf_dir), P.LinearFill())
    candidates = K.candidate_periods("H", T)
    df = kernel(s.df, lambda x: ([K.spectral_share(x, p) for p in candidates],), ["raw_history"], {"scores": "array<double>"})
    each = df.where("ord < 8").select(F.explode(F.arrays_zip(F.array(*map(F.lit, candidates)).alias("p"), F.col("scores").alias("s"))).alias("r"))
    return each.groupBy(F.col("r.p").alias("p")).agg(F.round(F.avg("r.s"), 6).alias("score"))


@query("period_detect_bic")
def period_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(hourly(spark, sf_dir), P.LinearFill(), P.PeriodDetectBIC())
    return spark.createDataFrame([(p, float(b), p == s.metadata["period"]) for p, b in s.metadata["period_scores"].items()], "p int, bic double, chosen boolean")


@query("period_chain", """SELECT c::INTEGER AS p FROM (SELECT unnest([6, 8, 12, 24, 72, 168, 336, 720]) AS c) WHERE c > 1 AND 672 // c >= 3 AND (c = 24 OR (c > 24 AND c % 24 = 0 AND (672 // 24) // (c // 24) >= 2))""")
def period_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in K.period_chain(24, "H", T)], "p int")


@query("phase_ids", "SELECT t::INTEGER AS t, ((((t - 672 % 168) % 168) + 168) % 168)::INTEGER AS phase, t >= 672 AS ahead FROM (SELECT unnest(range(720)) AS t)")
def phase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    past, ahead = P.phase_ids(T, H, 168)
    return spark.range(1).select(F.posexplode(F.concat(past, ahead)).alias("t", "phase")).withColumn("ahead", F.col("t") >= T)


@query("phase_onehot", "SELECT h::INTEGER AS h, k::INTEGER AS k, CASE WHEN h % 24 = k THEN 1e0 ELSE 0e0 END AS v FROM (SELECT unnest(range(48)) AS h) CROSS JOIN (SELECT unnest(range(24)) AS k)")
def phase_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.range(1).select(F.posexplode(P.one_hot(P.phase_ids(T, H, 24)[1], 24)).alias("i", "v"))
    return flat.select(F.floor(F.col("i") / 24).cast("int").alias("h"), (F.col("i") % 24).alias("k"), "v")


@query("seasonal_channels", """SELECT t::INTEGER AS t, (4 * i + 2 * (n - 1) + w)::INTEGER AS channel, round(CASE WHEN w = 0 THEN sin(2e0 * pi() * n * t / p) ELSE cos(2e0 * pi() * n * t / p) END, 6) + 0e0 AS v
FROM (SELECT unnest(range(672, 720)) AS t) CROSS JOIN (SELECT unnest([0, 1]) AS i, unnest([24e0, 168e0]) AS p) CROSS JOIN (SELECT unnest([1, 2]) AS n) CROSS JOIN (SELECT unnest([0, 1]) AS w)""")  # fmt: skip
def seasonal_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = spark.range(1).select(F.posexplode(P.channels(T, H, [24, 168], 2)).alias("i", "v"))
    return flat.select((F.floor(F.col("i") / 8) + T).cast("int").alias("t"), (F.col("i") % 8).alias("channel"), F.round("v", 6).alias("v"))


@query("seasonal_projection", LONG + """ SELECT series_id, p::INTEGER AS p, n::INTEGER AS harmonic, round(sqrt(a * a + b * b), 6) AS amplitude FROM (SELECT series_id, p, n, 2e0 / 672e0 * sum((y - mu) * cos(2e0 * pi() * n * t / p)) AS a, 2e0 / 672e0 * sum((y - mu) * sin(2e0 * pi() * n * t / p)) AS b
FROM hist JOIN stats USING (series_id) CROSS JOIN (SELECT unnest([24, 168]) AS p) CROSS JOIN (SELECT unnest([1, 2]) AS n) GROUP BY 1, 2, 3)""")  # fmt: skip
def seasonal_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(folded(after(hourly(spark, sf_dir), P.LinearFill()), [24, 168]), P.SeasonalFeatures(2))
    rows = [F.struct(F.lit(p).alias("p"), F.lit(n).alias("harmonic"), F.get("seasonal_projection", F.lit(3 * (2 * i + n - 1) + 2)).alias("a")) for i, p in enumerate((24, 168)) for n in (1, 2)]
    return s.df.select("series_id", F.explode(F.array(*rows)).alias("r")).select("series_id", "r.p", "r.harmonic", F.round("r.a", 6).alias("amplitude"))


_FOLD = LONG + ", folded AS (SELECT series_id, (t // 24)::INTEGER AS cycle, (t % 24)::INTEGER AS phase, y FROM hist), levels AS (SELECT series_id, cycle, sum(y) AS level FROM folded GROUP BY 1, 2)"


def _seasonal(spark: SparkSession, sf_dir: str, *more: object) -> State:
    return after(folded(after(hourly(spark, sf_dir), P.LinearFill()), [24, 168]), P.SeasonalFold(2), *more)


@query("seasonal_fold_level", _FOLD + " SELECT series_id, cycle, round(level, 6) AS level FROM levels")
def seasonal_fold_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(_seasonal(spark, sf_dir), "level_series", "cycle", "level")


@query("seasonal_fold_shape", _FOLD + """, shares AS (SELECT series_id, phase, greatest(avg(CASE WHEN level > 1e-8 THEN y / level ELSE 1e0 / 24e0 END), 1e-8) AS s FROM folded JOIN levels USING (series_id, cycle) WHERE cycle >= 26 GROUP BY 1, 2)
SELECT series_id, phase, round(s / sum(s) OVER (PARTITION BY series_id), 6) AS shape FROM shares""")  # fmt: skip
def seasonal_fold_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(_seasonal(spark, sf_dir), "shape_vector", "phase", "shape")


@query("seasonal_fold_shape2", _FOLD + """, means AS (SELECT series_id, (cycle % 7)::INTEGER AS pos, avg(level) AS m FROM levels GROUP BY 1, 2),
ratios AS (SELECT series_id, pos, m / avg(m) OVER (PARTITION BY series_id) AS r, avg(m) OVER (PARTITION BY series_id) AS grand FROM means),
waves AS (SELECT series_id, 2e0 / 7e0 * sum(r * cos(2e0 * pi() * pos / 7e0)) AS a, 2e0 / 7e0 * sum(r * sin(2e0 * pi() * pos / 7e0)) AS b FROM ratios GROUP BY 1),
both_ AS (SELECT *, 1e0 + a * cos(2e0 * pi() * pos / 7e0) + b * sin(2e0 * pi() * pos / 7e0) AS w FROM ratios JOIN waves USING (series_id)),
bics AS (SELECT series_id, 7e0 * ln(greatest(sum((r - w) * (r - w)) / 7e0, 1e-12)) + 2e0 * ln(7e0) < 7e0 * ln(greatest(sum((r - 1e0) * (r - 1e0)) / 7e0, 1e-12)) AS wavy FROM both_ GROUP BY 1),
mixed AS (SELECT series_id, pos, greatest(4e0 / 11e0 * r + 7e0 / 11e0 * CASE WHEN wavy THEN w ELSE 1e0 END, 1e-8) AS s FROM both_ JOIN bics USING (series_id) WHERE grand >= 1e-8)
SELECT series_id, pos, round(s / avg(s) OVER (PARTITION BY series_id), 6) AS shape2 FROM mixed""")  # fmt: skip
def seasonal_fold_shape2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seasonal(spark, sf_dir)
    df = kernel(s.df, lambda v: (K.second_shape(v, 7),), ["level_series"], {"shape2": "array<double>"}).where("shape2 is not null")
    return long(State(df, T, H), "shape2", "pos", "shape2")


@query("seasonal_fold_twice", _FOLD + """, means AS (SELECT series_id, (cycle % 5)::INTEGER AS pos, avg(level) AS m FROM levels GROUP BY 1, 2),
ratios AS (SELECT series_id, pos, m / avg(m) OVER (PARTITION BY series_id) AS r, avg(m) OVER (PARTITION BY series_id) AS grand FROM means),
waves AS (SELECT series_id, 2e0 / 5e0 * sum(r * cos(2e0 * pi() * pos / 5e0)) AS a, 2e0 / 5e0 * sum(r * sin(2e0 * pi() * pos / 5e0)) AS b FROM ratios GROUP BY 1),
both_ AS (SELECT *, 1e0 + a * cos(2e0 * pi() * pos / 5e0) + b * sin(2e0 * pi() * pos / 5e0) AS w FROM ratios JOIN waves USING (series_id)),
bics AS (SELECT series_id, 5e0 * ln(greatest(sum((r - w) * (r - w)) / 5e0, 1e-12)) + 2e0 * ln(5e0) < 5e0 * ln(greatest(sum((r - 1e0) * (r - 1e0)) / 5e0, 1e-12)) AS wavy FROM both_ GROUP BY 1),
mixed AS (SELECT series_id, pos, greatest(0.5e0 * r + 0.5e0 * CASE WHEN wavy THEN w ELSE 1e0 END, 1e-8) AS s FROM both_ JOIN bics USING (series_id) WHERE grand >= 1e-8),
shape2 AS (SELECT series_id, pos, s / avg(s) OVER (PARTITION BY series_id) AS s FROM mixed)
SELECT l.series_id, 'level' AS part, l.cycle AS i, round(l.level / coalesce(s.s, 1e0), 4) AS v FROM levels l LEFT JOIN shape2 s ON s.series_id = l.series_id AND s.pos = l.cycle % 5
UNION ALL SELECT i.series_id, 'ahead', j.j, round(coalesce(s.s, 1e0), 4) FROM ids i CROSS JOIN (SELECT unnest(range(2))::INTEGER AS j) j LEFT JOIN shape2 s ON s.series_id = i.series_id AND s.pos = (28 + j.j) % 5""")  # fmt: skip
def seasonal_fold_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 cycles by a coarser period of 5, which leaves a remainder of 3."""
    token = P.SeasonalFold(secondary_min_strength=0.0)
    s = after(folded(after(hourly(spark, sf_dir), P.LinearFill()), [24, 120]), token, token)
    parts = [long(s, column, "i", "v", 4).select("series_id", F.lit(n).alias("part"), "i", "v") for n, column in (("level", "flair_level_work"), ("ahead", "flair_level_future_shape2"))]
    return reduce(DataFrame.union, parts)


@query("level_shrink")
def level_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = after(hourly(spark, sf_dir), P.LinearFill())
    return kernel(s.df, lambda x: (K.level_shrink(K.fold(x, 24)),), ["raw_history"], {"factor": "double"}).select("series_id", "factor")


_AFFINE = _FOLD + ", parts AS (SELECT series_id, cycle, avg(y) AS shift, greatest(stddev_pop(y), 1e-8) AS scale FROM folded GROUP BY 1, 2)"


@query("affine_fold", _AFFINE + """, recent AS (SELECT series_id, phase, avg((y - shift) / scale) AS s FROM folded JOIN parts USING (series_id, cycle) WHERE cycle >= 26 GROUP BY 1, 2),
shapes AS (SELECT series_id, phase, (s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-8) AS s FROM recent WINDOW w AS (PARTITION BY series_id))
SELECT series_id, 'shape' AS part, phase AS i, round(s + 1e-8, 6) AS v FROM shapes UNION ALL SELECT series_id, 'shift', cycle, round(shift + 1e-8, 6) FROM parts UNION ALL SELECT series_id, 'scale', cycle, round(scale + 1e-8, 6) FROM parts""")  # fmt: skip
def affine_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 24 values of six digits often end on a 5 in the seventh; 1e-8 more, here and in SQL, moves them off that tie."""
    s = after(folded(after(hourly(spark, sf_dir), P.LinearFill()), [24]), P.AffineFold(2))
    moved = lambda n: State(s.df.withColumn(n, F.transform(n, lambda x: x + F.lit(1e-8))), T, H)
    parts = [long(moved(f"affine_{n}"), f"affine_{n}", "i", "v").select("series_id", F.lit(n).alias("part"), "i", "v") for n in ("shape", "shift", "scale")]
    return reduce(DataFrame.union, parts)


@query("affine_forecast_two_cycles", _AFFINE + """, recent AS (SELECT series_id, phase, avg((y - shift) / scale) AS s FROM folded JOIN parts USING (series_id, cycle) WHERE cycle >= 26 GROUP BY 1, 2),
shapes AS (SELECT series_id, phase, (s - avg(s) OVER w) / greatest(stddev_pop(s) OVER w, 1e-8) AS s FROM recent WINDOW w AS (PARTITION BY series_id)),
vals AS (SELECT series_id, 'shift' AS part, cycle AS t, shift AS y FROM parts UNION ALL SELECT series_id, 'scale', cycle, scale FROM parts),
lagged AS (SELECT series_id, part, t::DOUBLE / 28e0 AS u, lag(y) OVER (PARTITION BY series_id, part ORDER BY t) AS x, y FROM vals),
moments AS (SELECT series_id, part, count(*) + 1e0 AS a, sum(u) AS b, sum(x) AS c, sum(u * u) + 1e0 AS d, sum(u * x) AS e, sum(x * x) + 1e0 AS f, sum(y) AS p, sum(u * y) AS q, sum(x * y) AS r FROM lagged WHERE x IS NOT NULL GROUP BY 1, 2),
solved AS (SELECT series_id, part, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det, p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r) AS n0,
  a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q) AS n1, a * (d * r - q * e) - b * (b * r - c * q) + p * (b * e - c * d) AS n2 FROM moments),
one AS (SELECT s.series_id, s.part, n0 / det AS b0, n1 / det AS b1, n2 / det AS b2, n0 / det + n1 / det + n2 / det * v.y AS y0 FROM solved s JOIN vals v ON v.series_id = s.series_id AND v.part = s.part AND v.t = 27),
ahead AS (SELECT series_id, part, 0 AS j, y0 AS y FROM one UNION ALL SELECT series_id, part, 1, b0 + b1 * 29e0 / 28e0 + b2 * y0 FROM one)
SELECT m.series_id, (m.j * 24 + s.phase)::INTEGER AS h, round(m.y + greatest(k.y, 0e0) * s.s, 4) AS yhat FROM ahead m JOIN ahead k ON k.series_id = m.series_id AND k.j = m.j AND k.part = 'scale' JOIN shapes s ON s.series_id = m.series_id WHERE m.part = 'shift'""")  # fmt: skip
def affine_forecast_two_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(after(folded(after(hourly(spark, sf_dir), P.LinearFill()), [24]), P.AffineFold(2), M.AffineForecast()), 4)


@query("affine_forecast")
def affine_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(apply_pipeline("LinearFill -> PeriodDetect -> affine_fold -> affine_forecast -> STOP", GRAMMAR, hourly(spark, sf_dir)))


@query("boxcox_lambda", _FOLD + """, positive AS (SELECT series_id, greatest(level + greatest(0e0, 1e-6 - min(level) OVER (PARTITION BY series_id)), 1e-8) AS y FROM levels),
grid AS (SELECT series_id, lam, -count(*) / 2e0 * ln(var_pop(CASE WHEN lam < 1e-8 THEN ln(y) ELSE (pow(y, lam) - 1e0) / lam END)) + (lam - 1e0) * sum(ln(y)) AS ll FROM positive CROSS JOIN (SELECT i / 20e0 AS lam FROM (SELECT unnest(range(21)) AS i)) GROUP BY 1, 2)
SELECT series_id, round(lam, 6) AS lam FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ll DESC, lam) AS k FROM grid) WHERE k = 1""")  # fmt: skip
def boxcox_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kernel(_seasonal(spark, sf_dir).df, lambda v: (K.boxcox_lambda(v + max(0.0, 1e-6 - v.min())),), ["level_series"], {"lam": "double"})
    return df.select("series_id", F.round("lam", 6).alias("lam"))


@query("damped_phi", _FOLD + """, d AS (SELECT series_id, cycle, level - lag(level) OVER (PARTITION BY series_id ORDER BY cycle) AS d FROM levels), e AS (SELECT series_id, d, lag(d) OVER (PARTITION BY series_id ORDER BY cycle) AS a FROM d)
SELECT series_id, round(least(greatest(sum(a * d) / sum(CASE WHEN d IS NULL OR a IS NULL THEN 0e0 ELSE a * a END), 0e0), 98e-2), 6) AS phi FROM e GROUP BY 1""")  # fmt: skip
def damped_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = kernel(_seasonal(spark, sf_dir).df, lambda v: (float(K.damping(v)),), ["level_series"], {"phi": "double"})
    return df.select("series_id", F.round("phi", 6).alias("phi"))


# models


@query("last_value", LONG + " SELECT f.series_id, f.h, round(h.y, 6) AS yhat FROM fut f JOIN hist h USING (series_id) WHERE h.t = 671")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(apply_pipeline("LinearFill -> last_value -> STOP", GRAMMAR, hourly(spark, sf_dir)))


@query("zero", LONG + " SELECT f.series_id, f.h, round(s.mu, 6) AS yhat FROM fut f JOIN stats s USING (series_id)")
def zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(apply_pipeline("LinearFill => ZNormalization => zero => STOP", GRAMMAR, hourly(spark, sf_dir)))


_PAIRS = LONG + """, q AS (SELECT series_id, ord, t - 624 AS j, y FROM hist WHERE t >= 624),
pair_sums AS (SELECT q.series_id, q.ord AS qo, c.series_id AS source, c.ord AS co, c.t - q.j AS i, sum(c.y) AS sc, sum(c.y * c.y) AS scc, sum(q.y) AS sq, sum(q.y * q.y) AS sqq, sum(c.y * q.y) AS scq
  FROM q JOIN hist c ON c.t - q.j BETWEEN 0 AND %(last)d %(own)s GROUP BY ALL),
fits AS (SELECT *, scc - sc * sc / 48e0 AS vc, sqq - sq * sq / 48e0 AS vq, scq - sc * sq / 48e0 AS cov FROM pair_sums),
scored AS (SELECT *, CASE WHEN sqrt(vc * vq) > 1e-12 THEN cov / sqrt(vc * vq) ELSE 0e0 END AS r, CASE WHEN vc > 1e-12 THEN cov / vc ELSE 1e0 END AS a FROM fits)"""
_BEST = """, best AS (SELECT *, (sq - a * sc) / 48e0 AS b, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC, co, i) AS k FROM scored)
SELECT b.series_id, (c.t - b.i - 48)::INTEGER AS h, round(b.a * c.y + b.b, 4) AS yhat FROM best b JOIN hist c ON c.series_id = b.source AND c.t BETWEEN b.i + 48 AND b.i + 95 WHERE b.k = 1"""


@query("parrot", _PAIRS % {"last": 576, "own": "AND c.series_id = q.series_id"} + _BEST)
def parrot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(apply_pipeline("LinearFill -> parrot -> STOP", GRAMMAR, hourly(spark, sf_dir)), 4)


@query("parrot_dataset_exhaustive", _PAIRS % {"last": 576, "own": ""} + _BEST)
def parrot_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(after(hourly(spark, sf_dir), P.LinearFill(), M.ParrotDataset(min_corr=None, max_candidates=None)), 4)


@query("parrot_dataset_sampled")
def parrot_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(after(hourly(spark, sf_dir), P.LinearFill(), M.ParrotDataset()), 4)


@query("window_kernel_fixed_gamma", _PAIRS % {"last": 576, "own": ""} + """, best AS (SELECT *, (sq - a * sc) / 48e0 AS b, row_number() OVER (PARTITION BY series_id, source ORDER BY abs(r) DESC, i) AS k FROM scored),
top AS (SELECT *, exp(10e0 * (abs(r) - max(abs(r)) OVER (PARTITION BY series_id))) AS w FROM best WHERE k = 1)
SELECT b.series_id, (c.t - b.i - 48)::INTEGER AS h, round(sum(b.w * (b.a * c.y + b.b)) / greatest(sum(b.w), 1e-9), 4) AS yhat FROM top b JOIN hist c ON c.series_id = b.source AND c.t BETWEEN b.i + 48 AND b.i + 95 GROUP BY 1, 2""")  # fmt: skip
def window_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(after(hourly(spark, sf_dir), P.LinearFill(), M.WindowKernel(gamma=10.0)), 4)


@query("window_kernel_auto")
def window_kernel_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(after(hourly(spark, sf_dir), P.LinearFill(), M.WindowKernel(gamma="auto", top_k_per_series=3)), 4)


def _by_chain(name: str, source: str, state: Callable[[SparkSession, str], State], presets: dict[str, dict] | None = None) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        grammar = G.build_grammar(True, True, True, presets) if presets else GRAMMAR
        return forecasts(apply_pipeline(source, grammar, state(spark, sf_dir)), 4)


_by_chain("kernel_rbf_loo", "LinearFill -> ZNormalization -> kernel_rbf -> STOP", daily)
_by_chain("rf_tabular", "LinearFill -> ZNormalization -> rf_tabular -> STOP", daily)
_by_chain("gbt_tabular", "LinearFill -> ZNormalization -> lightgbm_tabular -> STOP", daily, {"lightgbm_tabular": {"n_estimators": 3}})
_by_chain("versatile_gb", "LinearFill -> MeanAbsScaling -> versatile_gb -> STOP", daily, {"versatile_gb": {"max_iter": 2}})
_by_chain("gb_level_forecast", "LinearFill -> PeriodDetect -> SeasonalFold -> gb_level_forecast -> STOP", hourly)
_by_chain("level_shape_ridge", "LinearFill -> PeriodDetect -> SeasonalFold -> level_shape_ridge -> STOP", hourly)
_by_chain("flair_ridge_level", "FlairPreprocess -> PeriodDetect -> SeasonalFold -> FlairRidgeLevel -> STOP", hourly)
_by_chain("step_regression", "LinearFill -> PeriodDetect -> SeasonalFeatures -> step_regression -> STOP", hourly)


@query("flair_sample_paths")
def flair_sample_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    grammar = G.build_grammar()
    s = apply_pipeline("FlairPreprocess -> PeriodDetect -> SeasonalFold -> FlairRidgeLevel -> FlairSamplePaths -> STOP", grammar, hourly(spark, sf_dir))
    return M.sample_rows(s)


# metrics, sweeps and their analytics


@query("metrics_mae_rmse_max", LONG + " SELECT round(avg(abs(f.y - h.y)), 6) AS mae, round(sqrt(avg((f.y - h.y) * (f.y - h.y))), 6) AS rmse, round(max(abs(f.y - h.y)), 6) AS max_abs_error FROM fut f JOIN hist h USING (series_id) WHERE h.t = 671")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.score(apply_pipeline("LinearFill -> last_value -> STOP", GRAMMAR, hourly(spark, sf_dir)))
    return found.select(*[F.round(c, 6).alias(c) for c in ("mae", "rmse", "max_abs_error")])


@query("metrics_mase", LONG + """, naive AS (SELECT series_id, avg(abs(d)) AS scale FROM (SELECT series_id, raw - lag(raw, 24) OVER (PARTITION BY series_id ORDER BY t) AS d FROM hist) GROUP BY 1),
e AS (SELECT f.series_id, avg(abs(f.y - h.y)) AS mae FROM fut f JOIN hist h USING (series_id) WHERE h.t = 671 GROUP BY 1) SELECT round(avg(mae / scale), 6) AS mase FROM e JOIN naive USING (series_id) WHERE scale > 1e-12""")  # fmt: skip
def metrics_mase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(apply_pipeline("LinearFill -> last_value -> STOP", GRAMMAR, hourly(spark, sf_dir)), 24).select(F.round("mase", 6).alias("mase"))


CHAINS = ("LinearFill -> last_value", "ForwardFill -> last_value", "LinearFill -> zero", "LinearFill -> ZNormalization -> last_value", "LinearFill -> ZNormalization -> zero")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mase of a few chains on each series of the hourly panel, as if each were a dataset: one pass for all chains."""
    panel = hourly(spark, sf_dir)
    scale = S.naive_scale(F.col("original_history"), 1)

    def mase(s: State) -> Column:
        error = F.aggregate(F.zip_with(s.decoded(), "original_future", lambda p, y: F.abs(p - y)), F.lit(0.0), lambda a, x: a + x) / F.lit(float(H))
        return F.round(error / scale, 6)

    rows = []
    for chain in CHAINS:
        s = apply_pipeline(chain, GRAMMAR, panel)
        rows.append(s.df.select(F.col("series_id").alias("dataset"), F.lit(chain).alias("sequence"), F.lit(len(chain.split("->"))).alias("length"), F.lit("ok").alias("status"), mase(s).alias("mase")))
    return reduce(DataFrame.union, rows)


@query("sweep_ranked", RESULTS + " SELECT dataset, sequence, length, status, mase, row_number() OVER (ORDER BY mase ASC NULLS LAST, dataset, sequence)::INTEGER AS rank FROM results")
def sweep_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(results(spark, sf_dir))


@query("sweep_pivot", RESULTS + """ SELECT sequence, max(CASE WHEN dataset = 'click' THEN mase END) AS click, max(CASE WHEN dataset = 'purchase' THEN mase END) AS purchase, max(CASE WHEN dataset = 'signup' THEN mase END) AS signup FROM results GROUP BY 1""")
def sweep_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pivot(results(spark, sf_dir), ["click", "purchase", "signup"])


@query("sweep_mean_coverage", RESULTS + " SELECT sequence, round(avg(mase), 6) AS mean_mase, count(mase) AS coverage FROM results GROUP BY 1")
def sweep_mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(results(spark, sf_dir)).withColumn("mean_mase", F.round("mean_mase", 6))


_COLLAPSED = RESULTS + """, marks AS (SELECT sequence, string_agg(dataset || '=' || coalesce(format('{:.6f}', mase), 'NA'), '|' ORDER BY dataset) AS mark FROM results GROUP BY 1),
kept AS (SELECT sequence FROM (SELECT sequence, row_number() OVER (PARTITION BY mark ORDER BY len(string_split(sequence, '->')), length(sequence), sequence) AS k FROM marks) WHERE k = 1),
own AS (SELECT * FROM results WHERE sequence IN (SELECT sequence FROM kept)), least_ AS (SELECT dataset, min(mase) AS best FROM own GROUP BY 1),
won AS (SELECT sequence, sum(CASE WHEN mase <= best + 1e-9 THEN 1 ELSE 0 END)::BIGINT AS wins FROM own JOIN least_ USING (dataset) GROUP BY 1)"""


@query("sweep_collapse", _COLLAPSED + " SELECT sequence FROM kept")
def sweep_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.collapse(results(spark, sf_dir))


@query("sweep_wins", _COLLAPSED + " SELECT sequence, wins FROM won")
def sweep_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    return S.wins(found.join(S.collapse(found), "sequence", "left_semi"))


@query("sweep_topn", _COLLAPSED + " SELECT sequence, round(avg(mase), 6) AS mean_mase, count(mase) AS coverage, any_value(wins) AS wins FROM own JOIN won USING (sequence) GROUP BY 1 ORDER BY any_value(wins) DESC, avg(mase), sequence LIMIT 3")
def sweep_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.board(results(spark, sf_dir), "wins", 3).withColumn("mean_mase", F.round("mean_mase", 6))


@query("sweep_colours", RESULTS + " SELECT dataset, sequence, round(140e0 * (1e0 - CASE WHEN hi > lo THEN (mase - lo) / (hi - lo) ELSE 0e0 END), 4) AS hue FROM (SELECT *, min(mase) OVER (PARTITION BY dataset) AS lo, max(mase) OVER (PARTITION BY dataset) AS hi FROM results)")
def sweep_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.colours(results(spark, sf_dir)).withColumn("hue", F.round("hue", 4))


@query("token_leaderboard", RESULTS + ", each_ AS (SELECT *, trim(unnest(string_split(sequence, '->'))) AS token FROM results) SELECT token, count(*) AS n, round(avg(mase), 6) AS mean_mase, round(median(mase), 6) AS median_mase, min(mase) AS best_mase FROM each_ GROUP BY 1")
def token_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leaderboard(results(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_mase", "median_mase")})


@query("sweep_filter_tokens", RESULTS + " SELECT dataset, sequence, mase FROM results WHERE contains(lower(sequence), 'fill') AND contains(sequence, 'last_value') AND NOT contains(sequence, 'ZNormalization') AND length = 2")
def sweep_filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.filtered(results(spark, sf_dir), [2], "FILL", ["last_value"], ["ZNormalization"]).select("dataset", "sequence", "mase")


@query("sweep_cards", RESULTS + " SELECT count(DISTINCT sequence) AS pipelines, count(DISTINCT dataset) AS datasets, min(mase) AS best_mase FROM results")
def sweep_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cards(results(spark, sf_dir))


@query("champion", RESULTS + " SELECT dataset, sequence, mase FROM results WHERE mase IS NOT NULL ORDER BY mase, dataset, sequence LIMIT 1")
def champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.champion(results(spark, sf_dir))


@query("sweep_dedupe_predictions", RESULTS + """, firsts AS (SELECT series_id AS dataset, sequence, row_number() OVER (PARTITION BY series_id, round(c, 6) ORDER BY list_position(['LinearFill -> last_value', 'ForwardFill -> last_value', 'LinearFill -> zero', 'LinearFill -> ZNormalization -> last_value', 'LinearFill -> ZNormalization -> zero'], sequence)) AS k FROM guess)
SELECT dataset, sequence FROM firsts WHERE k = 1""")  # fmt: skip
def sweep_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = hourly(spark, sf_dir)
    rows = [forecasts(apply_pipeline(c, GRAMMAR, panel)).select(F.col("series_id").alias("dataset"), F.lit(0).alias("ord"), "h", "yhat", F.lit(c).alias("sequence"), F.lit(i).alias("pos")) for i, c in enumerate(CHAINS)]
    return S.dedupe(reduce(DataFrame.union, rows)).select("dataset", "sequence")


# grammar and catalogue


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names}))"


CORE_GRAMMAR = G.build_grammar()
#: Tokens and those that may follow each (fixed values), written out here for SQL and apart from the grammar's own table.
_FOLLOW = """
START: FlairPreprocess ForwardFill FourierFeatures LinearFill MeanAbsScaling PeriodDetect PeriodDetectBIC PeriodDetectSpectral ZNormalization versatile_gb
FlairPreprocess: PeriodDetect PeriodDetectBIC PeriodDetectSpectral
ForwardFill: FourierFeatures MeanAbsScaling PeriodDetect PeriodDetectBIC PeriodDetectSpectral ZNormalization kernel_rbf lightgbm_tabular parrot parrot_dataset rf_tabular versatile_gb
LinearFill: FourierFeatures MeanAbsScaling PeriodDetect PeriodDetectBIC PeriodDetectSpectral ZNormalization kernel_rbf lightgbm_tabular parrot parrot_dataset rf_tabular versatile_gb
MeanAbsScaling: FourierFeatures PeriodDetect PeriodDetectBIC PeriodDetectSpectral kernel_rbf lightgbm_tabular parrot parrot_dataset rf_tabular step_regression versatile_gb
ZNormalization: FourierFeatures PeriodDetect PeriodDetectBIC PeriodDetectSpectral kernel_rbf lightgbm_tabular parrot parrot_dataset rf_tabular step_regression versatile_gb
FlairSamplePaths: STOP
FourierFeatures: FourierFeatures kernel_rbf lightgbm_tabular parrot parrot_dataset rf_tabular step_regression versatile_gb
PeriodDetect: PeriodPhaseOneHot SeasonalFeatures SeasonalFold step_regression
PeriodDetectBIC: PeriodPhaseOneHot SeasonalFeatures SeasonalFold step_regression
PeriodDetectSpectral: PeriodPhaseOneHot SeasonalFeatures SeasonalFold step_regression
PeriodPhaseOneHot: SeasonalFold
SeasonalFeatures: kernel_rbf lightgbm_tabular parrot rf_tabular step_regression versatile_gb
SeasonalFold: FlairRidgeLevel SeasonalFold gb_level_forecast level_shape_ridge
FlairRidgeLevel: FlairSamplePaths STOP parrot
gb_level_forecast: STOP parrot
kernel_rbf: STOP kernel_rbf parrot parrot_dataset
level_shape_ridge: STOP kernel_rbf parrot
lightgbm_tabular: STOP parrot parrot_dataset
parrot: STOP kernel_rbf lightgbm_tabular rf_tabular versatile_gb
parrot_dataset: STOP kernel_rbf lightgbm_tabular rf_tabular
rf_tabular: STOP parrot parrot_dataset
step_regression: STOP parrot
versatile_gb: STOP parrot versatile_gb
""".strip()
_EDGES = f"""(SELECT string_split(line, ': ')[1] AS src, unnest(string_split(string_split(line, ': ')[2], ' ')) AS dst FROM (SELECT unnest(string_split('{_FOLLOW}', chr(10))) AS line))"""
_NODES = _values([("START", "boundary"), *((n, t.kind) for n, t in CORE_GRAMMAR.tokens.items()), ("STOP", "boundary")], "id, class")


@query("grammar_edges", f"SELECT src, dst FROM {_EDGES}")
def grammar_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.edges_df(spark, CORE_GRAMMAR)
    return G.merged_edges(edges, edges)


@query("catalog_matrix", f"""SELECT n.id, n.class, coalesce((SELECT string_agg(DISTINCT src, ' ' ORDER BY src) FROM {_EDGES} e WHERE e.dst = n.id), '') AS parents, coalesce((SELECT string_agg(DISTINCT dst, ' ' ORDER BY dst) FROM {_EDGES} e WHERE e.src = n.id), '') AS next FROM {_NODES} n""")
def catalog_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.catalog_matrix(G.nodes_df(spark, CORE_GRAMMAR), G.edges_df(spark, CORE_GRAMMAR))


@query("unknown_reference_antijoin", f"SELECT DISTINCT id FROM (SELECT src AS id FROM {_EDGES} UNION SELECT dst FROM {_EDGES}) WHERE id NOT IN (SELECT id FROM {_NODES} WHERE class <> 'cleaning')")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unknown_references(G.nodes_df(spark, CORE_GRAMMAR).where("class <> 'cleaning'"), G.edges_df(spark, CORE_GRAMMAR))


@query("induced_edges", f"SELECT src, dst FROM {_EDGES} WHERE src IN (SELECT id FROM {_NODES} WHERE class = 'model') AND dst IN (SELECT id FROM {_NODES} WHERE class = 'model')")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.induced(G.nodes_df(spark, CORE_GRAMMAR).where("class = 'model'"), G.edges_df(spark, CORE_GRAMMAR))


@query("enumerate_sequences", """WITH RECURSIVE toks AS (SELECT * FROM (VALUES ('LinearFill', 0, 0, 'fill'), ('ForwardFill', 0, 1, 'fill'), ('FlairPreprocess', 0, 2, 'fill'), ('ZNormalization', 1, 3, 'scale'), ('MeanAbsScaling', 1, 4, 'scale'), ('PeriodDetect', 2, 5, 'detect'), ('PeriodDetectBIC', 2, 6, 'detect'), ('PeriodDetectSpectral', 2, 7, 'detect'), ('PeriodPhaseOneHot', 2, 8, 'hot'), ('SeasonalFold', 2, 9, 'fold'), ('FourierFeatures', 2, 10, 'fourier'),
('kernel_rbf', 3, 11, 'm'), ('rf_tabular', 3, 12, 'm'), ('lightgbm_tabular', 3, 13, 'm'), ('versatile_gb', 3, 14, 'm'), ('parrot', 3, 15, 'm'), ('parrot_dataset', 3, 16, 'm'), ('level_shape_ridge', 3, 17, 'level'), ('FlairRidgeLevel', 3, 18, 'raw'), ('gb_level_forecast', 3, 19, 'raw')) v(name, phase, canon, grp)),
w AS (SELECT '' AS seq, -1 AS phase, -1 AS canon, '' AS grp, 0 AS n, false AS feat, false AS per, false AS fold, false AS scaled
 UNION ALL SELECT CASE WHEN w.n = 0 THEN t.name ELSE w.seq || ' -> ' || t.name END, t.phase, t.canon, t.grp, w.n + 1, w.feat OR t.grp IN ('fill', 'scale', 'hot', 'fold', 'fourier'), w.per OR t.grp = 'detect', w.fold OR t.grp = 'fold', w.scaled OR t.grp = 'scale'
 FROM w JOIN toks t ON t.canon > w.canon AND t.grp <> w.grp WHERE w.n < 3 AND w.phase < 3 AND (t.grp NOT IN ('hot', 'fold') OR w.per) AND (t.phase < 3 OR w.feat) AND (t.grp NOT IN ('level', 'raw') OR w.fold) AND (t.grp <> 'raw' OR NOT w.scaled))
SELECT n AS length, seq AS sequence FROM w WHERE phase = 3""")  # fmt: skip
def enumerate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.enumerate_sequences(S.token_table(spark), 3)


def baseline_grammar() -> G.Grammar:
    """Fills and scalings before the two models that have closed forms."""
    fills, ends = ("LinearFill", "ForwardFill"), ("last_value", "zero")
    out = G.Grammar()
    for f in (P.LinearFill(), P.ForwardFill()):
        out.register(f, (G.START,), ("ZNormalization", *ends))
    for t in (P.ZNormalization(), M.LastValue(), M.Zero()):
        out.register(t, leads_to=ends if t.kind == "transform" else (G.STOP,))
    return out


@query("sweep_datasets", LONG + """,
wave AS (SELECT format('s{:05d}', k) AS series_id, t::INTEGER AS t, 8e0 + 5e-1 * k + 2e0 * sin(2e0 * pi() * t / 24e0) AS y FROM (SELECT unnest(range(5)) AS k) CROSS JOIN (SELECT unnest(range(96)) AS t)),
past AS (SELECT 'events' AS dataset, series_id, t, raw, y, carried FROM hist UNION ALL SELECT 'waves', series_id, t, y, y, y FROM wave WHERE t < 72),
next_ AS (SELECT 'events' AS dataset, series_id, h, y FROM fut UNION ALL SELECT 'waves', series_id, t - 72, y FROM wave WHERE t >= 72),
facts AS (SELECT dataset, series_id, arg_max(y, t) AS line_end, arg_max(carried, t) AS carried_end, avg(y) AS line_mean, avg(carried) AS carried_mean, stddev_pop(y) + 1e-8 AS line_sigma, stddev_pop(carried) + 1e-8 AS carried_sigma FROM past GROUP BY 1, 2),
chains AS (SELECT * FROM (VALUES (0, 'LinearFill -> ZNormalization -> last_value'), (1, 'LinearFill -> ZNormalization -> zero'), (2, 'LinearFill -> last_value'), (3, 'LinearFill -> zero'),
  (4, 'ForwardFill -> ZNormalization -> last_value'), (5, 'ForwardFill -> ZNormalization -> zero'), (6, 'ForwardFill -> last_value'), (7, 'ForwardFill -> zero')) v(pos, sequence)),
guess AS (SELECT dataset, series_id, pos, sequence, CASE pos WHEN 1 THEN line_mean WHEN 3 THEN 0e0 WHEN 5 THEN carried_mean WHEN 7 THEN 0e0 WHEN 0 THEN line_end * line_sigma + line_mean WHEN 2 THEN line_end WHEN 4 THEN carried_end * carried_sigma + carried_mean ELSE carried_end END AS c FROM facts CROSS JOIN chains),
marks AS (SELECT dataset, pos, sequence, string_agg(round(c, 6)::VARCHAR, ' ' ORDER BY series_id) AS mark FROM guess GROUP BY 1, 2, 3),
firsts AS (SELECT dataset, pos, sequence FROM (SELECT *, row_number() OVER (PARTITION BY dataset, mark ORDER BY pos) AS k FROM marks) WHERE k = 1),
naive AS (SELECT dataset, series_id, avg(abs(d)) AS scale FROM (SELECT dataset, series_id, raw - lag(raw) OVER (PARTITION BY dataset, series_id ORDER BY t) AS d FROM past) GROUP BY 1, 2),
each AS (SELECT g.dataset, g.pos, g.sequence, g.series_id, sum(abs(n.y - g.c)) AS a, sum((n.y - g.c) * (n.y - g.c)) AS q, count(*) AS n FROM guess g JOIN next_ n USING (dataset, series_id) GROUP BY 1, 2, 3, 4)
SELECT f.dataset, f.sequence, len(string_split(f.sequence, ' -> '))::INTEGER AS length, 'ok' AS status, round(sum(a) / sum(n), 4) AS mae, round(sqrt(sum(q) / sum(n)), 4) AS rmse, round(avg(a / n / scale), 4) AS mase
FROM firsts f JOIN each e USING (dataset, pos) JOIN naive USING (dataset, series_id) GROUP BY f.dataset, f.pos, f.sequence""")  # fmt: skip
def sweep_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain of the baseline grammar over two panels. last_value takes the clean history, also in a scaled space."""
    panels = {"events": hourly(spark, sf_dir), "waves": start(B.synthetic(spark), 72, 24)}
    found = S.results_df(spark, S.sweep(panels, baseline_grammar()))
    return found.select("dataset", "sequence", "length", "status", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "mase")])

"""Language, grammar, state, sources and sweeps."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline import catalog
from weftline.operators import models as M
from weftline.operators import prepare as P
from weftline.operators.base import ModelToken
from weftline.plans import grammar as G
from weftline.plans import language as L
from weftline.plans import state as T
from weftline.plans import sweep as S
from weftline.sources import panel as B
from weftline.sources import sinks
from weftline.streaming.scoring import hourly_sums


@pytest.fixture(scope="module")
def grammar():
    return G.build_grammar(True, True, True)


@pytest.fixture(scope="module")
def state(spark):
    return T.start(B.synthetic(spark, 4, 72, 6).cache(), 72, 6)


def test_sizes_of_the_grammar(grammar):
    assert repr(G.build_grammar()) == "Grammar(23 tokens, 123 edges)" and repr(grammar) == "Grammar(28 tokens, 146 edges)"


def test_register_replaces_and_accumulates():
    g = G.Grammar()
    a, b = P.LinearFill(), P.LinearFill()
    g.register(a, ("START",)).register(b, (), ("zero",)).register(b, ("START",))
    assert g.tokens["LinearFill"] is b and g.edge_list == [("START", "LinearFill"), ("LinearFill", "zero")]


@pytest.mark.parametrize("source", ["a -> b", "a=>b => STOP", "a(x=1, y=-2.5e3, z='q\\'s', t=true, n=None,) -> b() -> STOP", 'a(s="x->y")'])
def test_language_round_trip(source):
    p = L.parse_pipeline(source)
    assert L.parse_pipeline(p.to_source()) == p


@pytest.mark.parametrize("source", ["", "->", "a ->", "a b", "a(1)", "a(x=)", "a(x=y)", "STOP", "STOP -> a", "a -> STOP(x=1)", "a(x=1", "a $ b"])
def test_syntax_errors(source):
    with pytest.raises(L.PipelineSyntaxError):
        L.parse_pipeline(source)


@pytest.mark.parametrize("source", ["Nope -> zero", "LinearFill -> STOP", "zero -> LinearFill", "ZNormalization -> LinearFill"])
def test_validation_errors(source, grammar):
    with pytest.raises(L.PipelineValidationError):
        L.validate_pipeline(source, grammar)


def test_walk_errors(state, grammar):
    with pytest.raises(L.PipelineValidationError, match="arguments"):
        L.apply_pipeline("FourierFeatures(n_harmonics=2) -> kernel_rbf", grammar, state)
    assert L.apply_pipeline("FourierFeatures(n_harmonics=2) -> kernel_rbf", grammar, state, bind_kwargs=True).metadata["fourier_features"] == 14
    with pytest.raises(L.PipelineValidationError, match="can't be applied"):
        L.apply_pipeline("PeriodDetect -> step_regression", grammar, state)
    with pytest.raises(RuntimeError):
        L.run_sequence(["zero"], grammar, state)


def test_residuals_and_decoding(state, grammar):
    s = L.run_sequence(["LinearFill", "ZNormalization", "zero", "parrot"], grammar, state)[-1]
    row = s.df.select("target_base", "pred_1", "pred_2", s.residual().alias("r"), s.decoded().alias("f"), "original_future", "z_fit").first()
    for y, a, b, r, f in zip(row["target_base"], row["pred_1"], row["pred_2"], row["r"], row["f"], strict=True):
        assert r == pytest.approx(y - a - b) and f == pytest.approx((a + b) * row["z_fit"]["sigma"] + row["z_fit"]["mu"])
    exact = s.push(s.df.withColumn("new__", s.residual()), "new__", "rest")
    got = exact.df.select(exact.decoded().alias("f"), "original_future").first()
    assert got["f"] == pytest.approx(got["original_future"])
    assert T.residual_norm(exact) == pytest.approx(0, abs=1e-9)


def test_board_and_bundle(state, grammar):
    s = L.run_sequence(["LinearFill", "ZNormalization", "FourierFeatures"], grammar, state)[-1]
    assert [b.name for b in s.bundle()] == ["scaled_history", "fourier_features"]
    assert s.query(sem="features")[0].name == "fourier_features" and s.one(sem="series", tags=("no_bundle",)).name == "clean_history"
    with pytest.raises(KeyError):
        s.one(sem="mask")
    with pytest.raises(ValueError):
        T.Signal("x", "nonsense", ())
    width = s.df.select(F.size(s.bundle_column()).alias("n")).first()["n"]
    assert width == sum(b.size for b in s.bundle())
    first = L.run_sequence(["LinearFill"], grammar, state)[-1]
    assert T.difference(first, s)["added"] == ["fourier_features", "meta:fourier_features", "scaled_history"]
    with pytest.raises(ValueError):
        state.bundle_column(("nothing",))
    assert s.board_df(state.df.sparkSession).count() == len(s.board) and s.log_df(state.df.sparkSession).count() == 3


def test_valid_actions(state, grammar):
    start = set(grammar.valid_actions(state))
    assert "LinearFill" in start and "versatile_gb" not in start
    s = L.run_sequence(["LinearFill", "last_value"], grammar, state)[-1]
    assert grammar.valid_actions(s) == ["STOP"]


def test_own_tokens(state, grammar):
    class Mean(ModelToken):
        name = "mean"

        def apply(self, s):
            return s.push(s.df.withColumn("new__", F.array_repeat(P.total(F.col("raw_history")) / F.size("raw_history"), s.horizon)), "new__", self.name)

    g = G.build_grammar().register(Mean(), ("LinearFill",), ("STOP",))
    s = L.apply_pipeline("LinearFill -> mean -> STOP", g, state)
    assert "terminated" in s.flags and s.df.select("final_forecast").first()[0] == pytest.approx([8.0] * 6)


@pytest.mark.parametrize("chain", ["FlairPreprocess -> PeriodDetect -> PeriodPhaseOneHot -> SeasonalFold -> level_shape_ridge -> STOP", "LinearFill -> PeriodDetectBIC -> SeasonalFold -> FlairRidgeLevel -> FlairSamplePaths -> STOP", "LinearFill -> PeriodDetectSpectral -> affine_fold -> affine_forecast -> STOP", "LinearFill -> window_kernel -> STOP"])
def test_seasonal_chains_find_the_wave(chain, state, grammar):
    s = L.apply_pipeline(chain, grammar, state)
    found = S.score(s).first()
    assert found["mae"] < 0.2 and s.metadata.get("period", 24) == 24
    if "Paths" in chain:
        assert M.sample_rows(s).count() == 4 * 100 * 6


def test_exhaustive_analogs_in_blocks_and_whole(state):
    whole = P.LinearFill().run(state)
    one, many = (M.ParrotDataset(min_corr=None, max_candidates=None, block=b).run(whole) for b in (256, 2))
    rows = lambda s: {r[0]: r[1] for r in s.df.select("series_id", "pred_1").collect()}
    a, b = rows(one), rows(many)
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_metrics_exclude_flat_series(spark):
    rows = [("a", 0, [1.0, 2.0, 4.0], [4.0, 6.0]), ("b", 1, [5.0, 5.0, 5.0], [5.0, 7.0])]
    panel = spark.createDataFrame(rows, "series_id string, ord int, history array<double>, future array<double>")
    g = G.build_grammar(baselines=True)
    found = S.score(L.apply_pipeline("LinearFill -> last_value -> STOP", g, T.start(panel, 3, 2))).first()
    assert found["mae"] == pytest.approx(1) and found["max_abs_error"] == 2 and found["mase"] == pytest.approx(1 / 1.5)
    flat = S.score(L.apply_pipeline("LinearFill -> last_value -> STOP", g, T.start(panel.where("ord = 1"), 3, 2))).first()
    assert flat["mase"] is None


def test_sweep_shares_prefixes_and_counts_equal_forecasts_once(state, spark):
    g = G.Grammar()
    for token, follows, leads in ((P.LinearFill(), ("START",), ("last_value", "zero")), (P.ForwardFill(), ("START",), ("last_value",)), (M.LastValue(), (), ("STOP",)), (M.Zero(), (), ("STOP",))):
        g.register(token, follows, leads)
    rows = S.sweep(state, g)
    assert [r["sequence"] for r in rows] == ["LinearFill -> last_value", "LinearFill -> zero"] and all(r["status"] == "ok" for r in rows)
    frame = S.results_df(spark, rows)
    assert S.champion(frame).first()["sequence"] in {r["sequence"] for r in rows}


def test_255_sequences(spark):
    rows = S.enumerate_sequences(S.token_table(spark)).collect()
    assert len(rows) == len({r["sequence"] for r in rows}) == 255 and sum(r["length"] == 2 for r in rows) == 36


def test_analytics_of_results_with_holes(spark, tmp_path):
    rows = [("d1", 2, 1.0, "ok", "A -> m"), ("d2", 2, None, "ok", "A -> m"), ("d1", 2, 1.0000001, "ok", "B -> m"), ("d2", 2, None, "ok", "B -> m"), ("d1", 3, 0.5, "ok", "A -> A -> m"), ("d2", 3, 2.0, "ok", "A -> A -> m"), ("d1", 1, None, "ValueError", "m")]
    frame = spark.createDataFrame(rows, "dataset string, length int, mase double, status string, sequence string")
    assert S.filtered(frame).count() == 6 and S.filtered(frame, [3], required=["A"]).count() == 2 and S.filtered(frame, blocked=["B"], datasets=["d1"], contains="a").count() == 2
    ok = S.filtered(frame)
    assert sorted(r["sequence"] for r in S.collapse(ok).collect()) == ["A -> A -> m", "A -> m"]
    assert [r["sequence"] for r in S.board(ok, "mean").collect()] == ["A -> m", "A -> A -> m"]
    assert {r["sequence"]: r["wins"] for r in S.wins(ok).collect()}["A -> A -> m"] == 2
    assert S.ranked(frame).orderBy("rank").collect()[-1]["mase"] is None
    board = {r["token"]: r for r in S.leaderboard(ok).collect()}
    assert board["A"]["n"] == 6 and board["A"]["best_mase"] == 0.5
    sinks.write_results(ok, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 6
    assert "<code>a</code>" in sinks.boxed_html(["a -> b"]) and spark.range(1).select(S.boxed(F.lit("a -> b")).alias("s")).first()["s"] == "[ a ] -> [ b ]"


def test_panels(spark):
    long = spark.createDataFrame([("x", 0, 1.0), ("x", 2, math.nan), ("x", 3, 5.0), ("y", 1, 2.0), ("y", 9, 1.0)], "series_id string, t int, y double")
    rows = {r["series_id"]: r for r in B.grid(long, 3, 2).collect()}
    assert rows["x"]["history"] == [1.0, None, None] and rows["x"]["future"] == [5.0, 5.0] and rows["y"]["future"] == [0.0, 0.0] and rows["y"]["ord"] == 1
    assert B.assert_rectangular(B.grid(long, 3, 2)) == (3, 2)
    bad = spark.createDataFrame([([1.0], [1.0]), ([1.0, 2.0], [1.0])], "history array<double>, future array<double>")
    with pytest.raises(ValueError):
        B.assert_rectangular(bad)
    with pytest.raises(ValueError):
        B.record_series(bad, "neither")
    with pytest.raises(ValueError):
        B.manifest(spark.createDataFrame([("abc",)], "tag string"), "%")
    w = B.sliding_windows(spark.createDataFrame([("x", [float(i) for i in range(10)]), ("s", [1.0])], "series_id string, y array<double>"), 3, 2, 2, 2).collect()
    assert [(r["window_start"], r["history"], r["future"]) for r in w] == [(0, [0, 1, 2], [3, 4]), (2, [2, 3, 4], [5, 6])]


def test_ranks_over_many_ranges(spark):
    panel = spark.range(500).select(F.concat(F.lit("s"), F.col("id")).alias("series_id"))
    rows = B.with_order(panel.repartition(7)).collect()
    assert [r["ord"] for r in sorted(rows, key=lambda r: r["series_id"])] == list(range(500))


def test_catalogue(spark):
    g = G.build_grammar()
    nodes, edges = G.nodes_df(spark, g), G.edges_df(spark, g)
    assert G.catalog_matrix(nodes, edges).count() == 25 and G.unknown_references(nodes, edges).count() == 0
    assert G.mermaid(g).count("-->") == 123


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["series_id", "h", "yhat"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_datasets_of_records_are_panels_by_name(spark):
    rows = [([1.0, float("nan"), 3.0], [4.0], "d", "s", f"i{k}", k) for k in range(3)] + [([1.0], [2.0], "d", "s", "short", 0)] + [([1.0, 2.0], [3.0, 4.0], "d", None, f"j{k}", 0) for k in range(2)]
    records = spark.createDataFrame(rows, "history array<double>, future array<double>, source_domain string, source_subset string, item_id string, chunk_start int")
    found = B.datasets(records)
    assert list(found) == ["d__s", "d__unknown"]
    own = found["d__s"].orderBy("ord").collect()
    assert [(r["ord"], r["series_id"], r["history"]) for r in own] == [(k, f"i{k}@{k}", [1.0, None, 3.0]) for k in range(3)]
    windows = B.record_windows(records.withColumn("tag", F.lit("t")), 2, 1, max_windows=4)
    assert [(r["series_id"], r["window_start"]) for r in windows.collect()] == [("t/i0", 0), ("t/i0", 1), ("t/i1", 0), ("t/i1", 1)]


def test_manual_series_make_a_panel(spark):
    p = B.manual(spark, {"b": [1, None, 3, 4], "a": [5, 6, float("inf"), 8]}, 1)
    assert [(r["series_id"], r["history"], r["future"]) for r in p.orderBy("ord").collect()] == [("a", [5, 6, None], [8]), ("b", [1, None, 3], [4])]
    with pytest.raises(ValueError, match="one length"):
        B.manual(spark, {"a": [1, 2], "b": [1]}, 1)


def test_broken_and_missing_shards_are_skipped(spark, tmp_path):
    spark.createDataFrame([([1.0], [2.0])], "history array<double>, future array<double>").write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no table PAR1")
    lines = [f"x-{n},{tmp_path / n}" for n in ("good", "bad.parquet", "none")]
    (tmp_path / "m.csv").write_text("\n".join(["tag,path", *lines]))
    assert [r["tag"] for r in B.read_records(spark, str(tmp_path / "m.csv"), "X-").collect()] == ["x-good"]


def test_model_input_wins_over_the_bundle(spark):
    s = L.run_sequence(["LinearFill", "ZNormalization", "FourierFeatures"], G.build_grammar(), T.start(B.synthetic(spark), 72, 24))
    one = s[-1].set_model_input("scaled_history")
    assert [b.name for b in one.bundle()] == ["scaled_history"] and one.df.select(F.size(one.bundle_column())).first()[0] == 72
    assert [b.name for b in one.set_model_input().bundle()] == [b.name for b in s[-1].bundle()]
    with pytest.raises(KeyError):
        one.set_model_input("nothing")


def test_step_reports_say_what_a_token_did(spark):
    rows = T.step_report(L.run_sequence(["LinearFill", "ZNormalization", "parrot"], G.build_grammar(), T.start(B.synthetic(spark), 72, 24)), norms=True)
    assert [r["token"] for r in rows] == ["LinearFill", "ZNormalization", "parrot"] and "clean_history" in rows[0]["added"]
    assert rows[1]["space"] == "ZNormalization" and rows[2]["norm_after"] < rows[2]["norm_before"] and rows[2]["predictions"] == 1


def test_graph_as_json_and_html():
    g = G.build_grammar()
    made = json.loads(G.graph_json(g))
    assert len(made["edges"]) == 123 and len(made["tokens"]) == 25 and set(made["tokens"][1]) == {"id", "status", "class", "core", "parents", "next", "reads", "writes", "description"}
    assert "<table>" in G.graph_html(g) and next(r for r in made["tokens"] if r["id"] == "parrot")["next"]


def test_sweep_records_failures_and_goes_on(spark):
    class Broken(M.Zero):
        name = "broken"

        def apply(self, state):
            raise OverflowError("no")

    class Late(M.Zero):
        name = "late"

        def apply(self, state):
            return state.push(state.df.withColumn("new__", F.transform("target_base", lambda y: F.raise_error(F.lit("later")).cast("double"))), "new__", self.name)

    g = G.Grammar()
    for t in (P.LinearFill(), Broken(), Late(), M.Zero()):
        g.register(t, ("START",) if t.kind == "cleaning" else ("LinearFill",))
    rows = S.sweep({"a": T.start(B.synthetic(spark), 72, 24)}, g)
    assert [(r["sequence"], r["status"] == "ok") for r in rows] == [("LinearFill -> broken", False), ("LinearFill -> late", False), ("LinearFill -> zero", True)]
    assert rows[0]["status"] == "OverflowError" and rows[2]["mae"] > 0


def test_ranked_results_of_several_sweeps_are_one_file(spark, tmp_path):
    frames = [S.results_df(spark, [{"dataset": d, "length": 1, "mase": m, "rmse": None, "mae": None, "seconds": 0.5, "status": "ok", "sequence": 'a "b", c'}]) for d, m in (("x", None), ("y", 2.0), ("z", 1.0))]
    sinks.write_ranked(frames, str(tmp_path / "all"))
    rows = sinks.read_results(spark, str(tmp_path / "all")).collect()
    assert [(r["dataset"], r["mase"]) for r in rows] == [("z", 1.0), ("y", 2.0), ("x", None)] and rows[0]["sequence"] == 'a "b", c'


def test_streamed_hours_are_the_batch_sums(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    sums = hourly_sums(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = sums.writeStream.format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["series_id"], r["hour"]): round(r["y"], 6) for r in spark.table("hours").collect()}
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    want = {(r["s"], r["h"]): round(r["y"], 6) for r in events.groupBy(F.col("event_type").alias("s"), hour.alias("h")).agg(F.sum("value").alias("y")).collect()}
    last = max(h for _, h in want) - datetime.timedelta(hours=4)
    assert got and all(want[k] == v for k, v in got.items()) and {k for k in want if k[1] < last} <= set(got)


def test_kernel_ridge_in_blocks_and_whole(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"s{i:03}", i, rng.normal(size=12).tolist(), rng.normal(size=3).tolist()) for i in range(47)]
    panel = spark.createDataFrame(rows, "series_id string, ord int, history array<double>, future array<double>")
    grammar = G.build_grammar(baselines=True)
    fitted = lambda: {r[0]: r[1] for r in L.apply_pipeline("LinearFill -> ZNormalization -> kernel_rbf -> STOP", grammar, T.start(panel, 12, 3)).df.select("series_id", "final_forecast").collect()}
    whole = fitted()
    monkeypatch.setattr(M, "MOST_DENSE", 10)
    monkeypatch.setattr(M, "BLOCK", 13, raising=False)
    blocked = fitted()
    assert len(blocked) == 47 and all(blocked[k] == pytest.approx(whole[k], abs=1e-8) for k in whole)


def test_kernel_ridge_of_many_series_shuffles_little_and_is_the_dense_solve(spark, monkeypatch):
    rng = np.random.default_rng(9)
    grammar = G.build_grammar(baselines=True)
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    def fitted(histories):
        rows = [(f"s{i:03}", i, h, np.random.default_rng(i).normal(size=3).tolist()) for i, h in enumerate(histories)]
        panel = spark.createDataFrame(rows, "series_id string, ord int, history array<double>, future array<double>").cache()
        found = lambda: {r[0]: r[1] for r in L.apply_pipeline("LinearFill -> ZNormalization -> kernel_rbf -> STOP", grammar, T.start(panel, 12, 3)).df.select("series_id", "final_forecast").collect()}
        before = shuffled()
        whole = found()
        between = shuffled()
        with monkeypatch.context() as m:
            for name, value in {"MOST_DENSE": 60, "BLOCK": 45, "PANEL_BYTES": 8 * 600 * 40, "ROWS": 15, "WIDE": 200}.items():
                m.setattr(M, name, value, raising=False)
            small = found()
        assert set(small) == set(whole) and all(small[k] == pytest.approx(whole[k], abs=1e-7) for k in whole)
        return (shuffled() - between) - (between - before)

    n, few = 600, rng.normal(size=(50, 12)).tolist()
    matrix = 8 * n * n / 2
    assert fitted(rng.normal(size=(n, 12)).tolist()) < 24 * matrix  # when all blocks were moved in each step, each was written about 3 times in each of 14
    assert fitted([few[i % 50] for i in range(n)]) < matrix  # copies of 50 series

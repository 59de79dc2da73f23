"""Queries of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from weftline import catalog

SF = "/root/testdata/sf0.001"
SOME = ["pipeline_z_last_value", "panel_mode_length", "linear_fill", "forward_fill", "fourier_features", "seasonal_fold_shape2", "seasonal_fold_twice", "affine_fold", "affine_forecast_two_cycles", "boxcox_lambda", "parrot_dataset_exhaustive", "window_kernel_fixed_gamma", "metrics_mase", "sweep_topn", "sweep_dedupe_predictions", "grammar_edges", "catalog_matrix", "enumerate_sequences"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(name, spark, con):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLE[name]).fetchdf()
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)

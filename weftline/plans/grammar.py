"""Which token may follow which."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import prepare as P
from ..operators.base import Token
from .state import State

START, STOP = "START", "STOP"
DETECTORS = ("PeriodDetect", "PeriodDetectBIC", "PeriodDetectSpectral")
#: Classes in the order of a catalogue.
CLASS_ORDER = ("boundary", "cleaning", "transform", "feature", "model", "control")

TOKENS: dict[str, type[Token]] = {t.name: t for t in (
    P.LinearFill, P.ForwardFill, P.FlairPreprocess, P.ZNormalization, P.MeanAbsScaling, P.FourierFeatures, P.PeriodDetect, P.PeriodDetectBIC, P.PeriodDetectSpectral,
    P.PeriodPhaseOneHot, P.SeasonalFold, P.SeasonalFeatures, M.KernelRBF, M.RandomForestTabular, M.LightGBMTabular, M.VersatileGB, M.Parrot, M.ParrotDataset, M.LevelShapeRidge,
    M.FlairRidgeLevel, M.FlairSamplePaths, M.GBLevelForecast, M.StepRegression, P.AffineFold, M.AffineForecast, M.WindowKernel, M.LastValue, M.Zero,
)}

#: Edges of the five core registries (fixed values): what may follow each token.
CORE: dict[str, tuple[str, ...]] = {
    START: ("LinearFill", "ForwardFill", "FlairPreprocess", "ZNormalization", "MeanAbsScaling", "FourierFeatures", *DETECTORS, "versatile_gb"),
    "FlairPreprocess": DETECTORS,
    "FourierFeatures": ("FourierFeatures", "kernel_rbf", "rf_tabular", "lightgbm_tabular", "parrot", "parrot_dataset", "versatile_gb", "step_regression"),
    "PeriodPhaseOneHot": ("SeasonalFold",),
    "SeasonalFold": ("SeasonalFold", "level_shape_ridge", "FlairRidgeLevel", "gb_level_forecast"),
    "SeasonalFeatures": ("kernel_rbf", "rf_tabular", "lightgbm_tabular", "parrot", "versatile_gb", "step_regression"),
    "FlairRidgeLevel": ("FlairSamplePaths", "parrot", STOP),
    "FlairSamplePaths": (STOP,),
    "level_shape_ridge": ("kernel_rbf", "parrot", STOP),
    "gb_level_forecast": ("parrot", STOP),
    "kernel_rbf": ("kernel_rbf", "parrot", "parrot_dataset", STOP),
    "parrot": ("kernel_rbf", "rf_tabular", "lightgbm_tabular", "versatile_gb", STOP),
    "parrot_dataset": ("kernel_rbf", "rf_tabular", "lightgbm_tabular", STOP),
    "versatile_gb": ("versatile_gb", "parrot", STOP),
    "step_regression": ("parrot", STOP),
}
_AFTER_FILL = ("ZNormalization", "MeanAbsScaling", "FourierFeatures", *DETECTORS, "kernel_rbf", "rf_tabular", "lightgbm_tabular", "parrot", "parrot_dataset", "versatile_gb")
_AFTER_SCALE = ("FourierFeatures", *DETECTORS, "kernel_rbf", "rf_tabular", "lightgbm_tabular", "parrot", "parrot_dataset", "versatile_gb", "step_regression")
CORE |= {t: _AFTER_FILL for t in ("LinearFill", "ForwardFill")} | {t: _AFTER_SCALE for t in ("ZNormalization", "MeanAbsScaling")}
CORE |= {t: ("PeriodPhaseOneHot", "SeasonalFold", "SeasonalFeatures", "step_regression") for t in DETECTORS}
CORE |= {t: ("parrot", "parrot_dataset", STOP) for t in ("rf_tabular", "lightgbm_tabular")}
_FILLS, _SCALES = ("LinearFill", "ForwardFill"), ("ZNormalization", "MeanAbsScaling")
#: Edges of the three helper registries (fixed values).
HELPERS: dict[str, tuple[tuple[str, str], ...]] = {
    "affine": (*((d, "affine_fold") for d in DETECTORS), ("affine_fold", "affine_forecast"), ("affine_forecast", STOP)),
    "window_kernel": (*((t, "window_kernel") for t in (*_FILLS, *_SCALES, "FourierFeatures")), ("window_kernel", STOP)),
    "baselines": (*((t, b) for t in (*_FILLS, "FlairPreprocess", *_SCALES) for b in ("last_value", "zero")), ("last_value", STOP), ("zero", STOP)),
}


class Grammar:
    """Tokens and directed edges between them, START and STOP."""

    def __init__(self) -> None:
        self.tokens: dict[str, Token] = {}
        self.edges: dict[str, list[str]] = {START: []}

    def register(self, token: Token, follows: tuple[str, ...] = (), leads_to: tuple[str, ...] = ()) -> Grammar:
        """Adds a token and its edges; one of a known name replaces the instance, and edges accumulate."""
        self.tokens[token.name] = token
        for a, b in [*((f, token.name) for f in follows), *((token.name, t) for t in leads_to)]:
            if b not in self.edges.setdefault(a, []):
                self.edges[a].append(b)
        return self

    def valid_actions(self, state: State) -> list[str]:
        """What may come next and can be applied; STOP if nothing can."""
        last = state.sequence[-1] if state.sequence else START
        out = [n for n in self.edges.get(last, ()) if (state.predictions if n == STOP else n in self.tokens and self.tokens[n].can_apply(state))]
        return out or [STOP]

    @property
    def edge_list(self) -> list[tuple[str, str]]:
        return [(a, b) for a, ends in self.edges.items() for b in ends]

    def __repr__(self) -> str:
        return f"Grammar({len(self.tokens)} tokens, {len(self.edge_list)} edges)"


def build_grammar(affine: bool = False, window_kernel: bool = False, baselines: bool = False, presets: dict[str, dict] | None = None) -> Grammar:
    """The core registries' 23 tokens and 123 edges, with helper registries as asked. presets: constructor arguments by token."""
    grammar, wanted = Grammar(), {n for a, ends in CORE.items() for n in (a, *ends)}
    helpers = [HELPERS[n] for n, on in (("affine", affine), ("window_kernel", window_kernel), ("baselines", baselines)) if on]
    wanted |= {n for h in helpers for edge in h for n in edge}
    for name, kind in TOKENS.items():
        if name in wanted:
            grammar.register(kind(**(presets or {}).get(name, {})))
    for a, ends in CORE.items():
        for b in ends:
            grammar.edges.setdefault(a, []).append(b)
    for a, b in (edge for h in helpers for edge in h):
        grammar.edges.setdefault(a, []).append(b)
    return grammar


#: Arguments of the inspector, and of quick enumerations (fixed values).
INSPECTOR = {"FourierFeatures": {"n_harmonics": 8}, "rf_tabular": {"n_estimators": 80, "max_depth": 10}, "lightgbm_tabular": {"n_estimators": 160}, "window_kernel": {"gamma": "auto", "max_series": 32}, "FlairSamplePaths": {"n_paths": 50}, "versatile_gb": {"max_iter": 80}, "gb_level_forecast": {"max_iter": 80}}
QUICK = {"FourierFeatures": {"n_harmonics": 6}, "parrot_dataset": {"max_candidates": 1000}, "rf_tabular": {"n_estimators": 8}, "lightgbm_tabular": {"n_estimators": 8}, "versatile_gb": {"max_iter": 15}, "gb_level_forecast": {"max_iter": 15}}


def edges_df(spark: SparkSession, grammar: Grammar) -> DataFrame:
    return spark.createDataFrame(grammar.edge_list, "src string, dst string")


def nodes_df(spark: SparkSession, grammar: Grammar) -> DataFrame:
    rows = [(START, "boundary"), *((n, t.kind) for n, t in grammar.tokens.items()), (STOP, "boundary")]
    return spark.createDataFrame([(n, k, CLASS_ORDER.index(k)) for n, k in rows], "id string, class string, rank int")


def catalog_matrix(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each node: its parents and what may come next, in order, as text."""
    parents = edges.groupBy(F.col("dst").alias("id")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("src"))).alias("parents"))
    ahead = edges.groupBy(F.col("src").alias("id")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("dst"))).alias("next"))
    out = nodes.join(parents, "id", "left").join(ahead, "id", "left")
    return out.select("id", "class", F.coalesce("parents", F.lit("")).alias("parents"), F.coalesce("next", F.lit("")).alias("next"))


def unknown_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that edges use and no node has."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().join(nodes, "id", "left_anti")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def merged_edges(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def mermaid(grammar: Grammar) -> str:
    return "\n".join(["graph LR", *(f"    {a} --> {b}" for a, b in sorted(grammar.edge_list))])


def matrix_rows(grammar: Grammar) -> list[dict]:
    """A row for each node with what is known of it: id, status, class, core, parents, next, reads, writes and description."""
    parents: dict[str, list[str]] = {}
    for a, b in grammar.edge_list:
        parents.setdefault(b, []).append(a)
    core, out = {n for a, ends in CORE.items() for n in (a, *ends)}, []
    for name in [START, *grammar.tokens, STOP]:
        token = grammar.tokens.get(name)
        reads = [*token.reads, *(p.sem for p in token.requires)] if token else []
        out.append({
            "id": name, "status": "registered" if token else "synthetic", "class": token.kind if token else "boundary", "core": name in core, "parents": sorted(parents.get(name, ())), "next": sorted(grammar.edges.get(name, ())),
            "reads": reads, "writes": [p.sem for p in token.provides] if token else [], "description": " ".join((type(token).__doc__ or "").split()) if token else "",
        })
    return out


def graph_json(grammar: Grammar) -> str:
    return json.dumps({"tokens": matrix_rows(grammar), "edges": sorted(grammar.edge_list)}, indent=1)


def graph_html(grammar: Grammar, title: str = "Tokens") -> str:
    """The matrix as a table of its own, with links from each token to those before and after it."""
    link = lambda names: " ".join(f'<a href="#{html.escape(n)}">{html.escape(n)}</a>' for n in names)
    rows = "".join(f'<tr id="{html.escape(r["id"])}"><td>{html.escape(r["id"])}<td>{r["class"]}<td>{link(r["parents"])}<td>{link(r["next"])}<td>{html.escape(" ".join(r["reads"]))}<td>{html.escape(r["description"])}' for r in matrix_rows(grammar))
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr><th>token<th>class<th>after<th>before<th>reads<th>what it does{rows}</table>"

"""The whole forecasting run as one set of lazily connected tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from weekcast.functions.dates import on_grid
from weekcast.operators import backtest as B, evaluate as E, features as X, forecast as Y, moments as M, ridge as R
from weekcast.session import stage


class Analysis:
    """Tables of one run, each built on first access.

    Tables that several others read (panel, features, fits, cases, selection, calibration) are staged
    in the shared folder, so the source is scanned once and plans stay small. Walk forward, select on early validation, score the sealed test and forecast at the last week.
    ``panel`` is gap-filled and has ingredient_id, family_id, week_end, searches, rank, google_trend
    and amazon_provider. ``with_ridge=False`` evaluates the two baselines only.
    """

    TABLES = (
        "training_audit",
        "fits",
        "backtests",
        "summary",
        "ablations",
        "selection_comparison",
        "selected",
        "calibration",
        "sealed_audit",
        "forecasts",
        "displayed",
        "diagnostics",
    )

    def __init__(self, panel: DataFrame, with_ridge: bool = True):
        self.source = panel
        self.with_ridge = with_ridge

    @cached_property
    def panel(self) -> DataFrame:
        return stage(self.source, "panel")

    @cached_property
    def bounds(self) -> DataFrame:
        return stage(B.panel_bounds(self.panel), "bounds")

    @cached_property
    def features(self) -> DataFrame:
        """Weekly features where a later step looks: eligible rows on the grid, and the as-of week."""
        as_of = self.bounds.select("as_of").scalar()
        needed = (F.col("eligible") & on_grid(F.col("origin"))) | (F.col("origin") == as_of)
        return stage(X.weekly_features(self.panel).filter(needed), "features")

    @cached_property
    def samples(self) -> DataFrame:
        return X.samples(self.features)

    @cached_property
    def origins(self) -> DataFrame:
        return B.evaluation_origins(self.bounds)

    @cached_property
    def training(self) -> DataFrame:
        deploy = self.bounds.select(F.lit("deploy").alias("scope"), F.col("as_of").alias("origin"))
        wanted = self.origins.select(F.lit("backtest").alias("scope"), "origin").unionByName(deploy)
        return M.training_sets(self.samples, wanted)

    @cached_property
    def training_audit(self) -> DataFrame:
        return M.training_audit(self.training)

    @cached_property
    def fits(self) -> DataFrame:
        if not self.with_ridge:
            return self.panel.sparkSession.createDataFrame([], R.FIT_SCHEMA)
        return stage(R.fit_ridge(self.training), "fits")

    @cached_property
    def wide(self) -> DataFrame:
        if not self.with_ridge:
            return stage(B.naive_walk_forward(self.samples, self.origins), "cases")
        return stage(B.walk_forward(self.samples, self.origins, self.fits), "cases")

    @cached_property
    def long(self) -> DataFrame:
        return B.to_long(self.wide)

    @cached_property
    def selection_comparison(self) -> DataFrame:
        return stage(E.selection_comparison(self.wide), "selection")

    @cached_property
    def selected(self) -> DataFrame:
        return E.select_models(self.selection_comparison)

    @cached_property
    def calibration(self) -> DataFrame:
        return stage(E.calibration(self.long), "calibration")

    @cached_property
    def backtests(self) -> DataFrame:
        return E.with_intervals(self.long, self.calibration)

    @cached_property
    def summary(self) -> DataFrame:
        return E.metric_summary(self.backtests)

    @cached_property
    def ablations(self) -> DataFrame:
        return E.ablations(self.wide)

    @cached_property
    def sealed_audit(self) -> DataFrame:
        return E.sealed_audit(self.wide, self.selected)

    @cached_property
    def plain_forecasts(self) -> DataFrame:
        return Y.forecasts(self.panel, self.features, self.bounds, self.fits, self.selected, self.calibration)

    @cached_property
    def forecasts(self) -> DataFrame:
        return Y.decision_flags(self.plain_forecasts, self.sealed_audit)

    @cached_property
    def displayed(self) -> DataFrame:
        return Y.displayed_backtests(self.wide, self.selected)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return Y.ingredient_diagnostics(self.panel, self.features, self.bounds)

    def warnings(self, report_as_of: Column) -> DataFrame:
        return Y.analysis_warnings(self.panel, self.wide, self.sealed_audit, report_as_of)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}


def run_analysis(panel: DataFrame, with_ridge: bool = True) -> Analysis:
    return Analysis(panel, with_ridge)

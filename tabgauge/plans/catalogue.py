"""All registered queries; importing this module registers them."""

from __future__ import annotations

import importlib

from tabgauge.plans.registry import ORACLES, QUERIES, callables

for _area in ("data_queries", "score_queries", "result_queries", "suite_queries", "trial_queries"):
    importlib.import_module(f"tabgauge.plans.{_area}")

flagship = QUERIES["incumbent_metric_table"]

__all__ = ["ORACLES", "QUERIES", "callables", "flagship"]

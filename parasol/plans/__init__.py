"""Every registered query. Importing the modules fills the registry."""

import importlib

from parasol.plans.registry import ORACLES, QUERIES

for _module in (
    "rollup_queries",
    "document_queries",
    "function_queries",
    "signal_queries",
    "dashboard_queries",
    "pricing_queries",
    "fraud_queries",
    "source_queries",
    "warehouse_queries",
    "stream_queries",
    "model_queries",
    "extension_queries",
    "keyed_queries",
):
    importlib.import_module(f"parasol.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries, one module per family."""

from importlib import import_module

FAMILIES = (
    "cleaning_queries",
    "feature_queries",
    "window_queries",
    "binning_queries",
    "metric_queries",
    "calibration_queries",
    "model_queries",
    "attribution_queries",
)


def load():
    """Import every family and return the filled catalog."""
    for name in FAMILIES:
        import_module(f"creditloom.plans.{name}")
    return import_module("creditloom.plans.catalog")

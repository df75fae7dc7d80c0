"""All registered queries."""

from tocsin.plans import catalog_features, catalog_metrics, catalog_records, catalog_reports, catalog_thresholds  # noqa: F401
from tocsin.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

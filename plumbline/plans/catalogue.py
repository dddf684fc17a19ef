"""All registered queries."""

from plumbline.plans import (  # noqa: F401
    catalogue_asset_audit, catalogue_assets, catalogue_drift, catalogue_quality, catalogue_reports, catalogue_scoring, catalogue_sources, catalogue_streaming, catalogue_validity)
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rollout_queries", "trajectory_queries", "sampling_queries", "catalog_queries", "scoring_queries", "text_queries", "curation_queries", "report_queries", "check_queries", "spec_queries", "submission_queries", "grounding_queries", "audit_queries", "gate_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, (f, _) in import_module(f"waymill.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in import_module(f"waymill.plans.{m}").QUERIES.items() if s}

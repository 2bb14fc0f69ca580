"""All registered queries of the scene operators, with the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scenegrid.plans import queries_contours, queries_detail, queries_exact, queries_geometry, queries_layout, queries_native, queries_paths, queries_relations, queries_rules, queries_sources  # noqa: F401  (they register themselves)
from scenegrid.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve a scene and audit it: see ``resolve_and_audit``."""
    return QUERIES["resolve_and_audit"](spark, sf_dir)

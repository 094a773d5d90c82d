"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import engines, further, groups, matching, records, reports, scalars, spelling  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracles() -> dict[str, str]:
    return ORACLES

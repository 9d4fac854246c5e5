"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, retrieval, studies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | evaluation.QUERIES | studies.QUERIES
ORACLES: dict[str, str] = retrieval.ORACLES | evaluation.ORACLES | studies.ORACLES

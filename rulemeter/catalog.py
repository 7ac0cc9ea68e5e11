"""Named queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, channels, exam, fitted, programs, rollups, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**analytics.QUERIES, **exam.QUERIES, **rollups.QUERIES, **programs.QUERIES, **fitted.QUERIES, **channels.QUERIES, **transcripts.QUERIES}
ORACLES: dict[str, str] = {**analytics.ORACLES, **exam.ORACLES, **rollups.ORACLES, **programs.ORACLES, **fitted.ORACLES, **channels.ORACLES, **transcripts.ORACLES}

"""Structured Streaming forms of the hourly jobs."""

from tallyframe.streaming.coverage import coverage_stream, start_coverage
from tallyframe.streaming.ingest import history_stream, rows_too_late, start_ingest, unique_prints

__all__ = ["coverage_stream", "history_stream", "rows_too_late", "start_coverage", "start_ingest", "unique_prints"]

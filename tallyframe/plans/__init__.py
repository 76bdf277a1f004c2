"""Whole jobs: ingest, recompute and sync, and the registry of named queries."""

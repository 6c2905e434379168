"""Marketplace listings on Spark: ingest, reports, quality, enrichment, retention."""

__version__ = "0.1.0"

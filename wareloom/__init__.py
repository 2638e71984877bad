"""Catalogue analytics on PySpark: link identity, extraction, enrichment, ledger and export operators."""

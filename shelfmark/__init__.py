"""Catalog analytics on Spark: indexing, linkage, duplicate graphs, enrichment and change feeds."""

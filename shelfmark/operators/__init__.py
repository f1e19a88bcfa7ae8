"""Catalog operators: tables in, tables out."""

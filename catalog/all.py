"""Imports every section, which registers its queries."""

from catalog import aggregates, ingest, relations, scoring, search, streams, text, vectors  # noqa: F401

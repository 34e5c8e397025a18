"""Readers and writers: driver tables, CSV/JSON postings, registry, taxonomy."""

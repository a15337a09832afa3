"""Queries that apply every operator to documents built from the tables, and the SQL that computes the same without JSON."""

from docweave.queries import collections, edits, expressions, reading, shaping, streams
from docweave.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "collections", "edits", "expressions", "reading", "shaping", "streams"]

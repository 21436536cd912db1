"""Ids made of hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_id(size: int, *parts: Column) -> Column:
    """The first hex digits of SHA-256 of the parts, joined by a pipe; a missing part reads None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, size)


def seed_id(date: Column, hint: Column, page: Column, subdoc: Column, snippet: Column, path: Column) -> Column:
    return hash_id(16, date, hint, page, subdoc, snippet, path)


def event_id(event_type: Column, date: Column, page: Column, document: Column, seed: Column) -> Column:
    return hash_id(20, event_type, date, page, document, seed)

"""The site of a page and the keys of its lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column, source: Column) -> Column:
    """The url's host without leading www., m. or amp.; without a host the source, lower-cased and with single spaces; else ''."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#\s]+)", 1)
    host = F.regexp_replace(host, r"^(?:(?:www|m|amp)\.)+", "")
    named = F.trim(F.regexp_replace(F.lower(source), r"\s+", " "))
    return F.coalesce(F.when(host != "", host), named, F.lit(""))


def line_keys(body: Column) -> Column:
    """One string per line of body: its letters in order, lower-cased; '' for a line without letters. Null for a null body."""
    return F.split(F.regexp_replace(F.lower(body), r"[^\p{L}\n]+", ""), "\n", -1)

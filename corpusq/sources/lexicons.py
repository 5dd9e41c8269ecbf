"""Reading a lexicon file: a mapping with ``entries``, or a bare list of them."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import schema
from ..operators.lexicon import Entry, entries
from .markdown import yaml_loader


def load(path: str) -> tuple[list[Entry], str]:
    """Entries and the SHA-256 of the file's bytes."""
    data = Path(path).read_bytes()
    raw = yaml_loader()(data.decode())
    return entries(raw.get("entries") or [] if isinstance(raw, dict) else raw or []), hashlib.sha256(data).hexdigest()


def to_table(spark: SparkSession, lexicon: list[Entry]) -> DataFrame:
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in (e.id, e.canonical, e.aliases, e.expansions, e.source_urls, e.confidence, e.review_status, e.note)) for e in lexicon], schema.LEXICON)

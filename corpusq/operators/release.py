"""Release checks: where files may lie, where a document came from, and what a release manifest promises."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank, is_digest, text_hash, trim
from ..sources.generation import json_digest
from . import quality
from .quality import rule, strict_json

SCHEMA_VERSION = 2
# Fields of a source request, and what each endpoint asks for.
REQUEST_FIELDS = ("endpoint", "bookid", "noformyn", "statehistoryid", "BBSID", "Menuid", "source_content_hash")
ENDPOINTS = {
    "/out/regulation/regulationViewPop.do": ("rule", {"bookid", "noformyn"}, {"BBSID", "Menuid"}),
    "/out/pds/pdsViewPop.do": ("notice", {"BBSID", "Menuid"}, {"bookid", "noformyn", "statehistoryid"}),
}
#: Keys of operation, not of content, at any depth of a manifest.
VOLATILE = ("release_hash", "generated_at", "refresh", "cookie", "cookies", "csrf", "_csrf", "x-csrf-token", "authorization")


def path_rules(path: Column, folder: Column, sub: str) -> list[Column]:
    """A path relative to the data root must name something inside a document's ``folder/sub`` (folder relative, too)."""
    p, given = F.coalesce(path, F.lit("")), ~blank(path)
    clean = F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), "/+", "/")
    return [
        rule(given & p.startswith("/"), "absolute_path"),
        rule(given & p.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "parent_traversal"),
        rule(given & ~clean.startswith(F.concat(folder, F.lit(f"/{sub}/"))), "path_outside_document"),
    ]


def linked_paths(root: str) -> list[str]:
    """Symbolic links and special files under a data root; a corpus may hold neither. A listing of the driver."""
    found, waiting = [], [root]
    while waiting:
        with os.scandir(waiting.pop()) as entries:
            for e in entries:
                if e.is_symlink() or not (e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)):
                    found.append(e.path)
                elif e.is_dir(follow_symlinks=False):
                    waiting.append(e.path)
    return sorted(found)


def request_fault(text: str | None, document_type: str | None) -> str:
    """Why a source request cannot stand for a document of this type; empty if it can."""
    if fault := strict_json(text):
        return fault
    raw = json.loads(text)
    if unknown := set(raw) - set(REQUEST_FIELDS):
        return f"unknown_field: {min(unknown)}"
    if not all(isinstance(v, str) and len(v.strip().encode()) <= 4096 and not set("\0\r\n") & set(v.strip()) for v in raw.values()):
        return "invalid_value"
    given = {k for k, v in raw.items() if v.strip()}
    digest = raw.get("source_content_hash", "").strip()
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        return "invalid_source_content_hash"
    kind, needed, barred = ENDPOINTS.get(raw.get("endpoint", "").strip(), ("", set(), set()))
    if not kind:
        return "unsupported_endpoint"
    return "" if kind == document_type and needed <= given and not barred & given else "request_does_not_fit_document"


def request_faults(text: Column, document_type: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in batches:
            yield pd.Series([request_fault(t, k) for t, k in zip(texts, kinds)], dtype=object)

    return run(text, document_type)


def provenance_rules() -> list[Column]:
    """Over documents joined with their source files: source_text (or null), request_text (or null)."""
    names = ("source_content_hash", "source_content_path", "source_request_path")
    given = [~blank(n) for n in names]
    some, whole = given[0] | given[1] | given[2], given[0] & given[1] & given[2]
    fault = request_faults(F.col("request_text"), F.col("document_type"))
    return [
        rule(some & ~whole, "provenance_incomplete"),
        rule(whole & ~is_digest("source_content_hash"), "invalid_source_content_hash"),
        rule(whole & F.col("source_text").isNull(), "source_content_missing"),
        rule(whole & F.col("source_text").isNotNull() & (text_hash("source_text") != trim("source_content_hash")), "source_content_hash_mismatch"),
        F.when(whole & (fault != ""), fault),
        rule(whole & (fault == "") & (F.get_json_object("request_text", "$.source_content_hash") != trim("source_content_hash")), "request_hash_differs"),
    ]


def manifest_tables(spark: SparkSession, payload: dict) -> tuple[DataFrame, DataFrame]:
    """(documents(path, digest, schema_version), allowed(id)) of a manifest. Raises for a shape that is no manifest."""
    profile = payload.get("release_profile")
    if payload.get("schema_version") != SCHEMA_VERSION or not isinstance(payload.get("documents"), list):
        raise ValueError("unsupported manifest")
    if not isinstance(profile, dict) or profile.get("version") != 1 or profile.get("default") != "strict" or not isinstance(profile.get("allowed_failure_ids"), list):
        raise ValueError("strict release profile required")
    allowed = profile["allowed_failure_ids"]
    if not all(isinstance(x, str) and x and x == x.strip() for x in allowed) or len(set(allowed)) < len(allowed):
        raise ValueError("allowed failures must be distinct ids")
    rows = []
    for item in payload["documents"]:
        path = os.path.normpath(str(item.get("path") or "").strip()) if isinstance(item, dict) else "."
        if path == "." or path.startswith(("/", "../")) or path == "..":
            raise ValueError("a manifest document has no valid path")
        rows.append((path, json_digest({k: v for k, v in item.items() if k != "path"}, VOLATILE), item.get("schema_version")))
    return spark.createDataFrame(rows, "path string, digest string, schema_version int"), spark.createDataFrame([(x,) for x in allowed], "id string")


def manifest_violations(listed: DataFrame, on_disk: DataFrame, allowed: DataFrame, attachments: DataFrame) -> DataFrame:
    """(key, code): documents of a manifest against those on disk, by path and digest, and failures against the allow-list."""
    found = quality.parity(listed, on_disk, "path", "digest").select("key", F.when(F.col("code") == "differs", "manifest_metadata_mismatch").otherwise(F.col("code")).alias("code"))
    found = found.union(quality.duplicates(listed, "path", "duplicate_path").select(F.col("id").alias("key"), "code"))
    found = found.union(listed.where(~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION))).select(F.col("path").alias("key"), F.lit("unsupported_schema_version")))
    found = found.union(quality.allow_list(attachments, allowed).select(F.col("id").alias("key"), "code"))
    loose = attachments.join(allowed, "id", "left_semi").where((F.coalesce("preservation_status", F.lit("")) != "preserved") | F.coalesce("searchable", F.lit(True)))
    return found.union(loose.select(F.col("id").alias("key"), F.lit("allowed_failure_not_preserved")))


def release_digest(payload: dict) -> str:
    """The manifest's own digest, over everything but keys of operation."""
    return json_digest(payload, VOLATILE)

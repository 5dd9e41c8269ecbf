"""Reading a corpus of Markdown documents with YAML front matter."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import canonical

#: Largest document and attachment text in bytes.
DOCUMENT_BYTES, ATTACHMENT_BYTES = 16 << 20, 64 << 20
PLACES = tuple((lang, kind) for lang in schema.LANGUAGES for kind in ("rules", "notices"))


def yaml_loader():
    """The YAML parser if there is one, else a small reader of the subset that front matter uses."""
    try:
        import yaml

        return yaml.safe_load
    except ImportError:
        return simple_yaml


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        body = text[1:-1]
        return body.replace("''", "'") if text[0] == "'" else body.encode().decode("unicode_escape").encode("latin-1", "ignore").decode("utf-8", "ignore") if "\\" in body else body
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text == "{}":
        return {}
    return int(text) if text.lstrip("-").isdigit() and (text == "0" or not text.lstrip("-").startswith("0")) else text


def simple_yaml(text: str):
    """Nested mappings and lists by indentation, scalars, quotes and inline lists; anything else is an error."""
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#")]
    at = 0

    def node(indent: int):
        nonlocal at
        if at >= len(rows) or rows[at][0] < indent:
            return None
        here, is_list = rows[at][0], rows[at][1].startswith("- ") or rows[at][1] == "-"
        out: list | dict = [] if is_list else {}
        while at < len(rows) and rows[at][0] == here and (rows[at][1].startswith("- ") or rows[at][1] == "-") == is_list:
            line = rows[at][1]
            if is_list:
                rest = line[1:].strip()
                if rest and (": " in rest or rest.endswith(":")) and rest[0] not in "\"'[":
                    rows[at] = (here + len(line) - len(line[1:].lstrip()), rest)
                    out.append(node(here + 1))
                else:
                    at += 1
                    out.append(_scalar(rest) if rest else node(here + 1))
            else:
                key, mark, rest = line.partition(":")
                if not mark:
                    raise ValueError(f"no mapping: {line!r}")
                at += 1
                nested = not rest.strip() and at < len(rows) and (rows[at][0] > here or (rows[at][0] == here and rows[at][1].startswith("-")))
                out[str(_scalar(key))] = node(rows[at][0]) if nested else _scalar(rest)
        return out

    value = node(0)
    if at < len(rows):
        raise ValueError(f"bad indentation: {rows[at][1]!r}")
    return value


def split_front_matter(text: str) -> tuple[str, str]:
    text = text.replace("\r\n", "\n")
    if not text.startswith("---\n") or "\n---" not in text[3:]:
        raise ValueError("front matter missing")
    head, _, body = text[4:].partition("\n---")
    return head, body.lstrip("-").lstrip("\n")


def _fit(value, kind):
    """A YAML value as the schema's type; nulls where it does not fit a list or a struct."""
    name = kind.typeName()
    if value is None:
        return None
    if name == "struct":
        return {f.name: _fit(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if name == "array":
        return [_fit(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if name in ("integer", "long"):
        return int(value)
    if name == "boolean":
        return bool(value)
    if name == "timestamp":
        return pd.Timestamp(value).tz_convert("UTC").tz_localize(None).to_pydatetime() if pd.Timestamp(value).tzinfo else pd.Timestamp(value).to_pydatetime()
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else str(value)


def parse(text: str, path: str) -> dict:
    """One document's columns. Raises ValueError for what cannot be read."""
    head, body = split_front_matter(text)
    raw = yaml_loader()(head) or {}
    if not isinstance(raw, dict):
        raise ValueError("front matter is no mapping")
    out = {f.name: _fit(raw.get(f.name), f.dataType) for f in schema.DOCUMENT}
    for name in ("id", "title", "document_type"):
        if not (out[name] or "").strip():
            raise ValueError(f"{name} is required")
    out["language"] = out["language"] or "ko"
    if out["document_type"] not in schema.DOCUMENT_TYPES or out["language"] not in schema.LANGUAGES:
        raise ValueError("unknown document type or language")
    for asset in [*(out["assets"] or []), *(a for t in out["attachments"] or [] for a in t["assets"] or [])]:
        asset["reference_path"] = asset["reference_path"] or asset["path"]
    return out | {"body": body, "path": path, "assets": out["assets"] or [], "attachments": out["attachments"] or [], "quality_codes": out["quality_codes"] or []}


def document_paths(root: str) -> list[str]:
    """Patterns of the four places of documents, in order."""
    return [f"{root}/{lang}/{kind}/*/index.md" for lang, kind in PLACES]


def read_documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_ord, faults(path, code)) of a corpus folder; files are read and parsed on executors."""
    patterns = [p for p in document_paths(root) if list(Path(root).glob(p[len(root) + 1 :]))]
    if not patterns:
        raise ValueError(f"no documents under {root}")
    files = spark.read.format("binaryFile").load(patterns).select("path", "length", "content")
    place = F.concat(*[F.when(F.contains("path", F.lit(f"/{lang}/{kind}/")), str(i)).otherwise("") for i, (lang, kind) in enumerate(PLACES)])
    out_schema = "path string, fault string, doc " + schema.DOCUMENT.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, length, content in zip(pdf.path, pdf.length, pdf.content):
                fault, doc = "", None
                try:
                    if length > DOCUMENT_BYTES:
                        raise ValueError("too large")
                    doc = parse(bytes(content).decode("utf-8"), path)
                except (ValueError, TypeError) as e:
                    fault = str(e) or "unreadable"
                rows.append((path, fault, doc))
            yield pd.DataFrame(rows, columns=["path", "fault", "doc"])

    read = files.mapInPandas(run, out_schema).withColumn("place", place)
    docs = read.where("fault = ''").select("doc.*", "place").withColumn("body", canonical("body"))
    folder = F.element_at(F.split("path", "/"), -3)
    kind = F.when(F.col("document_type") == "notice", "notices").otherwise("rules")
    faults = read.where("fault <> ''").select("path", F.concat(F.lit("unreadable: "), "fault").alias("code"))
    misplaced = docs.where((folder != kind) | (F.element_at(F.split("path", "/"), -4) != F.col("language")))
    faults = faults.union(misplaced.select("path", F.lit("place_differs_from_front_matter")))
    twice = docs.groupBy("id").agg(F.count("*").alias("n"), F.max("path").alias("path")).where("n > 1")
    faults = faults.union(twice.select("path", F.lit("duplicate_document_id")))
    # ids are hashed to places in the global order that do not depend on partitions
    ordered = docs.withColumn("doc_ord", F.conv(F.concat("place", F.substring(F.sha2("path", 256), 1, 9)), 16, 10).cast("long")).drop("place")
    return ordered, faults


def read_texts(spark: SparkSession, root: str, docs: DataFrame) -> DataFrame:
    """(attachment_id, text) of converted attachments, from their text files under each document's folder."""
    # text paths are relative to the root and must lie in their document's attachments folder
    base, folder = F.regexp_replace("path", "(/[^/]+){3}/index\\.md$", ""), F.regexp_replace("path", "/[^/]*$", "")
    wanted = docs.select(base.alias("base"), folder.alias("folder"), F.explode("attachments").alias("a")).where("coalesce(a.text_path, '') <> ''")
    wanted = wanted.select(F.col("a.id").alias("attachment_id"), F.concat_ws("/", "base", "a.text_path").alias("path"), "folder").where(F.col("path").startswith(F.concat("folder", F.lit("/attachments/")))).drop("folder")
    patterns = [p.replace("/index.md", "/attachments/*") for p in document_paths(root)]
    patterns = [p for p in patterns if list(Path(root).glob(p[len(root) + 1 :]))]
    if not patterns:
        return spark.createDataFrame([], "attachment_id string, text string")
    files = spark.read.format("binaryFile").load(patterns).where(F.col("length") <= ATTACHMENT_BYTES).select("path", "content")
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    return wanted.join(valid, "path").select("attachment_id", canonical(F.decode("content", "UTF-8")).alias("text"))


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, attachment texts) of a corpus that must have no fault."""
    docs, faults = read_documents(spark, root)
    if bad := faults.head(1):
        raise ValueError(f"{bad[0].path}: {bad[0].code}")
    return docs, read_texts(spark, root, docs)

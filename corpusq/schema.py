"""Table schemas. Tri-state flags are nullable booleans; their defaults differ by entity (see functions.entities)."""

from pyspark.sql.types import ArrayType, BooleanType, DataType, FloatType, IntegerType, LongType, StringType, StructType, TimestampType

_KINDS: dict[str, DataType] = {
    "STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(), "BOOLEAN": BooleanType(), "TIMESTAMP": TimestampType(),
    "STRINGS": ArrayType(StringType()), "FLOATS": ArrayType(FloatType()),
}


def _struct(fields: str, **nested: DataType) -> StructType:
    """Names and kinds in pairs; parsing DDL would need a session when the module is imported."""
    out = StructType()
    for pair in fields.split(", "):
        name, kind = pair.split()
        out = out.add(name, nested.get(kind) or _KINDS[kind])
    return out


ASSET = _struct(
    "id STRING, source_kind STRING, source_anchor STRING, source_url STRING, path STRING, mime_type STRING, raw_file_hash STRING, "
    "size BIGINT, width BIGINT, height BIGINT, preservation_status STRING, searchable BOOLEAN, quality_codes STRINGS, error STRING, reference_path STRING"
)
ATTACHMENT = _struct(
    "id STRING, title STRING, file_name STRING, mime_type STRING, source_url STRING, server_file STRING, folder STRING, raw_path STRING, text_path STRING, "
    "content_hash STRING, raw_file_hash STRING, converted_text_hash STRING, conversion_status STRING, preservation_status STRING, searchable BOOLEAN, "
    "status STRING, error STRING, size BIGINT, quality_status STRING, quality_score INT, quality_flags STRING, quality_codes STRINGS, assets ASSETS, "
    "converted_text_chars BIGINT, converted_non_space_chars BIGINT, table_row_count BIGINT, formula_block_count BIGINT, formula_hint_count BIGINT, replacement_char_count BIGINT",
    ASSETS=ArrayType(ASSET),
)
SOURCE_REQUEST = _struct("endpoint STRING, bookid STRING, noformyn STRING, statehistoryid STRING, bbsid STRING, menuid STRING, source_content_hash STRING")
DOCUMENT = _struct(
    "schema_version INT, id STRING, title STRING, category STRING, source_url STRING, source_content_hash STRING, source_content_path STRING, source_request_path STRING, "
    "source_request REQUEST, effective_date STRING, published_date STRING, collected_at TIMESTAMP, content_hash STRING, body_hash STRING, conversion_status STRING, "
    "preservation_status STRING, searchable BOOLEAN, quality_status STRING, quality_codes STRINGS, language STRING, source_id STRING, file_name STRING, raw_path STRING, "
    "text_path STRING, file_content_hash STRING, raw_file_hash STRING, assets ASSETS, attachments ATTACHMENTS, document_type STRING, body STRING, path STRING",
    REQUEST=SOURCE_REQUEST, ASSETS=ArrayType(ASSET), ATTACHMENTS=ArrayType(ATTACHMENT),
)
CHUNK = _struct(
    "chunk_id STRING, doc_id STRING, idx INT, text STRING, source STRING, attachment_id STRING, attachment_title STRING, attachment_file STRING, "
    "attachment_status STRING, article_id STRING, heading_path STRINGS, ord BIGINT"
)
POSTING = _struct("token STRING, chunk_id STRING, doc_id STRING, ord BIGINT, tf BIGINT, n_tokens BIGINT")
VECTOR = _struct("chunk_id STRING, vector FLOATS")
LEXICON = _struct("id STRING, canonical STRING, aliases STRINGS, expansions STRINGS, source_urls STRINGS, confidence STRING, review_status STRING, note STRING")
#: Document types, languages and statuses: fixed values.
DOCUMENT_TYPES = ("rule", "notice")
LANGUAGES = ("ko", "en")
CONVERSION = ("pending", "converted", "failed")
PRESERVATION = ("preserved", "missing", "failed")
QUALITY = ("ok", "warn", "fail")

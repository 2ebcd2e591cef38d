"""Explicit schemas of the stored tables, and configuration fingerprints."""

from __future__ import annotations

import dataclasses
import hashlib
import json

SCHEMA_VERSION = 1
PARSER_VERSION = "0.3.0"
CHUNKER_VERSION = "0.1.0"

BLOCK = (
    "doc_id string, ordinal int, id string, text string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, is_bold boolean, "
    "role string, heading_level int, block_type string, section_number string, scope string, breadcrumb array<string>"
)
PAGE = "doc_id string, number int, width double, height double, hlines array<struct<y:double,x0:double,x1:double>>"
CHUNK = (
    "id string, doc_id string, chunk_index int, embed_text string, header string, text string, token_count int, scope string, section_path array<string>, "
    "sections array<string>, page_start int, page_end int, block_ids array<string>"
)
GOLDEN = (
    "id string, question string, lang string, type string, gold array<struct<doc_id:string,scope:string,section:string,page:int>>, answer string, source string, "
    "status string, notes string"
)
MANIFEST = "doc_id string, schema_version int, logic_version string, config string, source_sha256 string, rows long, created_at timestamp"
LABEL = "id string, answer_hash string, verdict string, overstated boolean, missing_condition boolean, notes string"


def canonical(config: object) -> str:
    """A configuration as JSON with sorted keys, the form that manifests store and compare."""
    value = dataclasses.asdict(config) if dataclasses.is_dataclass(config) else config
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=list)


def fingerprint(config: object) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()

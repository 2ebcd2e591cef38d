"""The pN queries over the tables of a data folder, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.leaks import find_leaks, leaked_pairs
from quillspark.llm.mixing import mixed_documents, mixing_report
from quillspark.llm.overlap import found_pairs, overlap_report
from quillspark.llm.packing import chunk_windows
from quillspark.llm.pieces import chunk_and_block_pieces, oversized_ids, piece_check
from quillspark.llm.quality import document_kinds, not_prose
from quillspark.llm.replies import defects
from quillspark.llm.sentences import body_sentence_ends
from quillspark.session import table

_TOKENS = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{0E00}-\x{0E7F}]|[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{0E00}-\x{0E7F}\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: found_pairs(table(s, d, "golden")),
        "p1_report": lambda s, d: overlap_report(table(s, d, "golden")),
        "p2_found": lambda s, d: oversized_ids(table(s, d, "chunks"), table(s, d, "blocks")),
        "p2_pieces": lambda s, d: chunk_and_block_pieces(table(s, d, "chunks"), table(s, d, "blocks")),
        "p2_check": lambda s, d: piece_check(table(s, d, "chunks"), table(s, d, "blocks")),
        "p3_windows": lambda s, d: chunk_windows(table(s, d, "chunks")),
        "p4_found": lambda s, d: defects(table(s, d, "gen_results")),
        "p5_found": lambda s, d: body_sentence_ends(table(s, d, "blocks")),
        "p6_found": lambda s, d: leaked_pairs(table(s, d, "documents"), table(s, d, "heldout_items")),
        "p6_stretches": lambda s, d: find_leaks(table(s, d, "documents"), table(s, d, "heldout_items")),
        "p7_mixture": lambda s, d: mixed_documents(table(s, d, "documents"), table(s, d, "source_targets")),
        "p7_shares": lambda s, d: mixing_report(table(s, d, "documents"), table(s, d, "source_targets")),
        "p8_found": lambda s, d: not_prose(table(s, d, "documents")),
        "p8_statistics": lambda s, d: document_kinds(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
            SELECT DISTINCT id FROM (SELECT id, text FROM chunks UNION ALL SELECT id, text FROM blocks)
            WHERE len(regexp_extract_all(text, '{_TOKENS}')) > 512""",
        "p2_check": f"""
            SELECT id, len(regexp_extract_all(text, '{_TOKENS}')) AS tokens, TRUE AS within, md5(text) AS restored
            FROM (SELECT DISTINCT id, text FROM (SELECT id, text FROM chunks UNION ALL SELECT id, text FROM blocks))
            WHERE len(regexp_extract_all(text, '{_TOKENS}')) > 512""",
    }

"""Cutting oversized items at natural boundaries by packing a structure tree.

A text is parsed into a tree: headings own what follows them down to the next one of their depth, list entries own what
is indented or numbered under them, then come paragraphs, lines, sentences, clauses, words and characters. Sibling
subtrees are merged bottom-up while they fit, and only a node over the limit is opened. Counting happens in the JVM;
Python sees oversized texts only.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS = 512
OVERLAP_TOKENS = 32

# The scripts counted by character, as a character class body for Java and Python alike.
_BY_CHARACTER = "\\u3040-\\u30FF\\u3400-\\u9FFF\\u0E00-\\u0E7F"
# Unicode white space.
_WHITE = "\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
TOKEN_PATTERN = f"[{_BY_CHARACTER}]|[^{_BY_CHARACTER}{_WHITE}]+"
_TOKEN = re.compile(TOKEN_PATTERN)

#: A line that opens a subtree: a marked heading, a number of one or more parts, a letter in brackets, or a bullet.
_OPENER = re.compile(
    r"^(?P<indent>[^\S\n]*)(?:(?P<marks>#{1,6})[^\S\n]+|(?P<number>\d+(?:\.\d+)*)[.)]?[^\S\n]+(?=\S)|(?P<letter>\([a-z0-9]{1,4}\))[^\S\n]+|(?P<bullet>[-*•·–—])[^\S\n]+)",
    re.MULTILINE,
)
_HEADING_CHARS = 120

#: Boundaries below the structure, from the coarsest to the finest; the first three never leave a heading behind.
_LEVELS = tuple(
    re.compile(p)
    for p in (
        r"\n[^\S\n]*\n+",  # paragraphs
        r"\n",  # lines
        r"(?:(?<=[.!?…؟][\"'”»)\]])|(?<=[.!?…؟।]))\s+(?=[^\sa-zа-яà-ÿ])|(?<=[。！？」』])(?![。！？」』])|(?<=[฀-๿])\s+(?=[฀-๿])",  # sentences
        r"(?<=[;:；：])\s*",  # clauses
        r"(?<=[,，、])\s*",
        r"\s+",  # words
        r"(?<=[぀-ヿ㐀-鿿฀-๿])(?=.)",  # characters of scripts without blanks
    )
)
_WHOLE_HEADINGS = 3


def token_count(text: Column) -> Column:
    """Tokens of a text: each character of the scripts without blanks, each longest run of other non-blank characters.

    Null for a null text, 0 for an empty or blank one.
    """
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def _openers(text: str) -> list[tuple[int, tuple, bool]]:
    """``(place, depth, bare)`` of each line that opens a subtree; ``bare`` ones are headings without text of their own.

    Depths compare as tuples: marked headings by their marks, then numbers by their parts, then letters, then bullets,
    each by indentation. So a section owns its sub-sections, and a list entry the entries indented under it.
    """
    out = []
    for m in _OPENER.finditer(text):
        end = text.find("\n", m.end())
        line = text[m.end() : end if end >= 0 else len(text)].strip()
        indent = len(m["indent"].expandtabs(4))
        if m["marks"]:
            out.append((m.start(), (0, len(m["marks"]), 0), True))
        elif m["number"]:
            bare = len(line) <= _HEADING_CHARS and not re.search(r"[.;:,!?。！？；：]$", line)
            out.append((m.start(), (1, indent, m["number"].count(".")), bare))
        else:
            out.append((m.start(), (2 if m["letter"] else 3, indent, 0), False))
    return out


def piece_spans(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int, int]]:
    """``(from, own, to)`` per piece: ``text[own:to]`` is new, ``text[from:own]`` repeats the end of the piece before.

    The new parts joined give the text. No piece is over the limit unless a single token is. The overlap is exactly
    ``overlap`` tokens wherever the piece before has as many.
    """
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= limit:
        return [(0, 0, len(text))]
    overlap = max(0, min(overlap, limit // 2))
    room = limit - overlap
    begins = [a for a, _ in spans]
    count = lambda a, b: bisect.bisect_left(begins, b) - bisect.bisect_left(begins, a)
    openers = _openers(text)
    places = [at for at, _, _ in openers]
    depths = sorted({d for _, d, _ in openers})
    # the end of each heading line without text of its own
    heads = {at: text.find("\n", at) + 1 or len(text) for at, _, bare in openers if bare}

    def only_headings(a: int, b: int) -> bool:
        while a < b and a in heads:
            a = heads[a]
            while a < b and text[a].isspace():
                a += 1
        return a >= b

    def cuts(a: int, b: int, level: int) -> list[int]:
        """Starts of the subtrees of text[a:b]; blanks stay with the part before them, headings with what they head."""
        if level < len(depths):
            near = range(bisect.bisect_right(places, a), bisect.bisect_left(places, b))
            found = [places[k] for k in near if openers[k][1] <= depths[level]]
        else:
            found = [m.end() for m in _LEVELS[level - len(depths)].finditer(text, a, b)]
        out = [a]
        for c in dict.fromkeys(found):
            if out[-1] < c < b and not (level < len(depths) + _WHOLE_HEADINGS and only_headings(out[-1], c)):
                out.append(c)
        return out

    def pack(a: int, b: int, level: int) -> list[tuple[int, int]]:
        """The pieces of a node: itself if it fits, else its subtrees, siblings merged while they fit together."""
        while count(a, b) > room and level < len(depths) + len(_LEVELS):
            starts = cuts(a, b, level)
            level += 1
            if len(starts) > 1:
                break
        else:
            return [(a, b)]
        out: list[tuple[int, int, bool]] = []
        for x, y in zip(starts, [*starts[1:], b]):
            opened = count(x, y) > room
            for k, (u, v) in enumerate(pack(x, y, level) if opened else [(x, y)]):
                # the rest of an opened node may take in its next sibling, never the first part of another opened one
                fits = out and count(out[-1][0], v) <= room and (not opened or k and out[-1][1] > x or not out[-1][2])
                if fits:
                    out[-1] = (out[-1][0], v, opened or out[-1][2])
                else:
                    out.append((u, v, opened))
        return [(u, v) for u, v, _ in out]

    owns = pack(0, len(text), 0)
    # blanks alone are no piece
    merged: list[tuple[int, int]] = []
    for a, b in owns:
        if merged and (not count(a, b) or not count(*merged[-1])):
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for i, (a, b) in enumerate(merged):
        back = a
        if i and overlap:
            k = bisect.bisect_left(begins, a)
            j = max(k - min(overlap, limit - count(a, b)), bisect.bisect_left(begins, merged[i - 1][0]))
            back = begins[j] if j < k else a
        out.append((back, a, b))
    return out


PIECE_FIELDS = "piece_no int, start_char int, own_start int, end_char int, tokens int, overlap_tokens int, piece string"


def split_oversized(
    df: DataFrame, key: list[str], text: str = "text", limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, all_items: bool = False
) -> DataFrame:
    """Pieces of the items whose text is over ``limit`` tokens: the key columns, ``piece_no`` from 1, offsets in
    characters (``start_char`` with overlap, ``own_start`` without), ``tokens``, ``overlap_tokens``, ``piece``.

    ``all_items``: items within the limit come out as one piece each. Joining ``text[own_start:end_char]`` in order
    gives the text back, so nothing is lost. Null texts give no piece; an empty text is within any limit. Repeated
    rows count once by key. Each text is taken whole; a single token is never cut.
    """
    names = [*key, "__text", "__n"]
    sized = df.select(*[F.col(k) for k in key], F.col(text).alias("__text")).filter("__text IS NOT NULL")
    # a text has no more tokens than characters, which spares most texts the counting
    sized = sized.withColumn("__n", F.when(F.length("__text") > limit, token_count(F.col("__text"))).otherwise(F.lit(0)))
    over = sized.filter(F.col("__n") > limit).select(*names).dropDuplicates(key)
    out_schema = T.StructType([*(over.schema[k] for k in key), *_piece_struct().fields])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                *k, t, _ = row
                for i, (a, o, b) in enumerate(piece_spans(t, limit, overlap)):
                    rows.append((*k, i + 1, a, o, b, len(_TOKEN.findall(t[a:b])), len(_TOKEN.findall(t[a:o])), t[a:b]))
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    pieces = over.mapInPandas(cut, out_schema)
    if not all_items:
        return pieces
    whole = (
        sized.filter(F.col("__n") <= limit)
        .dropDuplicates(key)
        .select(
            *key,
            F.lit(1).alias("piece_no"),
            F.lit(0).alias("start_char"),
            F.lit(0).alias("own_start"),
            F.length("__text").alias("end_char"),
            token_count(F.col("__text")).alias("tokens"),
            F.lit(0).alias("overlap_tokens"),
            F.col("__text").alias("piece"),
        )
    )
    return pieces.unionByName(whole)


def _piece_struct() -> T.StructType:
    kinds = {"int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in PIECE_FIELDS.split(", "))])


def chunk_and_block_pieces(chunks: DataFrame, blocks: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of every chunk and every block (all roles) over the limit; chunk and block ids never meet."""
    both = chunks.select("id", "text").unionAll(blocks.select("id", "text"))
    return split_oversized(both, ["id"], "text", limit, overlap)


def oversized_ids(chunks: DataFrame, blocks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """``id`` of the chunks and blocks that were cut, one row each."""
    return chunk_and_block_pieces(chunks, blocks, limit).filter("piece_no = 1").select("id")


def piece_check(chunks: DataFrame, blocks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """``id, tokens, within, restored``: per oversized item the tokens of all own parts, whether each piece keeps the
    limit, and the MD5 of the own parts joined in order, which is that of the text if nothing is lost."""
    pieces = chunk_and_block_pieces(chunks, blocks, limit)
    own = F.expr("substring(piece, own_start - start_char + 1)")
    # at most as much as one text
    parts = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"))))
    grouped = pieces.groupBy("id").agg(
        F.sum(F.col("tokens") - F.col("overlap_tokens")).alias("tokens"), (F.max("tokens") <= limit).alias("within"),
        F.md5(F.array_join(F.transform(parts, lambda p: p["own"]), "").cast("binary")).alias("restored"),
    )
    return grouped.select("id", "tokens", "within", "restored")

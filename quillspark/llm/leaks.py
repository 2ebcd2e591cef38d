"""Held-out passages inside a training corpus: broadcast n-grams, scanned token windows, verified stretches.

The held-out side is a stated, fixed set. All of its n-grams go to every task, in blocks of bounded size; each document
is read once per block, whole, without any shuffle. A gram that holds a distinctive word (a name or a figure), or a run
of any known grams, is a hit; it counts only after its aligned stretch, grown word by word both ways, is long enough.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import components
from quillspark.session import cut_lineage

NGRAM = 4
#: So many agreeing words in a row lead to a stretch even where none of them is distinctive.
RUN = 8
MIN_WORDS = 14
#: The largest share of all held-out passages that one name stands in.
NAME_SHARE = 0.0075
#: Items that share so many words in a row are copies of one passage; shared phrasing reached 9 on the test data.
COPY_RUN = 12
BLOCK_TOKENS = 500_000

_HYPHENS = "-‐‑­"
_INVISIBLE = "­​‌‍⁠﻿"
_TOKEN = re.compile(
    r"\d{1,3}(?:[,.'’    ]\d{3})+(?!\d)"
    r"|[぀-ヿ㐀-鿿฀-๿]"
    rf"|\d+|(?:[^\W\d_](?:[̀-ͯ؀-ۿऀ-ॿ{_INVISIBLE}]|[^\W\d_])*)(?:[{_HYPHENS}]\s*\n\s*[^\W\d_]+)*"
)
_DROP = re.compile(rf"[{_HYPHENS}{_INVISIBLE}\s,.'’]+")


def tokens_with_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Normalised words, figures and characters of a text with their places in it.

    Case, compatibility forms, invisible characters, thousands separators and hyphens at line ends are evened out.
    """
    found = [(m.group(), m.span()) for m in _TOKEN.finditer(text)]
    return [_even(t) for t, _ in found], [s for _, s in found]


def _even(token: str) -> str:
    token = token.lower()
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token).lower()
    return token if token.isalnum() and token.isascii() else _DROP.sub("", token)


_ASCII_TOKEN = re.compile(r"[a-z]+|\d{1,3}(?:[,.' ]\d{3})+(?!\d)|\d+")
_LINE_HYPHEN = re.compile(r"(?<=[a-z])-\s*\n\s*(?=[a-z])")


def plain_tokens(text: str) -> list[str]:
    """The words of ``tokens_with_spans`` without their places."""
    low = text.lower()
    if low.isascii():
        if "-" in low and "\n" in low:
            low = _LINE_HYPHEN.sub("", low)
        return [w if w.isalnum() else _DROP.sub("", w) for w in _ASCII_TOKEN.findall(low)]
    return [w if w.isascii() and w.isalnum() else _DROP.sub("", w) for w in map(_normal, _TOKEN.findall(low))]


def _normal(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFKC", word)


class HeldOut:
    """One block of held-out items, ready to be looked up. ``names`` holds the places of each item's distinctive words."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], n: int = NGRAM):
        self.n = n
        self.words = {i: list(ws) for i, ws, _ in items}
        self.names = {i: frozenset(at) for i, _, at in items}
        #: Places of each gram to grow from; a gram without a distinctive word is known, but leads nowhere on its own.
        self.grams: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        self.runs: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, ws in self.words.items():
            if 0 < len(ws) < n:
                self.short[len(ws)][tuple(ws)].append(i)
            for p in range(len(ws) - n + 1):
                led = self.grams.setdefault(tuple(ws[p : p + n]), [])
                if len(ws) < RUN or not self.names[i].isdisjoint(range(p, p + n)):
                    led.append((i, p))
            for p in range(len(ws) - RUN + 1):
                self.runs[tuple(ws[p : p + RUN])].append((i, p))

    def _grow(self, doc: list[str], i: int, k: int, p: int, step: int, walked: list[tuple[int, int, int]]) -> tuple[int, int]:
        """Words that agree from (k, p) outwards and the place of the last one; up to three words may be dropped, added
        or exchanged at once, but no distinctive word of the item. ``walked`` takes the diagonals gone along."""
        item, names = self.words[i], self.names[i]
        agreed, last, since = 0, k - step, k
        while 0 <= k < len(doc) and 0 <= p < len(item):
            if doc[k] == item[p]:
                agreed, last, k, p = agreed + 1, k, k + step, p + step
                continue
            onward = None
            for apart in range(1, 7):
                for x in range(max(0, apart - 3), min(3, apart) + 1):
                    kk, pp = k + step * x, p + step * (apart - x)
                    if not (0 <= kk < len(doc) and 0 <= pp < len(item)) or doc[kk] != item[pp]:
                        continue
                    if 0 <= kk + step < len(doc) and 0 <= pp + step < len(item) and doc[kk + step] != item[pp + step]:
                        continue
                    if names.isdisjoint(range(p, pp) if step > 0 else range(pp + 1, p + 1)):
                        onward = (kk, pp)
                        break
                if onward:
                    break
            if onward is None:
                break
            walked.append((k - p, min(since, last), max(since, last)))
            k, p = onward
            since = k
        walked.append((k - p, min(since, last), max(since, last)))
        return agreed, last

    def _places(self, doc: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Where an item's words may begin to agree: ``(place in doc, place in item)`` by item, in order of ``doc``."""
        n, grams = self.n, self.grams
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        before, length = -2, 0
        for k in [k for k, g in enumerate(zip(*(doc[x:] for x in range(n)))) if g in grams]:
            for i, p in grams[tuple(doc[k : k + n])]:
                found[i].append((k, p))
            length = length + 1 if k == before + 1 else 1
            before = k
            if length > RUN - n:  # so many known grams in a row make up a run, with or without a distinctive word
                at = k + n - RUN
                for i, p in self.runs.get(tuple(doc[at : at + RUN]), ()):
                    found[i].append((at, p))
        return found

    def find(self, doc: list[str], least: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
        """``(item, words, first, last)``: each agreeing stretch of each leaked item, as places in ``doc``."""
        out = []
        for i, places in self._places(doc).items():
            item = self.words[i]
            need = min(least, len(item))
            walked: dict[int, list[tuple[int, int]]] = defaultdict(list)
            kept: list[tuple[int, int, int]] = []
            for k, p in sorted(set(places)):
                if any(a <= k <= b for a, b in walked[k - p]):
                    continue
                lines: list[tuple[int, int, int]] = []
                right, b = self._grow(doc, i, k, p, 1, lines)
                left, a = self._grow(doc, i, k - 1, p - 1, -1, lines)
                for d, x, y in lines:
                    walked[d].append((x, y))
                if right + left >= need:
                    kept.append((right + left, a if left else k, b))
            # of stretches that lie over one another the longest holds
            for words, a, b in sorted(kept, reverse=True):
                if not any(i == o[0] and a <= o[3] and o[2] <= b for o in out):
                    out.append((i, words, a, b))
        for size, known in self.short.items():
            for k in range(len(doc) - size + 1):
                out += [(i, size, k, k + size - 1) for i in known.get(tuple(doc[k : k + size]), ())]
        return out


def distinctive_words(items: DataFrame, item_id: str = "item_id", text: str = "text", share: float = NAME_SHARE) -> DataFrame:
    """``item_id, words, names``: the words of each item and the places of its names and figures.

    A word is a name if it stands in a single passage, or in at most ``share`` of all passages. Items that share
    ``COPY_RUN`` words in a row, or all their words, are one passage, so copies of an item, however many, do not make
    its names common; and since passages are those of the whole set, it makes no difference in which block an item goes.
    """
    kind = dict(items.dtypes)[item_id]
    schema = f"`{item_id}` {kind}, words array<string>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({item_id: batch[item_id], "words": [plain_tokens(t) for t in batch[text]]})

    rows = cut_lineage(items.select(item_id, text).filter(F.col(text).isNotNull()).dropDuplicates([item_id]).mapInPandas(read, schema))
    keyed = rows.withColumn("node", F.xxhash64(F.col(item_id).cast("string")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - COPY_RUN + 1, F.lit(1)))
    runs = keyed.select("node", F.explode(F.array_distinct(F.transform(starts, lambda p: F.xxhash64(F.array_join(F.slice("words", p, COPY_RUN), " "))))).alias("run"))
    links = runs.join(runs.groupBy("run").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1"), "run")
    roots = components(links.select(F.col("node").alias("a"), F.col("head").alias("b"))).withColumnRenamed("root", "passage")
    passages = keyed.join(roots, "node", "left").withColumn("passage", F.coalesce("passage", "node"))
    placed = passages.select(item_id, "passage", F.posexplode("words").alias("at", "w"))
    spread = placed.select("passage", "w").distinct().groupBy("w").agg(F.count("*").alias("n"))
    total = passages.agg(F.countDistinct("passage")).first()[0]
    rare = spread.filter((F.col("n") <= max(1.0, share * total)) | F.col("w").rlike(r"^\p{Nd}"))
    names = placed.join(rare.select("w"), "w").groupBy(item_id).agg(F.collect_list("at").alias("names"))
    return rows.join(names, item_id, "left").select(item_id, "words", F.coalesce("names", F.array().cast("array<int>")).alias("names"))


def _blocks(items: DataFrame, item_id: str, text: str, block_tokens: int) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    """The held-out set in blocks whose words together stay under ``block_tokens``; at least one, be it empty."""
    block: list = []
    room = block_tokens
    for row in distinctive_words(items, item_id, text).orderBy(item_id).toLocalIterator():
        if block and len(row["words"]) > room:
            yield block
            block, room = [], block_tokens
        block.append((row[item_id], row["words"], row["names"]))
        room -= len(row["words"])
    yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = MIN_WORDS
) -> DataFrame:
    """``doc_id, item_id, words, start_char, end_char``: documents that hold an item's words, whole or in a continuous
    stretch of ``least`` agreeing words or more, with the stretch's place in the document.

    One row for each stretch: a document that holds an item twice gives two. An item shorter than ``least``, be it one
    word, leaks when all of its words are there. Null and empty texts on either side give no row; repeated rows count
    once; an empty set gives an empty result. The held-out set is meant to be small: it is read in blocks of
    ``BLOCK_TOKENS`` words, each broadcast and scanned for on its own.
    """
    found = None
    context = docs.sparkSession.sparkContext
    rows = docs.select(doc_id, text).filter(F.col(text).isNotNull())
    for block in _blocks(items, item_id, text, BLOCK_TOKENS):
        shared = context.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = HeldOut(shared.value)
            for batch in batches:
                out = []
                for d, t in zip(batch[doc_id], batch[text]):
                    hits = held.find(plain_tokens(t), least)
                    spans = tokens_with_spans(t)[1] if hits else []
                    for i, words, a, b in hits:
                        whole = len(spans) > b
                        out.append((d, i, words, spans[a][0] if whole else 0, spans[b][1] if whole else len(t)))
                yield pd.DataFrame(out, columns=[doc_id, item_id, "words", "start_char", "end_char"])

        kinds = dict(docs.dtypes) | {f"item:{k}": v for k, v in items.dtypes}
        schema = f"`{doc_id}` {kinds[doc_id]}, `{item_id}` {kinds[f'item:{item_id}']}, words int, start_char int, end_char int"
        part = rows.mapInPandas(scan, schema)
        found = part if found is None else found.unionAll(part)
    return found.distinct()


def leaked_pairs(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: the documents and the items that leaked into them."""
    return find_leaks(docs, items).select("doc_id", "item_id").distinct()


def remove_leaks(docs: DataFrame, leaks: DataFrame, mode: str = "documents", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus without what leaked: ``documents`` drops the documents, ``spans`` cuts the stretches out of them."""
    if mode == "documents":
        return docs.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
    spans = leaks.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("__spans"))
    kept = F.expr(
        f"aggregate(__spans, named_struct('at', 0, 'out', ''), (a, s) -> named_struct('at', greatest(a.at, s.end_char), 'out', "
        f"a.out || substring(`{text}`, a.at + 1, greatest(0, s.start_char - a.at))), a -> a.out || substring(`{text}`, a.at + 1))"
    )
    return docs.join(spans, doc_id, "left").withColumn(text, F.when(F.col("__spans").isNull(), F.col(text)).otherwise(kept)).drop("__spans")

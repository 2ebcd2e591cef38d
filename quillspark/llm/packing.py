"""Filling context windows of fixed capacity with whole items, balanced by attention cost.

Windows are filled from neighbouring items: each run of ``SEGMENT_ITEMS`` chunk numbers of a document is packed on its
own, in a document of any size. Descending items go to the window of lowest cost (linear plus quadratic) with room
left; the number of windows is the least with which every item finds room that way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.pieces import split_oversized, token_count
from quillspark.session import cut_lineage

CAPACITY = 2048
#: Neighbouring chunk numbers that share windows, whatever the size of the document.
SEGMENT_ITEMS = 512
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def _balanced(sizes: np.ndarray, capacity: int, bins: int) -> np.ndarray | None:
    """Descending sizes to the cheapest of ``bins`` windows with room; None where one finds none."""
    room = np.full(bins, capacity, dtype=np.int64)
    cost = np.zeros(bins)
    where = np.empty(len(sizes), dtype=np.int64)
    for i, n in enumerate(sizes):
        free = np.where(room >= n, cost, np.inf)
        k = int(free.argmin())
        if free[k] == np.inf:
            return None
        where[i] = k
        room[k] -= n
        cost[k] += LINEAR * n + QUADRATIC * n * n
    return where


def _best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Descending sizes to the window that they fill best; what the number of windows is measured against."""
    room = np.empty(0, dtype=np.int64)
    where = np.empty(len(sizes), dtype=np.int64)
    for i, n in enumerate(sizes):
        left = np.where(room >= n, room - n, capacity + 1)
        k = int(left.argmin()) if len(left) else 0
        if not len(left) or left[k] > capacity:
            room = np.append(room, capacity)
            k = len(room) - 1
        where[i] = k
        room[k] -= n
    return where


def _levelled(sizes: np.ndarray, where: np.ndarray, capacity: int) -> np.ndarray:
    """The same windows with items moved and exchanged from the dearest to cheaper ones while that brings its cost down
    and all keep within the capacity."""
    where = where.copy()
    bins = int(where.max()) + 1
    price = LINEAR * sizes + QUADRATIC * sizes * sizes
    for _ in range(len(sizes)):
        room = capacity - np.bincount(where, weights=sizes, minlength=bins)
        cost = np.bincount(where, weights=price, minlength=bins)
        top = int(cost.argmax())
        best = None
        for i in np.flatnonzero(where == top):
            # moves to another window, or exchanges with a smaller item of it
            for j in [None, *np.flatnonzero((where != top) & (sizes < sizes[i]))]:
                targets = [w for w in range(bins) if w != top] if j is None else [int(where[j])]
                freed, paid = (0, 0.0) if j is None else (sizes[j], price[j])
                for w in targets:
                    if room[w] + freed >= sizes[i]:
                        worst = max(cost[top] - price[i] + paid, cost[w] + price[i] - paid)
                        if worst < cost[top] - 1e-9 and (best is None or worst < best[0]):
                            best = (worst, i, j, w)
        if best is None:
            return where
        _, i, j, w = best
        where[i] = w
        if j is not None:
            where[j] = top
    return where


def assign_windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window number of each item (sizes within the capacity). Never more windows than best fit needs.

    Every number of windows from the least possible up to that of best fit is tried in turn. Where the cheapest window
    has room for every item in none of them, the windows of best fit are levelled by cost. Ties keep the order of items.
    """
    out = np.empty(len(sizes), dtype=np.int64)
    if not len(sizes):
        return out
    order = np.argsort(-sizes, kind="stable")
    ranked = sizes[order].astype(np.int64)
    fitted = _best_fit(ranked, capacity)
    most = int(fitted.max()) + 1
    got = None
    for bins in range(max(-(-int(ranked.sum()) // capacity), 1), most + 1):
        got = _balanced(ranked, capacity, bins)
        if got is not None:
            break
    out[order] = _levelled(ranked, fitted, capacity) if got is None else got
    return out


def sized_chunks(chunks: DataFrame, capacity: int = CAPACITY, text: str = "embed_text") -> DataFrame:
    """One row per item to pack: chunks with their true size, those over the capacity as pieces of their own.

    Repeated rows count once. A null text has size 0 and is packed like any other.
    """
    light = chunks.select("doc_id", "id", "chunk_index", "sections", "block_ids", token_count(F.col(text)).alias("tokens"))
    # counted once; the texts are not needed after this
    light = cut_lineage(light.withColumn("tokens", F.coalesce("tokens", F.lit(0))).dropDuplicates(["id"]))
    fits = light.filter(F.col("tokens") <= capacity).withColumn("piece_no", F.lit(1))
    pieces = split_oversized(chunks, ["id"], text, capacity, 0).select("id", "piece_no", F.col("tokens").alias("own"))
    cut = light.filter(F.col("tokens") > capacity).join(pieces, "id").withColumn("tokens", F.col("own")).drop("own")
    return fits.unionByName(cut)


def pack_windows(items: DataFrame, capacity: int = CAPACITY, segment_items: int = SEGMENT_ITEMS) -> DataFrame:
    """Windows of the items of each document: ``doc_id, segment, window_no, used_tokens, free_tokens, cost, items,
    chunk_ids, sections, block_ids``.

    A segment is a range of ``segment_items`` chunk numbers of one document, so a window holds chunks that lie near one
    another and a document of any size is packed by many tasks; adding to a document changes none of its earlier
    segments. Where a range holds more rows than its numbers (null or repeated numbers), it is divided further by hash;
    the counts for that are aggregated first.
    """
    ranged = items.withColumn("__range", F.coalesce(F.floor(F.col("chunk_index") / segment_items), F.lit(-1)).cast("long"))
    crowded = (
        ranged.groupBy("doc_id", "__range").count().filter(F.col("count") > segment_items)
        .select(F.col("doc_id").alias("__d"), F.col("__range").alias("__r"), F.ceil(2 * F.col("count") / segment_items).alias("__ways"))
    )
    keyed = ranged.join(crowded, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__range") == F.col("__r")), "left")
    keyed = keyed.withColumn(
        "segment", F.concat_ws("/", "__range", F.pmod(F.xxhash64("id", "piece_no"), F.coalesce("__ways", F.lit(1))).cast("string"))
    ).select("doc_id", "segment", "id", "piece_no", "chunk_index", F.col("tokens").cast("long").alias("tokens"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["chunk_index", "id", "piece_no"], kind="stable")
        return part[["doc_id", "segment", "id", "piece_no", "tokens"]].assign(window_no=assign_windows(part["tokens"].to_numpy(), capacity) + 1)

    # the rows are few bytes but much work, so the tasks are not left to be merged by size
    ways = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartition(ways, "doc_id", "segment").groupBy("doc_id", "segment").applyInPandas(
        pack, "doc_id string, segment string, id string, piece_no int, tokens long, window_no long"
    )
    carried = placed.join(items.select("id", "piece_no", "chunk_index", "sections", "block_ids"), ["id", "piece_no"])
    in_order = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "piece_no", "tokens", "sections", "block_ids")))
    none = F.array().cast("array<string>")
    flat = lambda c: F.array_distinct(F.flatten(F.transform("parts", lambda p: F.coalesce(p[c], none))))
    return (
        carried.groupBy("doc_id", "segment", "window_no").agg(in_order.alias("parts"))
        .select(
            "doc_id", "segment", "window_no",
            F.expr("aggregate(parts, 0L, (a, p) -> a + p.tokens)").alias("used_tokens"),
            (F.lit(capacity) - F.expr("aggregate(parts, 0L, (a, p) -> a + p.tokens)")).alias("free_tokens"),
            F.expr(f"aggregate(parts, 0D, (a, p) -> a + {LINEAR}D * p.tokens + {QUADRATIC}D * p.tokens * p.tokens)").alias("cost"),
            F.size("parts").alias("items"),
            F.expr("array_distinct(transform(parts, p -> p.id))").alias("chunk_ids"),
            flat("sections").alias("sections"),
            flat("block_ids").alias("block_ids"),
        )
    )


def chunk_windows(chunks: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Context windows of all chunks, by document."""
    return pack_windows(sized_chunks(chunks, capacity), capacity)

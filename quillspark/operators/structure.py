"""Scopes, section numbers and breadcrumbs from headings and numbering, as running frames in document order."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


@dataclass(frozen=True)
class ScopeProfile:
    front: str = "Front matter"
    main: str = "Regulation"
    max_label_chars: int = 80
    max_title_chars: int = 200


def _running(*keys: str):
    return Window.partitionBy(*keys).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)


def section_events(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """Body blocks with ``segment`` (a run under one scope heading), ``scope_now``, ``number``, ``is_title`` and ``label``.

    A scope heading starts a segment; before the first one, the first numbered block leaves the front matter. What
    starts where is counted first, one row a document with its few headings, so no document is sorted or passes through
    one task; frames over a segment come later.
    """
    body = blocks.filter("role = 'body'")
    scope = F.when(F.coalesce("heading_level", F.lit(0)) > 0, T.scope_name(F.col("text")))
    read = body.withColumn("heads", scope).withColumn("number", F.when(F.col("heads").isNull(), T.section_number(F.col("text"))))
    headings = F.array_sort(F.collect_set(F.when(F.col("heads").isNotNull(), F.struct("ordinal", "heads"))))
    marks = read.groupBy("doc_id").agg(headings.alias("headings"), F.min(F.when(F.col("number").isNotNull(), F.col("ordinal"))).alias("numbered"))
    marks = marks.filter("size(headings) > 0 OR numbered IS NOT NULL")
    events = read.dropDuplicates(["id"]).join(marks, "doc_id", "left")
    events = events.withColumn("open", F.filter("headings", lambda h: h["ordinal"] <= F.col("ordinal")))
    annexes, late = F.greatest(F.coalesce(F.size("open"), F.lit(0)), F.lit(0)), F.coalesce(F.col("numbered") <= F.col("ordinal"), F.lit(False))
    events = events.withColumn("segment", F.when(annexes > 0, annexes + 1).when(late, 1).otherwise(0).cast("int"))
    events = events.withColumn("scope_now", F.when(annexes > 0, F.element_at("open", -1)["heads"]).when(late, profile.main).otherwise(profile.front)).drop("headings", "numbered", "open")
    # only numbered blocks have a label, so only their texts are looked through
    rest = T.strip(F.regexp_replace(F.when(F.col("number").isNotNull(), F.col("text")), r"^\s*\p{Nd}+(?:\.\p{Nd}+)*\.", ""))
    events = events.withColumn("rest", rest)
    rest = F.col("rest")
    title = (F.coalesce("heading_level", F.lit(0)) > 0) | T.is_label(rest, profile.max_label_chars)
    events = events.withColumn("is_title", F.col("number").isNotNull() & title)
    label = F.when(F.col("is_title"), rest).otherwise(T.short_label(rest))
    return events.withColumn("label", F.when(F.col("number").isNotNull(), F.concat(F.col("number"), F.lit(" "), label))).drop("rest")


def scope_run_starts(body: DataFrame) -> DataFrame:
    """``doc_id, starts``: the ordinals at which a block's scope differs from the one before it, the first block's too.

    Only numbers and scopes pass through a document's frame, no texts; what comes out is one row a document.
    """
    light = body.select("doc_id", "ordinal", "scope", F.lit(True).alias("seen")).distinct()
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    moved = light.withColumn("moves", ~F.col("scope").eqNullSafe(F.lag("scope").over(order)) | F.lag("seen").over(order).isNull())
    return moved.filter("moves").groupBy("doc_id").agg(F.array_sort(F.collect_list("ordinal")).alias("starts"))


def with_scope_runs(body: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """Adds ``run``: the number of the run of blocks under one scope that a block stands in, from 1 by document.

    ``delivered`` may hold the same blocks with repeated rows, which make no difference to where runs start.
    """
    joined = body.join(scope_run_starts(body if delivered is None else delivered), "doc_id")
    return joined.withColumn("run", F.size(F.filter("starts", lambda x: x <= F.col("ordinal")))).drop("starts")


def scopes(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """``doc_id, segment, scope, title, first_ordinal``: one row per scope entered, with its collected title.

    The title is what the heading says itself and the headings after it, at most one level below, until another block
    closes it. The main scope has none.
    """
    events = section_events(blocks, profile).filter("segment > 0")
    segment = _running("doc_id", "segment")
    level = F.first(F.when(F.col("heads").isNotNull(), F.col("heading_level")), ignorenulls=True).over(segment)
    opens = F.col("heads").isNull() & F.col("number").isNull() & (F.coalesce("heading_level", F.lit(0)) > 0) & (F.col("heading_level") <= F.col("title_level") + 1)
    seen = events.withColumn("title_level", level).withColumn("closed", F.sum(F.when(F.col("heads").isNull() & ~F.coalesce(opens, F.lit(False)), 1).otherwise(0)).over(segment))
    part = F.when(F.col("closed") == 0, F.when(F.col("heads").isNotNull(), T.scope_title(F.col("text"))).otherwise(T.strip(F.col("text"))))
    parts = seen.withColumn("part", part)
    own = F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct("ordinal", "part"))))
    got = parts.groupBy("doc_id", "segment").agg(F.max("scope_now").alias("scope"), own.alias("parts"), F.min("ordinal").alias("first_ordinal"))
    title = F.substring(T.join_lines(F.transform("parts", lambda p: p["part"])), 1, profile.max_title_chars)
    return got.select("doc_id", "segment", "scope", title.alias("title"), "first_ordinal")


def backward_jumps(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """``doc_id, scope, ordinal, number, before``: numbered blocks whose number is less than the one before in their segment."""
    numbered = section_events(blocks, profile).filter("number IS NOT NULL")
    order = Window.partitionBy("doc_id", "segment").orderBy("ordinal")
    pairs = numbered.withColumn("before", F.lag("number").over(order))
    fell = T.number_path(F.col("number")) < T.number_path(F.col("before"))
    return pairs.filter(fell).select("doc_id", F.col("scope_now").alias("scope"), "ordinal", "number", "before")


def breadcrumbs(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """``doc_id, id, ordinal, scope, section, crumbs``: the open sections of each body block.

    A numbered block is open until one comes that does not lie under it. So the crumb of depth k is the last label of
    depth k within the run of numbered blocks that share their first k parts. The depths are those found in the blocks,
    which one small job counts first.
    """
    events = section_events(blocks, profile).withColumn("path", T.number_path(F.col("number")))
    numbers = T.section_number(F.col("text"))
    deepest = blocks.filter("role = 'body'").agg(F.max(F.size(F.split(numbers, r"\.")))).first()[0] or 0
    run = _running("doc_id", "segment")
    before = F.last("path", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("earlier", before)
    for k in range(1, deepest + 1):
        cut = F.col("path").isNotNull() & (F.col("earlier").isNull() | (F.size("path") < k) | ~F.slice("path", 1, k).eqNullSafe(F.slice("earlier", 1, k)))
        events = events.withColumn(f"run{k}", F.sum(cut.cast("int")).over(run))
    # the last label of each depth with the run it stands in; all frames share one sort
    for k in range(1, deepest + 1):
        mark = F.when(F.size("path") == k, F.struct(F.col(f"run{k}").alias("run"), F.col("label").alias("label")))
        events = events.withColumn(f"last{k}", F.last(mark, ignorenulls=True).over(run))
    # a label is open while the latest number starts with its own
    crumbs = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.col(f"last{k}.run") == F.col(f"run{k}"), F.col(f"last{k}.label")) for k in range(1, deepest + 1)]))
    return events.select("doc_id", "id", "ordinal", F.col("scope_now").alias("scope"), "number", "is_title", crumbs.alias("crumbs"))


def breadcrumbs_by_fold(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """The same crumbs by a stack over each segment in Python; the form that the frames are tested against."""
    events = section_events(blocks, profile).select("doc_id", "segment", "id", "ordinal", "scope_now", "number", "label")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[list[int], str]] = []
        out = []
        for row in part.sort_values("ordinal").itertuples(index=False):
            if isinstance(row.number, str):
                path = [int(x) for x in row.number.split(".")]
                while stack and path[: len(stack[-1][0])] != stack[-1][0]:
                    stack.pop()
                if stack and stack[-1][0] == path:
                    stack.pop()
                stack.append((path, row.label))
            out.append((row.doc_id, row.id, row.ordinal, row.scope_now, row.number, [s for _, s in stack]))
        return pd.DataFrame(out, columns=["doc_id", "id", "ordinal", "scope", "number", "crumbs"])

    return events.groupBy("doc_id", "segment").applyInPandas(fold, "doc_id string, id string, ordinal int, scope string, number string, crumbs array<string>")


def final_scope_heads(blocks: DataFrame, profile: ScopeProfile = ScopeProfile()) -> DataFrame:
    """``doc_id, scope, head``: ``scope: title`` of each scope's last heading."""
    found = scopes(blocks, profile).groupBy("doc_id", "scope").agg(F.max_by("title", "segment").alias("title"))
    return found.select("doc_id", "scope", F.when(F.coalesce("title", F.lit("")) == "", F.col("scope")).otherwise(F.concat("scope", F.lit(": "), "title")).alias("head"))


def document_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: the body texts in order with blank lines between them; for documents of bounded size."""
    body = blocks.filter("role = 'body'").dropDuplicates(["id"])
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return body.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))

"""Page furniture, footnotes and contents lines from block geometry; heading styles from fonts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


@dataclass(frozen=True)
class LayoutConfig:
    edge_ratio: float = 0.15
    band: float = 5.0
    min_repeat_ratio: float = 0.3
    min_repeat_pages: int = 3
    rule_width: tuple[float, float] = (0.05, 0.25)
    footnote_size_delta: float = 0.5
    min_block_chars: int = 5
    page_height: float = 842.0
    page_width: float = 595.0


@dataclass(frozen=True)
class StyleConfig:
    min_size_delta: float = 1.0
    max_char_share: float = 0.05
    min_style_chars: int = 30


def with_page_size(blocks: DataFrame, pages: DataFrame | None, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Adds ``height`` and ``width`` of the page; the configured size where pages are not given or not known."""
    if pages is None:
        return blocks.withColumn("height", F.lit(config.page_height)).withColumn("width", F.lit(config.page_width))
    size = pages.select("doc_id", F.col("number").alias("page_number"), F.col("height").alias("__h"), F.col("width").alias("__w"))
    joined = blocks.join(size, ["doc_id", "page_number"], "left")
    return joined.withColumn("height", F.coalesce("__h", F.lit(config.page_height))).withColumn("width", F.coalesce("__w", F.lit(config.page_width))).drop("__h", "__w")


def edge_zone(sized: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Adds ``edge`` (top, bottom or null) and ``edge_band``, the distance from that edge in bands; top comes first."""
    y0, y1, h = F.col("bbox.y0"), F.col("bbox.y1"), F.col("height")
    top, bottom = y0 < F.lit(config.edge_ratio) * h, h - y1 < F.lit(config.edge_ratio) * h
    band = F.when(top, F.bround(y0 / config.band)).when(bottom, F.bround((h - y1) / config.band)).cast("int")
    return sized.withColumn("edge", F.when(top, "top").when(bottom, "bottom")).withColumn("edge_band", band)


def repeated_patterns(zoned: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``doc_id, edge, edge_band, pattern, pages``: line patterns that an edge band repeats over enough pages."""
    pages = zoned.groupBy("doc_id").agg(F.countDistinct("page_number").alias("n_pages"))
    lines = zoned.filter(F.col("edge").isNotNull()).select("doc_id", "edge", "edge_band", T.pattern_key(F.col("text")).alias("pattern"), "page_number")
    seen = lines.groupBy("doc_id", "edge", "edge_band", "pattern").agg(F.countDistinct("page_number").alias("pages"))
    least = F.greatest(F.lit(config.min_repeat_pages), F.ceil(F.lit(config.min_repeat_ratio) * F.col("n_pages")).cast("int"))
    return seen.join(pages, "doc_id").filter(F.col("pages") >= least).drop("n_pages")


def furniture(blocks: DataFrame, pages: DataFrame | None = None, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Blocks with ``tagged``: header, footer or body.

    A line whose pattern repeats in its edge band is furniture; the depth that the repeated lines of a document reach
    then takes in what else stands as near to the edge. The learned tables are one row a pattern or document.
    """
    zoned = edge_zone(with_page_size(blocks, pages, config), config).withColumn("pattern", T.pattern_key(F.when(F.col("edge").isNotNull(), F.col("text"))))
    marks = repeated_patterns(zoned, config).select("doc_id", "edge", "edge_band", "pattern", F.lit(True).alias("repeats"))
    seen = zoned.join(marks, ["doc_id", "edge", "edge_band", "pattern"], "left")
    depth = seen.filter("repeats").groupBy("doc_id").agg(
        F.max(F.when(F.col("edge") == "top", F.col("bbox.y1"))).alias("header_depth"),
        F.max(F.when(F.col("edge") == "bottom", F.col("height") - F.col("bbox.y0"))).alias("footer_depth"),
    )
    joined = seen.join(depth, "doc_id", "left")
    head, foot = F.coalesce("header_depth", F.lit(0.0)), F.coalesce("footer_depth", F.lit(0.0))
    tag = (
        F.when(F.col("repeats") & (F.col("edge") == "top"), "header").when(F.col("repeats"), "footer")
        .when((head > 0) & (F.col("bbox.y1") <= head + config.band), "header")
        .when((foot > 0) & (F.col("height") - F.col("bbox.y0") <= foot + config.band), "footer").otherwise("body")
    )
    return joined.withColumn("tagged", tag)


def weighted_mode(df: DataFrame, keys: list[str], value: Column, weight: Column, order: Column, name: str) -> DataFrame:
    """The value of most weight in each group; among equals the one seen first."""
    sums = df.select(*keys, value.alias(name), weight.alias("__w"), order.alias("__o")).groupBy(*keys, name).agg(F.sum("__w").alias("__w"), F.min("__o").alias("__o"))
    return sums.groupBy(*keys).agg(F.max_by(name, F.struct(F.col("__w"), -F.col("__o"))).alias(name))


def body_font_size(blocks: DataFrame) -> DataFrame:
    """``doc_id, body_size``: the size that most body characters have."""
    body = blocks.filter("role = 'body' AND font_size IS NOT NULL AND text IS NOT NULL")
    return weighted_mode(body, ["doc_id"], F.bround("font_size", 1), F.length("text"), F.col("ordinal"), "body_size")


def footnote_separators(pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """``doc_id, page_number, separator_y``: the lowest short rule in a page's lower half that no other rule is near."""
    alone = F.filter(
        "hlines",
        lambda l: (l["y"] >= F.col("height") / 2)
        & ((l["x1"] - l["x0"]).between(F.col("width") * config.rule_width[0], F.col("width") * config.rule_width[1]))
        & (F.size(F.filter("hlines", lambda o: F.abs(o["y"] - l["y"]) < config.band)) == 1),
    )
    found = F.array_max(F.transform(alone, lambda l: l["y"]))
    return pages.select("doc_id", F.col("number").alias("page_number"), found.alias("separator_y")).filter("separator_y IS NOT NULL")


def footnotes(blocks: DataFrame, pages: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Blocks with ``is_footnote``: body blocks below the page's separator in a smaller size than the body's."""
    joined = blocks.join(footnote_separators(pages, config), ["doc_id", "page_number"], "left").join(body_font_size(blocks), "doc_id", "left")
    small = F.col("font_size") <= F.col("body_size") - config.footnote_size_delta
    return joined.withColumn("is_footnote", F.coalesce((F.col("role") == "body") & (F.col("bbox.y0") >= F.col("separator_y") - 1) & small, F.lit(False)))


def contents_and_noise(blocks: DataFrame, config: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Blocks with ``retagged``: body lines that end in dots and a page number are toc, very short ones noise."""
    body = F.col("role") == "body"
    tag = F.when(body & T.is_toc(F.col("text")), "toc").when(body & (F.length("text") < config.min_block_chars), "noise").otherwise(F.col("role"))
    return blocks.withColumn("retagged", tag)


def role_counts(blocks: DataFrame, role: str = "role") -> DataFrame:
    """``doc_id, role_counts``: a map of roles to blocks, unknown roles under ``unknown``."""
    counts = blocks.groupBy("doc_id", F.coalesce(F.col(role), F.lit("unknown")).alias("role")).count()
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "count")))).alias("role_counts"))


def heading_styles(blocks: DataFrame, config: StyleConfig = StyleConfig()) -> DataFrame:
    """``doc_id, size, bold, chars, is_body, level``: the style inventory with heading levels by falling size.

    A heading style is rare, used enough, and larger than the body's or bold at about its size. Sizes go by half points.
    """
    body = blocks.filter("role = 'body' AND text IS NOT NULL AND font_size IS NOT NULL")
    styles = (
        body.select("doc_id", (F.bround(F.col("font_size") * 2) / 2).alias("size"), F.coalesce("is_bold", F.lit(False)).alias("bold"), F.length("text").alias("n"), "ordinal")
        .groupBy("doc_id", "size", "bold").agg(F.sum("n").alias("chars"), F.min("ordinal").alias("first_ordinal"))
    )
    doc = Window.partitionBy("doc_id")
    most = F.max(F.struct(F.col("chars"), -F.col("first_ordinal"), F.col("size"), F.col("bold"))).over(doc)
    rated = styles.withColumn("main", most).withColumn("total", F.sum("chars").over(doc))
    rated = rated.withColumn("is_body", (F.col("size") == F.col("main.size")) & (F.col("bold") == F.col("main.bold")))
    larger = F.col("size") >= F.col("main.size") + config.min_size_delta
    bold = F.col("bold") & ~F.col("main.bold") & (F.abs(F.col("size") - F.col("main.size")) < config.min_size_delta)
    heading = ~F.col("is_body") & (larger | bold) & (F.col("chars") <= F.lit(config.max_char_share) * F.col("total")) & (F.col("chars") >= config.min_style_chars)
    rated = rated.withColumn("heading", heading)
    rank = F.when(F.col("heading"), F.row_number().over(Window.partitionBy("doc_id", "heading").orderBy(F.desc("size"), F.desc("bold"))))
    return rated.select("doc_id", "size", "bold", "chars", "is_body", rank.alias("level"))


def with_heading_levels(blocks: DataFrame, config: StyleConfig = StyleConfig()) -> DataFrame:
    """Blocks with ``style_level``, null where the style is none of a heading."""
    levels = heading_styles(blocks, config).filter("level IS NOT NULL").select("doc_id", "size", "bold", F.col("level").alias("style_level"))
    keyed = blocks.withColumn("size", F.bround(F.col("font_size") * 2) / 2).withColumn("bold", F.coalesce("is_bold", F.lit(False)))
    return keyed.join(levels, ["doc_id", "size", "bold"], "left").drop("size", "bold")

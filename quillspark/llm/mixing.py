"""Mixing sources to target weights by size, with capped repeats: whole copies plus Pareto order sampling.

Sizes are tokens of a public tokenizer. How much of each source is used follows from aggregates over the few sources;
which documents make up the part copy follows from ranks by random odds over inclusion odds, cut by a histogram of the
ranks, so no source is ever sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

SEED = 20240
# The pattern of the public byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks are told apart in this many histogram bins a source; only the bin at the cut is sorted.
BINS = 4096


def standard_source(source: Column) -> Column:
    """The standard writing of a source: lower case, no outer blanks, single underscores."""
    bare = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(bare, r"(?U)[\s_\-.]+", "_")


def tokenizer_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's vocabulary, where the package of them is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def document_sizes(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", pattern: str = SPLIT_PATTERN) -> DataFrame:
    """``doc_id, source, tokens``: the size of each whole text by a byte-pair vocabulary file; null and empty texts have
    size 0. ``pattern`` parts a text before its bytes are merged."""
    vocabulary = vocabulary or tokenizer_file()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield pd.DataFrame({"doc_id": batch[doc_id], "source": batch["source"], "tokens": sizes})

    rows = docs.select(doc_id, standard_source(F.col("source")).alias("source"), text)
    kind = dict(docs.dtypes)[doc_id]
    return rows.mapInPandas(count, f"doc_id {kind}, source string, tokens long")


def allocation(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, available, allotted, copies, fraction``: tokens allotted to each source.

    ``total`` tokens (by default all that the listed sources hold) are shared out by target share; a source whose
    ``max_repeats`` copies fall short gives all of them, and what it lacks is shared among the others by target share,
    as long as any can give more. Sources without rows get nothing; null shares and repeats count as 0.
    """
    listed = targets.select(
        standard_source(F.col("source")).alias("source"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"),
    ).dropDuplicates(["source"])
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("available"))
    known = listed.join(held, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    known = known.withColumn("cap", F.col("available") * F.col("max_repeats"))
    goal = F.lit(total).cast("double") if total is not None else F.expr("sum(available) over ()")
    # sources in the order in which they run dry as the common level rises; one row a source, so one partition is bounded
    level = known.withColumn("goal", goal).withColumn("dry", F.when(F.col("target_share") > 0, F.col("cap") / F.col("target_share")).otherwise(0.0))
    level = level.withColumn("spent", F.expr("coalesce(sum(cap) over (order by dry, source rows between unbounded preceding and 1 preceding), 0)"))
    level = level.withColumn("open_share", F.expr("sum(target_share) over (order by dry, source rows between current row and unbounded following)"))
    level = level.withColumn("level", F.when(F.col("open_share") > 0, (F.col("goal") - F.col("spent")) / F.col("open_share")).otherwise(0.0))
    # the first level that its own source can still reach is the common one
    common = F.expr("min(case when level <= dry then struct(dry, source, level) end) over ()")
    out = level.withColumn("common", F.coalesce(common["level"], F.expr("max(dry) over ()")))
    out = out.withColumn("allotted", F.least(F.col("cap").cast("double"), F.col("common") * F.col("target_share")))
    ratio = F.when(F.col("available") > 0, F.col("allotted") / F.col("available")).otherwise(0.0)
    return out.select(
        "source", "target_share", "max_repeats", "available", "allotted", F.floor(ratio + 1e-12).cast("int").alias("copies"),
        F.greatest(ratio - F.floor(ratio + 1e-12), F.lit(0.0)).alias("fraction"),
    )


def inclusion_rates(rows: DataFrame, shares: DataFrame, weight: Column) -> DataFrame:
    """``source, rate``: the factor by which weights become inclusion probabilities ``least(1, rate * weight)``, so that
    the expected tokens are what is left of the allotment after whole copies.

    Documents that the factor makes certain are taken out and the rest is shared out among the others, until no more
    become certain. Each round is one aggregate to a row a source; the set of certain ones only grows, so rounds end.
    """
    before = None
    state = shares.filter("fraction > 0").select("source", (F.col("fraction") * F.col("available")).alias("need"), F.lit(0.0).alias("rate"))
    while True:
        w = F.col("__w")
        joined = rows.withColumn("__w", weight).join(F.broadcast(state), "source")
        certain = F.col("rate") * w >= 1
        found = joined.groupBy("source", "need", "rate").agg(
            F.sum(F.when(certain, F.col("tokens")).otherwise(0)).alias("held"), F.sum(F.when(certain, 0.0).otherwise(w * F.col("tokens"))).alias("open"), F.count_if(certain).alias("n")
        )
        rate = F.when(F.col("open") > 0, (F.col("need") - F.col("held")) / F.col("open")).otherwise(F.col("rate"))
        state = cut_lineage(found.select("source", "need", F.greatest(rate, "rate").alias("rate"), (F.col("rate") > 0).alias("begun"), F.col("n").alias("sure")))
        done = [(r["source"], r["sure"]) for r in state.filter("begun").select("source", "sure").orderBy("source").collect()]  # one row a source
        if done == before or done and not any(n for _, n in done) or state.isEmpty():
            return state.select("source", "rate")
        before, state = done, state.select("source", "need", "rate")


def mixture(sizes: DataFrame, shares: DataFrame, weight: str | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id, source, tokens, repeats``: how often each document is used; documents used never are left out.

    Each document of a source is certain to be used ``copies`` times. The rest of the allotment is a Pareto sample with
    unequal inclusion probabilities in proportion to ``weight`` (by default the square root of the tokens, so that
    fragments give way to longer texts), documents whose probability reaches 1 being certain (``inclusion_rates``): by
    random odds u / (1 - u) over inclusion odds p / (1 - p), the least are taken until their tokens reach the allotment.
    The cut lies within half a document of it. Null and negative weights count as 0; such documents come last.
    """
    shares = F.broadcast(shares)  # one row a source of the targets table
    by = F.sqrt(F.col("tokens").cast("double")) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = sizes.join(shares.select("source", "copies", "fraction", "max_repeats", "available"), "source").filter("tokens > 0").withColumn("w", by)
    rates = F.broadcast(inclusion_rates(rows.filter("fraction > 0").select("source", "tokens", "w"), shares, F.col("w")))
    rows = rows.join(rates, "source", "left").withColumn("p", F.least(F.coalesce(F.col("rate") * F.col("w"), F.lit(0.0)), F.lit(1.0)))
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    odds = F.greatest(F.col("p"), F.lit(1e-12)) / (1 - F.least("p", F.lit(1 - 1e-12)))
    rows = rows.withColumn("u", u).withColumn("q", F.when(F.col("p") >= 1, 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / odds))
    # a monotone bin of the rank
    rows = rows.withColumn("bin", F.floor(F.lit(BINS) * F.col("q") / (1 + F.col("q"))).cast("int"))
    rows = cut_lineage(rows.select("doc_id", "source", "tokens", "copies", "fraction", "available", "q", "bin"))
    histogram = rows.filter("fraction > 0").groupBy("source", "bin").agg(F.sum("tokens").alias("n"))
    before = histogram.withColumn("upto", F.expr("sum(n) over (partition by source order by bin)")).withColumn("below", F.col("upto") - F.col("n"))
    need = shares.select("source", (F.col("fraction") * F.col("available")).alias("need"))
    # the bin in which the allotment ends, one row a source; sources that take all have none
    cut = before.join(need, "source").filter(F.col("upto") > F.col("need")).groupBy("source").agg(F.min(F.struct("bin", "below", "need")).alias("cut"))
    placed = rows.join(F.broadcast(cut), "source", "left")
    at_edge = (F.col("fraction") > 0) & F.col("cut").isNotNull() & (F.col("bin") == F.col("cut.bin"))
    clear = placed.filter(~at_edge).withColumn("more", ((F.col("fraction") > 0) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut.bin")))).cast("int"))
    edge = placed.filter(at_edge).withColumn("run", F.expr("cut.below + sum(tokens) over (partition by source order by q, doc_id)"))
    edge = edge.withColumn("more", (F.col("run") - F.col("tokens") / 2 <= F.col("cut.need")).cast("int")).drop("run")
    out = clear.unionByName(edge).withColumn("repeats", F.col("copies") + F.col("more"))
    return out.filter("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mixed_documents(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """The mixture of the documents by the targets; documents of sources that are not listed, or null, are not used."""
    sizes = _listed_sizes(docs, targets, vocabulary)
    return mixture(sizes, cut_lineage(allocation(sizes, targets, total)))


def _listed_sizes(docs: DataFrame, targets: DataFrame, vocabulary: str | None) -> DataFrame:
    wanted = targets.select(standard_source(F.col("source")).alias("__s")).distinct()
    kept = docs.join(F.broadcast(wanted), standard_source(F.col("source")) == F.col("__s"), "left_semi")
    return cut_lineage(document_sizes(kept, vocabulary).dropDuplicates(["doc_id"]))


def mixing_report(docs: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str | None = None) -> DataFrame:
    """``source, target_share, max_repeats, available, allotted, used_tokens, used_documents, most_repeats, actual_share``."""
    sizes = _listed_sizes(docs, targets, vocabulary)
    shares = cut_lineage(allocation(sizes, targets, total))
    used = mixture(sizes, shares).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("repeats").alias("most_repeats")
    )
    out = shares.join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_repeats"])
    return out.select(
        "source", "target_share", "max_repeats", "available", "allotted", "used_tokens", "used_documents", "most_repeats",
        F.expr("used_tokens / nullif(sum(used_tokens) over (), 0)").alias("actual_share"),
    )

"""Measures of retrieval and of answers over batches of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import references, retrieval, structure

KS = (5, 10, 20)
FINAL_K = 5
MRR_K = 20


def gold_references(golden: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """``id, ref_no, doc_id, scope, section, page`` and any ``more`` columns: one row per gold reference; repeated items count once."""
    items = golden.select("id", "gold", *more).dropDuplicates(["id"])
    return items.select("id", *more, F.posexplode("gold").alias("ref_no", "g")).select("id", "ref_no", "g.doc_id", "g.scope", "g.section", "g.page", *more)


def hit_matches(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs of a hit and a gold reference of its question that it satisfies: same document and scope, and a section
    at or under the gold one, or the gold page within its pages."""
    h, g = hits.alias("h"), refs.alias("g")
    same = (F.col("h.query_id") == F.col("g.id")) & (F.col("h.doc_id") == F.col("g.doc_id")) & F.col("h.scope").eqNullSafe(F.col("g.scope"))
    by_section = F.exists(F.col("h.sections"), lambda s: T.covers(s, F.col("g.section")))
    by_page = F.col("g.page").between(F.col("h.page_start"), F.col("h.page_end"))
    ok = F.when(F.col("g.section").isNotNull(), F.coalesce(by_section, F.lit(False))).otherwise(F.coalesce(by_page, F.lit(False)))
    return h.join(g, same).filter(ok).select("h.*", F.col("g.ref_no").alias("ref_no"))


def stage_scores(stages: DataFrame, refs: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS, mrr_k: int = MRR_K) -> DataFrame:
    """``query_id, stage, recall_k.., reciprocal_rank, first_rank`` for each question with gold and each stage."""
    return _scores(hit_matches(stages.join(_fields(chunks), "chunk_id"), refs), refs, ks, mrr_k)


def pool_scores(ranked: DataFrame, refs: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS, mrr_k: int = MRR_K) -> DataFrame:
    """The ``stage_scores`` of a pool: its rows meet chunks and references once, and only those that match go by stage.

    A question with another's id as ``searched_as`` in ``refs`` goes by the other's pool. Copies of a chunk match as often,
    which no least rank shows.
    """
    held = ranked.select("query_id", "chunk_id", "dense_rank", "sparse_rank", "fused_rank", "is_candidate", "final_rank").join(_rows(chunks), "chunk_id")
    if "searched_as" not in refs.columns:
        return _scores(retrieval.stage_rankings(hit_matches(held, refs), more=("ref_no",)), refs, ks, mrr_k)
    named = refs.select(F.col("searched_as").alias("id"), F.struct("id", "ref_no").alias("ref_no"), "doc_id", "scope", "section", "page")
    matched = retrieval.stage_rankings(hit_matches(held, named), more=("ref_no",))
    return _scores(matched.select(F.col("ref_no.id").alias("query_id"), "stage", "rank", "ref_no.ref_no"), refs, ks, mrr_k)


def _fields(chunks: DataFrame) -> DataFrame:
    return _rows(chunks).dropDuplicates(["chunk_id"])


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("id").alias("chunk_id"), "doc_id", "scope", "sections", "page_start", "page_end")


def _scores(matched: DataFrame, refs: DataFrame, ks: tuple[int, ...], mrr_k: int) -> DataFrame:
    asked = refs.groupBy("id").agg(F.count("*").alias("n_refs"))
    best = matched.groupBy("query_id", "stage", "ref_no").agg(F.min("rank").alias("rank"))
    per = best.groupBy("query_id", "stage").agg(F.min("rank").alias("first_rank"), *[F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks])
    names = F.explode(F.array(*[F.lit(s) for s in ("dense", "sparse", "fused", "reranked")])).alias("stage")
    grid = asked.select(F.col("id").alias("query_id"), "n_refs", names)
    joined = grid.join(per, ["query_id", "stage"], "left")
    recall = [(F.coalesce(F.col(f"n_{k}"), F.lit(0)) / F.col("n_refs")).alias(f"recall_{k}") for k in ks]
    rr = F.coalesce(F.when(F.col("first_rank") <= mrr_k, 1 / F.col("first_rank")), F.lit(0.0)).alias("reciprocal_rank")
    return joined.select("query_id", "stage", *recall, rr, "first_rank")


def stage_summary(scores: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mean recall and reciprocal rank per stage, and per value of further columns in the same pass."""
    means = [F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in ks] + [F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.count("*").alias("questions")]
    if not by:
        return scores.groupBy("stage").agg(*means)
    sets = [[F.col("stage")]] + [[F.col("stage"), F.col(c)] for c in by]
    return scores.groupingSets(sets, F.col("stage"), *[F.col(c) for c in by]).agg(*means)


def diagnosis(fused_first: Column, final_first: Column, reranked: Column, candidates: int = 20, final_k: int = FINAL_K) -> Column:
    """Where a question's evidence was lost."""
    return (
        F.when(final_first <= final_k, "ok").when(fused_first.isNull(), "not_retrieved").when(fused_first > candidates, "below_cutoff")
        .when(reranked, "lost_in_rerank").otherwise("missed_without_rerank")
    )


def question_diagnosis(scores: DataFrame, reranked: bool = True) -> DataFrame:
    """``query_id, diagnosis`` of the scores by stage."""
    return scores.groupBy("query_id").agg(_diagnosed(reranked))


def _diagnosed(reranked: bool = True) -> Column:
    first = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("first_rank")))
    return diagnosis(first("fused"), first("reranked"), F.lit(reranked)).alias("diagnosis")


def threshold_sweep(scores: DataFrame, score: str, positive: str) -> DataFrame:
    """``threshold, accuracy``: balanced accuracy of ``score >= threshold`` for each observed score.

    Scores are counted first; the cumulative counts run over distinct scores by range partitions with offsets, so no
    task sees them all. Empty unless both classes occur.
    """
    counted = scores.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n")
    )
    bins = counted.withColumn("bin", F.floor(F.col("threshold") * 1000))
    offset = bins.groupBy("bin").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    # one row a bin: at most the range of the scores in thousandths
    offset = offset.select("bin", F.expr("sum(bp) over (order by bin) - bp").alias("p0"), F.expr("sum(bn) over (order by bin) - bn").alias("n0"), F.expr("sum(bp) over ()").alias("ps"), F.expr("sum(bn) over ()").alias("ns"))
    inside = bins.withColumn("pb", F.expr("sum(p) over (partition by bin order by threshold) - p")).withColumn("nb", F.expr("sum(n) over (partition by bin order by threshold) - n"))
    joined = inside.join(offset, "bin").filter("ps > 0 AND ns > 0")
    hit, rejected = (F.col("ps") - F.col("p0") - F.col("pb")) / F.col("ps"), (F.col("n0") + F.col("nb")) / F.col("ns")
    return joined.select("threshold", ((hit + rejected) / 2).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of greatest accuracy; the lowest among equals."""
    return sweep.orderBy(F.desc(F.round("accuracy", 12)), "threshold").limit(1)


def outcome(error: Column, answerable: Column, covered: Column, judged: Column, judge_failed: Column) -> Column:
    return (
        F.when(error.isNotNull(), "error")
        .when(~answerable, F.when(covered, "hallucinated").otherwise("correct_refusal"))
        .when(~covered, "false_refusal").when(judge_failed, "judge_error").otherwise("answered")
    )


def outcome_score(name: Column, verdict: Column) -> Column:
    return F.when(name.isin("error", "hallucinated", "false_refusal"), 0.0).when(name == "correct_refusal", 1.0).when(name == "answered", T.verdict_score(verdict))


def citation_precision(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """``run_id, id, citation_precision``: verified citations whose chunk fits a gold reference over verified ones."""
    good = citations.filter("verified")
    right = good.alias("c").join(
        refs.alias("g"), (F.col("c.id") == F.col("g.id")) & F.col("c.scope").eqNullSafe(F.col("g.scope"))
        & F.coalesce(F.exists(F.col("c.sections"), lambda s: T.covers(s, F.col("g.section"))), F.lit(False)), "left_semi")
    n = good.groupBy("run_id", "id").count().withColumnRenamed("count", "n")
    m = right.groupBy("run_id", "id").count().withColumnRenamed("count", "m")
    return n.join(m, ["run_id", "id"], "left").select("run_id", "id", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("citation_precision"))


def percentiles(rows: DataFrame, by: str, measures: dict[str, tuple[Column, float]]) -> DataFrame:
    """``by`` and one column per measure: the value at place ``int(q * n)`` of a group's values in order.

    Values are counted first, and places are found among the distinct ones; no group is collected. Nulls do not count.
    """
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit(q).alias("q")) for name, (value, q) in measures.items()])).alias("x")
    counted = rows.select(by, each).select(by, "x.*").filter("value IS NOT NULL").groupBy(by, "name", "q", "value").agg(F.count("*").alias("k"))
    group = Window.partitionBy(by, "name")
    placed = counted.withColumn("last", F.sum("k").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(group))
    found = placed.filter(F.col("last") > F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n")))).groupBy(by, "name").agg(F.min("value").alias("value"))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in measures])


def generation_summary(results: DataFrame, by: str = "run_id", steps: tuple[str, ...] = ("retrieve", "llm"), model_step: str = "llm") -> DataFrame:
    """Counts, rates, means and percentiles of a run; rates to three places, times to one.

    Scores, precision and recall are means over answerable questions that have one; judged are answerable ones with a
    verdict; groundedness is taken over covered answers without an error; latency is the sum of ``steps``.
    """
    rows = results.dropDuplicates(["run_id", "id"])
    yes, covered = F.coalesce("answerable", F.lit(False)), F.coalesce("covered", F.lit(False)) & F.col("error").isNull()
    judged = yes & F.col("judge").isNotNull()
    rate = lambda cond, of: F.round(F.avg(F.when(of, F.coalesce(cond, F.lit(False)).cast("double"))), 3)
    mean = lambda c, of: F.round(F.avg(F.when(of, F.col(c))), 3)
    verdict = lambda name: F.count_if(judged & (F.col("judge.verdict") == name))
    step = lambda name: F.coalesce(F.try_element_at("timings_ms", F.lit(name)), F.lit(0.0))
    total = step(steps[0])
    for name in steps[1:]:
        total = total + step(name)
    cites = F.col("citations")
    good = F.size(F.filter(cites, lambda c: F.coalesce(c["verified"], F.lit(False))))
    places = percentiles(rows, by, {"latency_p50": (total, 0.5), "latency_p95": (total, 0.95), "llm_p50": (step(model_step), 0.5)})
    places = places.select(F.col(by).alias("__by"), *[F.round(c, 1).alias(c) for c in ("latency_p50", "latency_p95", "llm_p50")])
    summed = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(yes).alias("answerable"), mean("score", yes).alias("answer_score"),
        verdict("correct").alias("correct"), verdict("partial").alias("partial"), verdict("incorrect").alias("incorrect"),
        rate(F.col("judge.overstated"), judged).alias("overstated_rate"), rate(F.col("judge.missing_condition"), judged).alias("missing_condition_rate"),
        rate(F.col("judge.contradicts_reference"), judged).alias("contradicts_rate"),
        rate(F.col("outcome") == "false_refusal", yes).alias("false_refusal_rate"), rate(F.col("outcome") == "correct_refusal", ~yes).alias("refusal_accuracy"),
        rate(F.col("grounded"), covered).alias("grounded_rate"),
        F.round(F.sum(F.greatest(good, F.lit(0))) / F.nullif(F.sum(F.greatest(F.size(cites), F.lit(0))), F.lit(0)), 3).alias("citation_verified_rate"),
        mean("citation_precision", yes).alias("citation_precision"), mean("context_recall", yes).alias("context_recall"),
        F.count_if(F.col("outcome").isin("error", "judge_error")).alias("errors"),
        F.round(F.avg("completion_tokens"), 3).alias("completion_tokens_mean"),
    )
    return summed.join(places, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def labelled_results(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Judged results with ``label``, the last by ``seq`` that people gave the same answer (``id, answer_hash``)."""
    last = labels.groupBy("id", "answer_hash").agg(F.max_by(F.struct("verdict", "overstated", "missing_condition"), "seq").alias("label"))
    return results.filter("judge IS NOT NULL").join(last, ["id", "answer_hash"])


def judge_agreement(results: DataFrame, labels: DataFrame) -> DataFrame:
    """``compared, verdict, overstated, missing_condition``: shares in which judge and labels agree."""
    both = labelled_results(results, labels)
    same = lambda f: F.round(F.avg((F.col(f"judge.{f}").eqNullSafe(F.col(f"label.{f}"))).cast("double")), 3)
    return both.agg(F.count("*").alias("compared"), same("verdict").alias("verdict"), same("overstated").alias("overstated"), same("missing_condition").alias("missing_condition"))


def judge_disagreements(results: DataFrame, labels: DataFrame) -> DataFrame:
    """``run_id, id, disagreement``: each verdict that people saw otherwise, with both and the judge's reasons in short."""
    other = labelled_results(results, labels).filter(~F.col("judge.verdict").eqNullSafe(F.col("label.verdict")))
    line = F.concat("id", F.lit(": human="), F.coalesce("label.verdict", F.lit("")), F.lit(" judge="), F.coalesce("judge.verdict", F.lit("")), F.lit(" ("), F.substring(F.coalesce("judge.explanation", F.lit("")), 1, 80), F.lit(")"))
    return other.select("run_id", "id", line.alias("disagreement"))


def golden_profile(golden: DataFrame, columns: tuple[str, ...] = ("status", "type", "lang", "source", "split")) -> DataFrame:
    """``field, value, n``: how many items have each value of each column, in one pass."""
    rows = golden.dropDuplicates(["id"]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x"))
    return rows.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def label_sample(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n rows first by the hash of their id."""
    return rows.orderBy(F.sha2(F.col(key), 256)).limit(n)


def longest_shared_run(pairs: DataFrame, key: list[str], left: str, right: str) -> DataFrame:
    """``key, run``: the most consecutive words that two texts share, by runs on the diagonals of equal words.

    For stated pairs of short texts: words meet within their pair only.
    """
    a = pairs.select(*key, F.posexplode(T.tokens(F.col(left))).alias("i", "w"))
    b = pairs.select(*key, F.posexplode(T.tokens(F.col(right))).alias("j", "w"))
    met = a.join(b, [*key, "w"]).select(*key, (F.col("j") - F.col("i")).alias("d"), "i")
    runs = met.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy(*key, "d").orderBy("i"))).groupBy(*key, "d", "g").agg(F.count("*").alias("n"))
    best = runs.groupBy(*key).agg(F.max("n").alias("run"))
    return pairs.select(*key).join(best, key, "left").select(*key, F.coalesce("run", F.lit(0)).alias("run"))


def unknown_gold_documents(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold references whose document the corpus lacks."""
    return refs.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def gold_text(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """``id, ref_no, text``: the body text that each gold reference names.

    Unnumbered blocks go with the number before them while the scope lasts; page references take the page's blocks of
    the scope. One frame a scope run; then each block stands for the numbers over it and for its page, so that an
    equality join on document, scope and place makes a pair only where it is wanted.
    """
    delivered = blocks.filter("role = 'body'")
    body = structure.with_scope_runs(delivered.dropDuplicates(["id"]), delivered)
    carried = body.withColumn("under", F.last("section_number", ignorenulls=True).over(Window.partitionBy("doc_id", "run").orderBy("ordinal")))
    # a numbered block stands under its own number and those over it; a block of any kind on its page
    own = carried.select("doc_id", F.coalesce("scope", F.lit("")).alias("scope_key"), "ordinal", "text", "under", F.concat(F.lit("p"), F.col("page_number").cast("string")).alias("page_key"))
    parts = F.split("under", r"\.")
    over = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("s"), F.array_join(F.slice(parts, F.lit(1), n), ".")))
    places = F.array_compact(F.concat(F.coalesce(F.when(F.col("under").isNotNull(), over), F.array().cast("array<string>")), F.array("page_key")))
    placed = own.select("doc_id", "scope_key", "ordinal", "text", F.explode(F.array_distinct(places)).alias("place"))
    sought = F.coalesce(F.concat(F.lit("s"), F.col("section")), F.concat(F.lit("p"), F.col("page").cast("string")))
    asked = refs.select("id", "ref_no", "doc_id", F.coalesce("scope", F.lit("")).alias("scope_key"), sought.alias("place"))
    # the texts of one gold reference
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    met = placed.join(asked, ["doc_id", "scope_key", "place"])
    return met.groupBy("id", "ref_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def question_records(ranked: DataFrame, golden: DataFrame, chunks: DataFrame, scores: DataFrame, final_k: int = FINAL_K) -> DataFrame:
    """The record of each question asked: ``query_id, type, lang, split, question, top1_rerank, top_hits, stages,
    diagnosis``.

    ``ranked``: the pool with final ranks and rerank scores; ``scores``: of each stage (see ``stage_scores``). A question
    without gold has no stages and no diagnosis, one without hits no score.
    """
    kept = ranked.filter(F.col("is_candidate") & (F.col("final_rank") <= final_k)).select("query_id", "chunk_id", "final_rank", "rerank_score")
    fields = chunks.select(F.col("id").alias("chunk_id"), references.hit_label(F.col("scope"), F.col("sections"), F.col("page_start")).alias("label")).dropDuplicates(["chunk_id"])
    # at most final_k rows a question
    named = F.array_sort(F.collect_list(F.struct("final_rank", "label")))
    tops = kept.join(fields, "chunk_id").groupBy("query_id").agg(F.max(F.when(F.col("final_rank") == 1, F.col("rerank_score"))).alias("top1_rerank"), F.transform(named, lambda h: h["label"]).alias("top_hits"))
    measures = [c for c in scores.columns if c not in ("query_id", "stage")]
    stages = scores.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("stage"), F.struct(*measures).alias("score"))))).alias("stages"), _diagnosed())
    items = golden.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), "type", "lang", "split", "question")
    asked = items.join(ranked.select("query_id").distinct(), "query_id", "left_semi")
    joined = asked.join(tops, "query_id", "left").join(stages, "query_id", "left")
    none = F.array().cast("array<string>")
    return joined.select("query_id", "type", "lang", "split", "question", "top1_rerank", F.coalesce("top_hits", none).alias("top_hits"), "stages", "diagnosis")


def gold_evidence(gold_texts: DataFrame, refs: DataFrame) -> DataFrame:
    """``id, evidence``: the gold texts of each item under their labels, in order; a reference without text has its label."""
    named = refs.join(gold_texts, ["id", "ref_no"], "left")
    part = F.concat(F.lit("["), references.gold_label(F.col("scope"), F.col("section"), F.col("page")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    # the references of one item
    parts = F.array_sort(F.collect_list(F.struct("ref_no", part.alias("t"))))
    return named.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("evidence"))


def context_recall(context: DataFrame, refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``id, context_recall``: the share of an item's gold references that any chunk of its context satisfies."""
    met = hit_matches(context.select("query_id", "chunk_id").join(_fields(chunks), "chunk_id"), refs).select(F.col("query_id").alias("id"), "ref_no").distinct()
    found = met.groupBy("id").agg(F.count("*").alias("found"))
    return refs.groupBy("id").agg(F.count("*").alias("n")).join(found, "id", "left").select("id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("context_recall"))


def judge_input(question: Column, reference: Column, evidence: Column, answer: Column, citations: Column) -> Column:
    """What a judge reads: question, reference answer, gold evidence, answer, and verified quotations only."""
    quotes = F.array_join(F.transform(F.filter(citations, lambda c: F.coalesce(c["verified"], F.lit(False))), lambda c: F.concat(F.lit("- "), c["quote"])), "\n")
    part = lambda name, c: F.concat(F.lit(f"{name}:\n"), F.coalesce(c, F.lit("(none)")))
    return F.concat_ws("\n\n", part("Question", question), part("Reference", reference), part("Evidence", evidence), part("Answer", answer), part("Quotations", quotes))

"""The engine's jobs end to end: annotate, chunk, index, search, ask, evaluate. Each takes and gives DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.operators import answers, chunking, evaluation, index, layout, references, retrieval, structure
from quillspark.session import cut_lineage

BLOCK_FIELDS = (
    "doc_id", "ordinal", "id", "text", "page_number", "bbox", "font_size", "is_bold", "role", "heading_level", "block_type", "section_number", "scope", "breadcrumb",
)


def annotate_blocks(raw: DataFrame, pages: DataFrame | None = None, layout_config: layout.LayoutConfig = layout.LayoutConfig(), styles: layout.StyleConfig = layout.StyleConfig()) -> DataFrame:
    """The block table of raw blocks (``doc_id, page_number, block_no, text, bbox, font_size, is_bold``).

    Furniture is learned from all blocks, short ones too; footnotes, contents lines and noise follow; styles, scopes and
    sections come from the body that is left. Ids number the blocks of a document in page order.
    """
    place = F.expr("row_number() over (partition by doc_id order by page_number, block_no) - 1")
    blocks = raw.withColumn("ordinal", place.cast("int")).withColumn("id", F.format_string("%s:%05d", "doc_id", "ordinal")).withColumn("role", F.lit("body"))
    tagged = layout.furniture(blocks, pages, layout_config).withColumn("role", F.col("tagged")).select(*blocks.columns)
    if pages is not None:
        noted = layout.footnotes(tagged, pages, layout_config)
        tagged = noted.withColumn("role", F.when(F.col("is_footnote"), "footnote").otherwise(F.col("role"))).select(*blocks.columns)
    tagged = layout.contents_and_noise(tagged, layout_config).withColumn("role", F.col("retagged")).select(*blocks.columns)
    leveled = cut_lineage(layout.with_heading_levels(tagged, styles).withColumn("heading_level", F.when(F.col("role") == "body", F.col("style_level"))).drop("style_level"))
    crumbs = structure.breadcrumbs(leveled).select("id", F.col("scope"), F.col("number").alias("section_number"), "is_title", F.col("crumbs"))
    joined = leveled.join(crumbs, "id", "left")
    kind = F.when(F.col("role") == "body", F.when(F.col("heading_level").isNotNull() | F.col("is_title"), "heading").otherwise("text"))
    crumb = F.when(F.col("scope").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array("scope"), F.coalesce("crumbs", F.array().cast("array<string>"))))
    return joined.withColumn("block_type", kind).withColumn("breadcrumb", crumb).select(*BLOCK_FIELDS)


def chunk_blocks(blocks: DataFrame, config: chunking.ChunkerConfig = chunking.ChunkerConfig(), count: Callable[[str], int] = chunking.count_words) -> DataFrame:
    """Chunks with the scope titles that the documents end up with; see ``chunking.chunking_report`` for the run's report."""
    return chunking.chunk_documents(blocks, structure.final_scope_heads(blocks), config, count)


def update_index(chunks: DataFrame, existing: DataFrame, make: Callable[[], models.Embedder], model: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """``(index, report)``: only new and changed chunks are embedded; unchanged ones keep their vectors."""
    current = index.points(chunks, model)
    diff = cut_lineage(index.index_diff(current, existing))
    todo = current.join(diff.filter("action IN ('insert', 'update')").select("point_id"), "point_id", "left_semi")
    texts = chunks.select(F.col("id").alias("chunk_id"), "embed_text").dropDuplicates(["chunk_id"])
    fresh = models.embed_texts(todo.join(texts, "chunk_id"), make, dims).drop("embed_text")
    gone = diff.filter("action <> 'unchanged'").select("point_id")
    kept = existing.join(gone, "point_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), index.index_report(diff)


def ask(questions: DataFrame, chunks: DataFrame, call: Callable[[str], str], config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(), context_k: int = 10) -> DataFrame:
    """``query_id, question, answer, covered, error, citations`` with each citation's chunk and whether it is verified.

    ``questions``: query_id, question. One failed call is a row with an error.
    """
    return ask_with_context(questions, chunks, call, config, context_k)[0]


def ask_with_context(questions: DataFrame, chunks: DataFrame, call: Callable[[str], str], config: retrieval.RetrievalConfig, context_k: int) -> tuple[DataFrame, DataFrame]:
    """The answers (see ``ask``) and the context that each was given."""
    corpus = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("text"), F.coalesce("embed_text", F.lit("")).alias("passage")).dropDuplicates(["chunk_id"])
    asked = questions.select("query_id", F.col("question").alias("query"))
    pool = cut_lineage(retrieval.hybrid_search(asked, corpus, config))
    context = cut_lineage(references.build_context(retrieval.final_hits(pool, config, context_k), chunks, context_k))
    replies = models.ask(references.render_prompts(questions, context, chunks), call)
    parsed = cut_lineage(answers.parse_replies(replies).withColumn("error", F.coalesce("call_error", "error")))
    cites = parsed.select("query_id", F.posexplode("citations").alias("seq", "c")).select("query_id", "seq", F.col("c.chunk").alias("label"), F.col("c.quote").alias("quote"))
    named = cites.join(context.select("query_id", "label", "chunk_id"), ["query_id", "label"], "left")
    checked = answers.verify_citations(named, chunks).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", "label", "quote", "chunk_id", "verified"))).alias("citations"))
    return parsed.select("query_id", "answer", "covered", "error").join(questions, "query_id").join(checked, "query_id", "left"), context


def evaluate_generation(
    golden: DataFrame, chunks: DataFrame, blocks: DataFrame, call: Callable[[str], str], judge: Callable[[str], str] | None = None, cache: DataFrame | None = None, judge_model: str = "", limit: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """``(results, new verdicts)``: every golden item is asked and its answer scored.

    An answer that claims coverage of an answerable item is judged against the item's gold text, once per distinct
    input that ``cache`` (``key, judge``) lacks; without a judge it is unscored. The new verdicts are to be appended to the cache.
    """
    items = golden.filter("question IS NOT NULL").dropDuplicates(["id"])
    items = items if limit is None else items.orderBy("id").limit(limit)
    refs = evaluation.gold_references(items)
    said, context = ask_with_context(items.select(F.col("id").alias("query_id"), "question"), chunks, call, retrieval.RetrievalConfig(), 10)
    fields = chunks.select(F.col("id").alias("chunk_id"), "scope", "sections").dropDuplicates(["chunk_id"])
    said = cut_lineage(said.withColumnRenamed("query_id", "id"))
    cited = said.select("id", F.explode("citations").alias("c")).select("id", "c.chunk_id", "c.verified").join(fields, "chunk_id", "left").withColumn("run_id", F.lit(""))
    precision = evaluation.citation_precision(cited, refs).drop("run_id")
    recall = evaluation.context_recall(context, refs, chunks)
    evidence = evaluation.gold_evidence(evaluation.gold_text(blocks, refs), refs)
    facts = items.select("id", "type", "lang", "split", F.col("answer").alias("reference"), (F.size("gold") > 0).alias("answerable"))
    joined = facts.join(said, "id").join(precision, "id", "left").join(recall, "id", "left").join(evidence, "id", "left")
    prompt = evaluation.judge_input(F.col("question"), F.col("reference"), F.col("evidence"), F.col("answer"), F.col("citations"))
    joined = joined.withColumn("prompt", prompt).withColumn("key", answers.cache_key(F.lit(answers.JUDGE_PROMPT_VERSION), F.lit(judge_model), F.col("prompt")))
    due = F.col("error").isNull() & F.col("answerable") & F.col("covered")
    new = None
    if judge is None:
        judged = joined.withColumn("judge", F.lit(None).cast(f"struct<{answers.VERDICT}>")).withColumn("judge_error", F.lit(None).cast("string"))
    else:
        store = said.sparkSession.createDataFrame([], f"key string, judge struct<{answers.VERDICT}>") if cache is None else cache
        checked, new = answers.judge_answers(cut_lineage(joined.filter(due).select("id", "key", "prompt")), store, judge)
        judged = joined.join(checked.select("id", "judge", "judge_error"), "id", "left")
    name = evaluation.outcome(F.col("error"), F.col("answerable"), F.col("covered"), F.col("judge.verdict"), F.col("judge_error").isNotNull())
    good = F.filter(F.coalesce("citations", F.array()), lambda c: c["verified"])
    results = judged.withColumn("outcome", name).select(
        "id", "type", "lang", "split", "question", "answerable", "outcome", evaluation.outcome_score(F.col("outcome"), F.col("judge.verdict")).alias("score"), "covered",
        answers.is_grounded(F.col("covered"), F.col("citations")).alias("grounded"), "answer", T.answer_hash(F.coalesce("answer", F.lit(""))).alias("answer_hash"), "citations",
        F.size(good).alias("citations_verified"), F.when(F.col("answerable"), F.col("citation_precision")).alias("citation_precision"), "context_recall", "judge",
        F.coalesce("error", "judge_error").alias("error"), "prompt",
    )
    return results, new


def evaluate_retrieval(golden: DataFrame, chunks: DataFrame, config: retrieval.RetrievalConfig = retrieval.RetrievalConfig(), split: str | None = None, status: str | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Scores per question and stage, their summaries by type and language, the diagnosis and the record of each question.

    ``limit`` takes the first so many items by id, for a trial run.
    """
    items = golden.dropDuplicates(["id"])
    for column, value in (("split", split), ("status", status)):
        items = items if value is None else items.filter(F.col(column) == value)
    items = items if limit is None else items.orderBy("id").limit(limit)
    asked = items.filter("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    corpus = chunks.select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("text"), F.coalesce("embed_text", F.lit("")).alias("passage")).dropDuplicates(["chunk_id"])
    pool = cut_lineage(retrieval.hybrid_search(asked, corpus, config))
    stages = retrieval.stage_rankings(pool)
    scores = cut_lineage(evaluation.stage_scores(stages, evaluation.gold_references(items), chunks))
    kinds = items.select(F.col("id").alias("query_id"), "type", "lang")
    return {"scores": scores, "summary": evaluation.stage_summary(scores.join(kinds, "query_id"), by=["type", "lang"]), "diagnosis": evaluation.question_diagnosis(scores),
            "records": evaluation.question_records(pool, items, chunks, scores)}


@dataclass(frozen=True)
class Settings:
    """What a pipeline is made of: the folder of the chunks and the endpoint of the answering model."""

    chunks: str
    url: str = "http://localhost:8000/v1"
    model: str = ""
    key: str | None = None
    timeout: float = 120.0
    max_tokens: int = 1024
    context_k: int = 10
    retrieval: retrieval.RetrievalConfig = retrieval.RetrievalConfig()


class Pipeline:
    """Batches of questions against one chunk store with one configuration."""

    def __init__(self, chunks: DataFrame, call: Callable[[str], str], settings: Settings):
        self.chunks, self.call, self.settings = chunks, call, settings

    def search(self, questions: DataFrame) -> DataFrame:
        """The final hits of ``query_id, question``."""
        corpus = self.chunks.select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("text"), F.coalesce("embed_text", F.lit("")).alias("passage")).dropDuplicates(["chunk_id"])
        ranked = retrieval.hybrid_search(questions.select("query_id", F.col("question").alias("query")), corpus, self.settings.retrieval)
        return retrieval.final_hits(ranked, self.settings.retrieval)

    def ask(self, questions: DataFrame) -> DataFrame:
        """The answers to ``query_id, question`` (see ``ask``)."""
        return ask(questions, self.chunks, self.call, self.settings.retrieval, self.settings.context_k)


def build_pipeline(spark: SparkSession, settings: Settings, call: Callable[[str], str] | None = None) -> Pipeline:
    """The pipeline of the settings; ``call`` stands in for the endpoint. A store without chunks is an error at once."""
    chunks = spark.read.parquet(settings.chunks)
    if chunks.isEmpty():
        raise ValueError(f"{settings.chunks} holds no chunks")
    endpoint = models.ChatEndpoint(settings.url, settings.model, settings.timeout, settings.max_tokens, settings.key)
    return Pipeline(chunks, call or endpoint, settings)

"""The queries of the engine's operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers, chunking, evaluation, index, layout, references, retrieval, structure
from quillspark.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "blocks").dropDuplicates(["id"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["id"])


def _golden(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "golden").dropDuplicates(["id"])


def _results(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gen_results").dropDuplicates(["run_id", "id"])


# --- text functions


@query
def normalize_text(s, d):
    return table(s, d, "blocks").select("id", T.normalize_text(F.col("text")).alias("norm")).distinct()


@query
def normalize_pattern(s, d):
    return table(s, d, "blocks").select("id", T.pattern_key(F.col("text")).alias("pattern")).distinct()


@query
def doc_slug(s, d):
    return table(s, d, "documents").select("doc_id", T.slug(F.coalesce("title", F.lit(""))).alias("slug"))


@query
def section_numbers(s, d):
    return table(s, d, "blocks").select("id", T.section_number(F.col("text")).alias("number"), F.size(T.number_path(T.section_number(F.col("text")))).alias("depth")).distinct().filter("number IS NOT NULL")


@query
def scope_names(s, d):
    return table(s, d, "blocks").select("id", T.scope_name(F.col("text")).alias("scope_name")).filter("scope_name IS NOT NULL").distinct()


@query
def heading_labels(s, d):
    rest = T.strip(F.regexp_replace("text", r"^\s*\p{Nd}+(?:\.\p{Nd}+)*\.", ""))
    return table(s, d, "blocks").filter("section_number IS NOT NULL").select("id", T.is_label(rest).alias("is_label")).distinct()


@query
def sentence_split(s, d):
    rows = _blocks(s, d).filter("role = 'body'")
    return rows.select("id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query
def word_tokens(s, d):
    words = table(s, d, "chunks").select("id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).distinct()
    return words.groupBy("term").agg(F.count("*").alias("chunks"))


@query
def token_stats(s, d):
    return chunking.chunk_report(_chunks(s, d).withColumn("words", T.word_count(F.col("embed_text"))), tokens="words")


@query
def text_sha256(s, d):
    return table(s, d, "chunks").select("id", T.text_sha(F.col("embed_text")).alias("sha")).distinct()


@query
def answer_hashes(s, d):
    return table(s, d, "gen_results").select("run_id", "id", T.answer_hash(F.coalesce("answer", F.lit(""))).alias("hash")).distinct()


@query
def point_ids(s, d):
    return table(s, d, "chunks").select("id", T.point_id(F.col("id")).alias("point_id")).distinct()


@query
def golden_split(s, d):
    return table(s, d, "golden").select("id", T.split_percent(F.col("id")).alias("percent"), T.golden_split(F.col("id")).alias("derived_split")).distinct()


@query
def label_sample(s, d):
    return evaluation.label_sample(_golden(s, d).select("id"), 50)


@query
def header_render(s, d):
    return table(s, d, "chunks").select("id", T.chunk_header(F.col("doc_id"), F.col("section_path")).alias("header")).distinct()


@query
def common_paths(s, d):
    paths = F.array_sort(F.collect_list("section_path"))
    return _chunks(s, d).groupBy("doc_id", "scope").agg(paths.alias("paths")).select("doc_id", "scope", F.array_join(T.common_prefix(F.col("paths")), " > ").alias("shared"))


@query
def hit_labels(s, d):
    line = references.source_line(F.col("doc_id"), F.col("scope"), F.col("sections"), F.col("page_start"), F.col("page_end"))
    return table(s, d, "chunks").select("id", line.alias("source"), references.hit_label(F.col("scope"), F.col("sections"), F.col("page_start")).alias("hit")).distinct()


@query
def gold_labels(s, d):
    refs = evaluation.gold_references(_golden(s, d))
    return refs.select("id", "ref_no", references.gold_label(F.col("scope"), F.col("section"), F.col("page")).alias("label"))


# --- layout, styles, structure


@query
def edge_zones(s, d):
    zoned = layout.edge_zone(layout.with_page_size(_blocks(s, d), None))
    return zoned.filter("edge IS NOT NULL").select("id", "edge", "edge_band")


@query
def repeated_lines(s, d):
    return layout.repeated_patterns(layout.edge_zone(layout.with_page_size(_blocks(s, d), None)))


@query
def running_furniture(s, d):
    return layout.furniture(_blocks(s, d)).select("id", "tagged")


@query
def body_font_size(s, d):
    return layout.body_font_size(_blocks(s, d))


@query
def toc_noise_roles(s, d):
    return layout.contents_and_noise(_blocks(s, d)).select("id", F.col("retagged").alias("role"))


@query
def role_counts(s, d):
    return layout.role_counts(_blocks(s, d)).select("doc_id", F.explode("role_counts").alias("role", "n"))


@query
def heading_styles(s, d):
    return layout.heading_styles(_blocks(s, d))


@query
def structure_scopes(s, d):
    return structure.section_events(table(s, d, "blocks")).select("id", "segment", F.col("scope_now").alias("scope_found"), F.col("number").alias("number_found"))


@query
def scope_titles(s, d):
    return structure.scopes(table(s, d, "blocks"))


@query
def breadcrumbs(s, d):
    found = structure.breadcrumbs(table(s, d, "blocks"))
    return found.select("id", F.array_join("crumbs", " > ").alias("crumbs"))


@query
def backward_jumps(s, d):
    """Jumps of every document as it stands and read from its end, where the numbers fall."""
    blocks = table(s, d, "blocks")
    turned = blocks.withColumn("id", F.concat("id", F.lit("-turned"))).withColumn("doc_id", F.concat("doc_id", F.lit("-turned"))).withColumn("ordinal", -F.col("ordinal"))
    return structure.backward_jumps(blocks.unionByName(turned))


@query
def outline(s, d):
    rows = _blocks(s, d).filter("role = 'body' AND block_type = 'heading'")
    return rows.groupBy("doc_id", "scope", "heading_level").agg(F.count("*").alias("headings"), F.min("ordinal").alias("first_ordinal"))


@query
def document_chars(s, d):
    """The text of each document, joined by blank lines, by its size and hash."""
    return structure.document_text(table(s, d, "blocks")).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("hash"))


# --- chunking


@query
def chunk_documents(s, d):
    return chunking.chunk_documents(table(s, d, "blocks"))


@query
def chunk_pack(s, d):
    sized = _blocks(s, d).filter("role = 'body'").withColumn("words", T.word_count(F.col("text")))
    return chunking.pack_additive(sized, ["doc_id"], "ordinal", "words", 350)


@query
def excluded_scopes(s, d):
    return chunking.included_blocks(table(s, d, "blocks")).groupBy("doc_id", "scope").agg(F.count("*").alias("kept"))


@query
def chunk_report(s, d):
    """The report of the run, with what every document must keep: its blocks and its words."""
    blocks = table(s, d, "blocks")
    made = cut_lineage(chunking.chunk_documents(blocks))
    held = made.groupBy("doc_id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.countDistinct("scope").alias("scopes"), F.max("token_count").alias("largest"))
    ids = made.select("doc_id", F.explode("block_ids").alias("b")).groupBy("doc_id").agg(F.countDistinct("b").alias("held_blocks"))
    report = chunking.chunking_report(blocks, made).select("doc_id", "input_blocks", "excluded_blocks")
    return report.join(held, "doc_id").join(ids, "doc_id").select("doc_id", "input_blocks", "excluded_blocks", "words", "scopes", (F.col("largest") <= 512).alias("within"), "held_blocks")


# --- index


def _versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The chunks and an earlier state of the index: some changed, some missing, some stale, one document not touched."""
    now = index.points(table(s, d, "chunks"), "model-1")
    mark = F.conv(F.substring(T.text_sha(F.col("chunk_id")), 1, 6), 16, 10).cast("int") % 1001
    old = now.withColumn("m", mark).filter("m % 11 <> 0").withColumn("text_sha256", F.when(F.col("m") % 7 == 0, F.lit("old")).otherwise(F.col("text_sha256")))
    stale = now.withColumn("m", mark).filter("m % 13 = 0").withColumn("point_id", F.concat("point_id", F.lit("-stale")))
    return now, old.unionByName(stale).drop("m")


@query
def index_diff(s, d):
    return index.index_diff(*_versions(s, d))


@query
def index_report(s, d):
    return index.index_report(index.index_diff(*_versions(s, d)))


@query
def point_count(s, d):
    return index.point_counts(index.points(table(s, d, "chunks"), "model-1"))


# --- retrieval


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    asked = rows.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return asked, rows


@query
def dense_topk(s, d):
    return retrieval.dense_ranking(*_vectors(s, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query
def dense_topk_filtered(s, d):
    asked, rows = _vectors(s, d)
    named = rows.withColumn("doc_id", F.concat(F.lit("label-"), F.col("label").cast("string")))
    return retrieval.dense_ranking(asked, retrieval.search_filter(named, doc_ids=["label-1", "label-3"]), k=10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The stated query set: every golden question whose number is divisible by 50."""
    mine = F.col("id").rlike("^q") & (F.substring("id", 2, 9).cast("int") % 50 == 0)
    return _golden(s, d).filter(mine & F.col("question").isNotNull())


def _questions(s: SparkSession, d: str) -> DataFrame:
    return _asked(s, d).select(F.col("id").alias("query_id"), F.col("question").alias("query"))


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("text"))


@query
def sparse_topk(s, d):
    terms = _questions(s, d).select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query")))).alias("term"))
    return retrieval.overlap_ranking(terms, _corpus(s, d)).select("query_id", "chunk_id", "rank", "score")


def _pool(s: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid_search(_questions(s, d), _corpus(s, d))


@query
def rrf_fusion(s, d):
    return _pool(s, d).select("query_id", "chunk_id", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"), "fused_rank", "is_candidate")


@query
def hybrid_search(s, d):
    return retrieval.final_hits(_pool(s, d)).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "fused_rank", "rerank_score", "final_rank")


@query
def stage_rankings(s, d):
    return retrieval.stage_rankings(_pool(s, d))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Questions without gold have no scores, so they are not searched for; equal ones are searched for once."""
    first = F.min("id").over(Window.partitionBy("question")).alias("searched_as")
    asked = cut_lineage(_asked(s, d).filter(F.size("gold") > 0).select("id", "question", "gold", first))
    once = asked.filter("id = searched_as").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    # copies of a chunk count once in the search and in the scores
    chunks = table(s, d, "chunks")
    pool = retrieval.hybrid_search(once, chunks.select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("text")))
    return evaluation.pool_scores(pool, evaluation.gold_references(asked, ("searched_as",)), chunks)


@query
def recall_and_mrr(s, d):
    return _scores(s, d).select("query_id", "stage", F.round("recall_5", 6).alias("recall_5"), F.round("recall_20", 6).alias("recall_20"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "first_rank")


@query
def stage_summary(s, d):
    kinds = _golden(s, d).select(F.col("id").alias("query_id"), "type")
    return evaluation.stage_summary(_scores(s, d).join(kinds, "query_id"), by=["type"])


@query
def question_diagnosis(s, d):
    return evaluation.question_diagnosis(_scores(s, d))


# --- references, context, prompts


@query
def find_references(s, d):
    return references.scoped_references(_chunks(s, d))


@query
def all_references(s, d):
    return references.find_references(_chunks(s, d))


@query
def resolve_references(s, d):
    chunks = _chunks(s, d)
    return references.resolve_references(references.find_references(chunks), chunks)


def _context(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(s, d, "chunks")  # copies are removed where it is read
    return references.build_context(retrieval.final_hits(_pool(s, d), top_k=10), chunks), chunks


@query
def expand_context(s, d):
    return _context(s, d)[0]


@query
def context_labels(s, d):
    """Labels of the chunks of each document that its golden items name, in document order."""
    named = evaluation.gold_references(_golden(s, d)).select("id", "doc_id", "scope").distinct()
    members = named.join(_chunks(s, d).select("doc_id", "scope", "chunk_index", F.col("id").alias("chunk_id")), ["doc_id", "scope"])
    return members.select("id", references.context_label("id").alias("label"), "chunk_id")


@query
def prompt_render(s, d):
    context, chunks = _context(s, d)
    return references.render_prompts(_questions(s, d).select("query_id", F.col("query").alias("question")), context, chunks)


@query
def reply_schema(s, d):
    labels = F.transform(F.sequence(F.lit(1), F.greatest(F.size("citations"), F.lit(1))), lambda i: F.concat(F.lit("C"), i.cast("string")))
    return _results(s, d).select("run_id", "id", references.reply_schema(labels).alias("schema"))


# --- answers and evaluation


def _citations(s: SparkSession, d: str) -> DataFrame:
    return _results(s, d).select("run_id", "id", F.posexplode("citations").alias("seq", "c")).select("run_id", "id", "seq", "c.chunk_id", "c.quote", "c.scope", "c.sections")


@query
def verify_citations(s, d):
    return answers.verify_citations(_citations(s, d), table(s, d, "chunks")).select("run_id", "id", "seq", "verified")


@query
def groundedness(s, d):
    return _results(s, d).select("run_id", "id", answers.is_grounded(F.col("covered"), F.col("citations")).alias("is_grounded"))


@query
def parse_replies(s, d):
    packed = F.to_json(F.struct("answer", F.transform("citations", lambda c: F.struct(c["chunk_label"].alias("chunk"), c["quote"].alias("quote"))).alias("citations"), "covered"))
    cut = F.when(F.pmod(F.col("prompt_tokens"), F.lit(5)) == 0, F.substring(packed, 1, 20)).otherwise(packed)
    parsed = answers.parse_replies(_results(s, d).select("run_id", "id", "prompt_tokens", cut.alias("reply")))
    return parsed.select("run_id", "id", "error", "covered", "answer", F.size("citations").alias("cited"))


@query
def answer_outcomes(s, d):
    r = _results(s, d)
    name = evaluation.outcome(F.col("error"), F.col("answerable"), F.col("covered"), F.col("judge.verdict"), F.col("judge").isNull())
    return r.select("run_id", "id", name.alias("outcome_found"), F.col("judge.verdict").alias("v")).select(
        "run_id", "id", "outcome_found", evaluation.outcome_score(F.col("outcome_found"), F.col("v")).alias("score_found")
    )


@query
def generation_summary(s, d):
    return evaluation.generation_summary(_results(s, d))


@query
def citation_precision(s, d):
    found = evaluation.citation_precision(
        _results(s, d).select("run_id", "id", F.explode("citations").alias("c")).select("run_id", "id", "c.verified", "c.scope", "c.sections"), evaluation.gold_references(_golden(s, d))
    )
    return found.select("run_id", "id", F.round("citation_precision", 6).alias("citation_precision"))


def _scored_results(s: SparkSession, d: str) -> DataFrame:
    """Results with a score to divide by: the words of its question that the best cited chunk holds."""
    cited = _results(s, d).select("run_id", "id", "question", "answerable", F.explode_outer("citations.chunk_id").alias("chunk_id"))
    held = cited.join(_chunks(s, d).select(F.col("id").alias("chunk_id"), F.coalesce("embed_text", F.lit("")).alias("passage")), "chunk_id", "left")
    score = F.when(F.col("passage").isNotNull(), retrieval.word_overlap(F.col("question"), F.col("passage")))
    return held.withColumn("score", score).groupBy("run_id", "id", "answerable").agg(F.max("score").alias("top_score"))


@query
def threshold_sweep(s, d):
    swept = evaluation.threshold_sweep(_scored_results(s, d), "top_score", "answerable")
    return swept.select("threshold", F.round("accuracy", 9).alias("accuracy"))


@query
def best_threshold(s, d):
    best = evaluation.best_threshold(evaluation.threshold_sweep(_scored_results(s, d), "top_score", "answerable"))
    return best.select("threshold", F.round("accuracy", 9).alias("accuracy"))


@query
def judge_agreement(s, d):
    r = _results(s, d)
    labels = r.filter("citations_verified > 0 AND judge IS NOT NULL").select("id", "answer_hash", F.col("run_id").alias("seq"), "judge.verdict", "judge.overstated", "judge.missing_condition")
    return evaluation.judge_agreement(r, labels)


@query
def judge_disagreements(s, d):
    """Against labels that call every third answer incorrect."""
    r = _results(s, d).filter("judge IS NOT NULL")
    other = F.when(F.pmod(F.col("prompt_tokens"), F.lit(3)) == 0, "incorrect").otherwise(F.col("judge.verdict"))
    labels = r.select("id", "answer_hash", F.col("run_id").alias("seq"), other.alias("verdict"), "judge.overstated", "judge.missing_condition")
    return evaluation.judge_disagreements(r, labels)


@query
def parse_verdicts(s, d):
    """Judges' replies as they would come in, every fifth cut off."""
    r = _results(s, d).filter("judge IS NOT NULL")
    reply = F.to_json("judge")
    cut = F.when(F.pmod(F.col("prompt_tokens"), F.lit(5)) == 0, F.substring(reply, 1, 15)).otherwise(reply)
    return answers.parse_verdicts(r.select("run_id", "id", cut.alias("reply"))).select("run_id", "id", "judge.verdict", "judge.overstated", F.col("judge_error").isNotNull().alias("failed"))


@query
def question_records(s, d):
    pool = cut_lineage(_pool(s, d).drop("query"))
    golden, chunks = _golden(s, d), _chunks(s, d)
    refs = evaluation.gold_references(golden).join(_questions(s, d).select(F.col("query_id").alias("id")), "id", "left_semi")
    found = evaluation.question_records(pool, golden, chunks, evaluation.pool_scores(pool, refs, chunks))
    return found.select("query_id", "type", "split", "top1_rerank", F.array_join("top_hits", "; ").alias("top_hits"), F.round("stages.fused.recall_20", 6).alias("fused_recall_20"), "diagnosis")


@query
def golden_profile(s, d):
    return evaluation.golden_profile(table(s, d, "golden"))


@query
def gold_text(s, d):
    return evaluation.gold_text(table(s, d, "blocks"), evaluation.gold_references(table(s, d, "golden")))


@query
def unknown_gold(s, d):
    """Gold references to documents that a collection of those of more than ten pages would lack."""
    known = _blocks(s, d).groupBy("doc_id").agg(F.max("page_number").alias("pages")).filter("pages > 10")
    return evaluation.unknown_gold_documents(evaluation.gold_references(table(s, d, "golden")), known).select("id", "ref_no", "doc_id")


@query
def section_match(s, d):
    """Chunks that hold a gold section, for each gold reference that has one."""
    refs = evaluation.gold_references(table(s, d, "golden")).filter("section IS NOT NULL")
    chunks = _chunks(s, d).select("doc_id", "scope", "sections", F.col("id").alias("chunk_id"))
    met = refs.join(chunks, ["doc_id", "scope"]).filter(F.exists("sections", lambda x: T.covers(x, F.col("section"))))
    return met.select("id", "ref_no", "chunk_id")


@query
def longest_shared_run(s, d):
    """The most words in a row that a golden item's question shares with its reference answer."""
    pairs = _golden(s, d).filter("question IS NOT NULL AND answer IS NOT NULL").select("id", "question", "answer")
    return evaluation.longest_shared_run(pairs, ["id"], "question", "answer")


@query
def judge_cache_keys(s, d):
    """How many distinct judge inputs are used how often, by their cache key."""
    key = answers.cache_key(F.lit("1"), F.lit("model-1"), F.col("question"), F.coalesce("answer", F.lit("")))
    return _results(s, d).groupBy(key.alias("key")).agg(F.count("*").alias("uses")).groupBy("uses").agg(F.count("*").alias("keys"))


@query
def not_fully_correct(s, d):
    return _results(s, d).filter("score IS NULL OR score < 1").groupBy("run_id", "outcome").agg(F.count("*").alias("n"))


@query
def role_samples(s, d):
    """The five first texts of each role of a document, for inspection."""
    first = _blocks(s, d).groupBy("doc_id", "role", "text").agg(F.min("ordinal").alias("at"))
    return first.withColumn("n", F.expr("row_number() over (partition by doc_id, role order by at, text)")).filter("n <= 5").select("doc_id", "role", "text", "n")

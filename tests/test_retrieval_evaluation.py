import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answers, evaluation, index, references, retrieval


def rankings(spark, **lists):
    rows = [("q", name, i + 1, x) for name, xs in lists.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "query_id string, retriever string, rank int, id string")


def test_fusion_scores_and_ties(spark):
    got = {r["id"]: r for r in retrieval.fuse_rankings(rankings(spark, dense=["a", "b"], sparse=["b", "c"]), {"dense": 1.0, "sparse": 1.0}).collect()}
    assert got["a"]["rrf_score"] == pytest.approx(1 / 61) and got["b"]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)
    assert sorted(got, key=lambda k: got[k]["fused_rank"]) == ["b", "a", "c"]
    tied = retrieval.fuse_rankings(rankings(spark, dense=["x"], sparse=["y"]), {"dense": 1.0, "sparse": 1.0}).orderBy("fused_rank").collect()
    assert [r["id"] for r in tied] == ["x", "y"]
    silent = {r["id"]: r["rrf_score"] for r in retrieval.fuse_rankings(rankings(spark, dense=["x"], sparse=["y"]), {"dense": 1.0, "sparse": 0.0}).collect()}
    assert silent["y"] == 0.0, "a retriever without weight still nominates"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("c1", "gangway width of the vehicle"), ("c2", "doors shall open"), ("c3", "seat anchorage strength"), ("c4", "trolleybus gangway height"), ("c5", "emergency exits and doors")]
    return spark.createDataFrame([(i, t, t) for i, t in rows], "chunk_id string, text string, passage string")


def test_hybrid_search(spark, corpus):
    queries = spark.createDataFrame([("q1", "gangway width"), ("q2", "")], "query_id string, query string")
    config = retrieval.RetrievalConfig(top_k=3, rerank_candidates=4)
    pool = retrieval.hybrid_search(queries, corpus, config)
    first = pool.filter("query_id = 'q1' AND final_rank = 1").first()
    assert first["chunk_id"] == "c1" and first["rerank_score"] == 2.0
    hits = retrieval.final_hits(pool, config).filter("query_id = 'q1'")
    assert hits.count() == 3
    assert pool.filter("query_id = 'q2' AND sparse_rank IS NOT NULL").count() == 0
    plain = retrieval.hybrid_search(queries, corpus, config, scorer=None).filter("query_id = 'q1'")
    assert plain.filter("final_rank <> fused_rank").count() == 0


def test_filter_before_rank(spark, corpus):
    tagged = corpus.withColumn("doc_id", F.when(F.col("chunk_id") < "c3", "a").otherwise("b")).withColumn("scope", F.lit("s"))
    assert retrieval.search_filter(tagged, ["a"]).count() == 2 and retrieval.search_filter(tagged, [], None).count() == 5


def test_empty_corpus(spark, corpus):
    queries = spark.createDataFrame([("q1", "gangway")], "query_id string, query string")
    assert retrieval.hybrid_search(queries, corpus.limit(0)).count() == 0


GOLD = "id string, gold array<struct<doc_id:string,scope:string,section:string,page:int>>"
CHUNKS = "id string, doc_id string, scope string, sections array<string>, page_start int, page_end int"


def test_recall_and_rank(spark):
    golden = spark.createDataFrame([("q", [("d", "A", "7.6.1", None), ("d", "A", None, 82)])], GOLD)
    refs = evaluation.gold_references(golden)
    chunks = spark.createDataFrame([("x", "d", "A", ["7.6.10"], 1, 1), ("y", "d", "A", ["7.6.1.1"], 2, 3), ("z", "d", "A", [], 80, 83)], CHUNKS)
    stages = spark.createDataFrame([("q", "x", "fused", 1), ("q", "y", "fused", 2), ("q", "z", "fused", 7)], "query_id string, chunk_id string, stage string, rank int")
    got = {r["stage"]: r for r in evaluation.stage_scores(stages, refs, chunks).collect()}
    assert (got["fused"]["recall_5"], got["fused"]["recall_10"], got["fused"]["reciprocal_rank"], got["fused"]["first_rank"]) == (0.5, 1.0, 0.5, 2)
    assert got["dense"]["recall_5"] == 0.0 and got["dense"]["first_rank"] is None
    assert evaluation.question_diagnosis(evaluation.stage_scores(stages, refs, chunks)).first()["diagnosis"] == "lost_in_rerank"


def test_threshold(spark):
    scores = spark.createDataFrame([(4.0, True), (2.5, True), (-1.0, False), (0.5, False)], "s double, a boolean")
    best = evaluation.best_threshold(evaluation.threshold_sweep(scores, "s", "a")).first()
    assert (best["threshold"], best["accuracy"]) == (2.5, 1.0)
    assert evaluation.threshold_sweep(scores.filter("a"), "s", "a").count() == 0


def test_longest_run(spark):
    pairs = spark.createDataFrame([("1", "the width of the gangway", "minimum width of the door"), ("2", "a b", "b a"), ("3", "x", "y")], "id string, a string, b string")
    got = {r["id"]: r["run"] for r in evaluation.longest_shared_run(pairs, ["id"], "a", "b").collect()}
    assert got == {"1": 3, "2": 1, "3": 0}


def test_outcomes(spark):
    rows = [("e", False, False, None, False), (None, False, True, None, False), (None, False, False, None, False), (None, True, False, None, False), (None, True, True, "partial", False), (None, True, True, None, True)]
    df = spark.createDataFrame(rows, "error string, answerable boolean, covered boolean, verdict string, failed boolean")
    name = evaluation.outcome(F.col("error"), F.col("answerable"), F.col("covered"), F.col("verdict"), F.col("failed"))
    got = [(r["o"], r["s"]) for r in df.select(name.alias("o"), "verdict").select("o", evaluation.outcome_score(F.col("o"), F.col("verdict")).alias("s")).collect()]
    assert got == [("error", 0.0), ("hallucinated", 0.0), ("correct_refusal", 1.0), ("false_refusal", 0.0), ("answered", 0.5), ("judge_error", None)]


def test_index_diff_and_apply(spark):
    chunks = spark.createDataFrame([(f"doc:{i}", "doc", f"t{i}") for i in range(5)] + [("other:0", "other", "t")], "id string, doc_id string, embed_text string")
    now = index.points(chunks, "m")
    report = lambda old, new=now: {r["doc_id"]: (r["chunks"], r["embedded"], r["unchanged"], r["deleted"]) for r in index.index_report(index.index_diff(new, old)).collect()}
    assert report(now.limit(0))["doc"] == (5, 5, 0, 0)
    assert report(now)["doc"] == (5, 0, 5, 0)
    shorter = index.points(chunks.filter("doc_id = 'doc' AND id < 'doc:3'"), "m")
    assert report(now, shorter) == {"doc": (3, 0, 3, 2)}, "points of other documents are left alone"
    assert report(index.points(chunks, "older"))["doc"] == (5, 5, 0, 0)
    after = index.apply_diff(now, shorter, index.index_diff(shorter, now))
    assert sorted(r["chunk_id"] for r in after.collect()) == ["doc:0", "doc:1", "doc:2", "other:0"]


REFERRING = [
    ("see paragraph 3.3.3. of Annex 5 and Annex 4, Figure 6. Paragraph 7.2 and Annex 8 apply; paragraph 1.1 of this annex too.", "Annex 3",
     [("Annex 5", "3.3.3", None, True), ("Annex 4", None, "Figure 6", True), ("Annex 8", None, None, True), ("Annex 3", "1.1", None, False), ("Annex 3", "7.2", None, False)]),
    ("Annex 13 - Part 1 and Annex 3", "Annex 3", []),
    ("paragraph 4.4. of  this\nRegulation, PARAGRAPHS 2.1 TO ANNEX  7 and paragraph 2.1 of Annex 7", "Annex 7", [("Regulation", "4.4", None, True), ("Annex 7", "2.1", None, False)]),
    ("Annex 5, Figures 12A and Annex 5 again; paragraph 3.3.3. of Annex 5", None, [("Annex 5", "3.3.3", None, True), ("Annex 5", None, "Figure 12A", True), ("Annex 5", None, None, True)]),
    ("paragraphs 5.. and paragraph 6.1.2.", "Annex 1", [("Annex 1", "6.1.2", None, False)]),
    (None, "Annex 1", []), ("", "Annex 1", []), ("no place is named", "Annex 1", []),
]


def test_references(spark):
    df = spark.createDataFrame([(str(i), "d", t, s) for i, (t, s, _) in enumerate(REFERRING)], "id string, doc_id string, text string, scope string")
    got = {}
    for r in references.find_references(df).orderBy("id", "seq").collect():
        got.setdefault(int(r["id"]), []).append((r["scope"], r["section"], r["figure"], r["cross_scope"]))
    assert {i: got.get(i, []) for i in range(len(REFERRING))} == {i: want for i, (_, _, want) in enumerate(REFERRING)}
    assert references.find_references(df.limit(0)).count() == 0


def test_labels(spark):
    row = spark.createDataFrame([("d", "Annex 3", ["7.1", "7.2", "7.3"], 4, 6), ("d", None, [], 9, 9)], "doc_id string, scope string, sections array<string>, a int, b int")
    got = row.select(references.source_line(F.col("doc_id"), F.col("scope"), F.col("sections"), F.col("a"), F.col("b")), references.hit_label(F.col("scope"), F.col("sections"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("d · Annex 3 · 7.1–7.3 · p.4–6", "Annex 3 / 7.1..7.3"), ("d ·  · unnumbered · p.9", " / p.9")]
    gold = spark.createDataFrame([("Annex 3", "7.1", 4), ("Annex 4", None, 82)], "scope string, section string, page int")
    assert [r[0] for r in gold.select(references.gold_label(F.col("scope"), F.col("section"), F.col("page"))).collect()] == ["Annex 3 / 7.1", "Annex 4 / p.82"]


def test_context(spark):
    schema = "id string, doc_id string, chunk_index int, scope string, sections array<string>, text string, header string"
    pages = {"page_start": F.lit(3), "page_end": F.lit(4)}
    chunks = spark.createDataFrame(
        [("a", "d", 0, "Annex 3", ["1"], "see paragraph 2.1 of Annex 5 and Annex 4, Figure 6 and Annex 8", "h"), ("b", "d", 1, "Annex 4", [], "Figure 6 shows it", "h"),
         ("c", "d", 2, "Annex 4", [], "Figure 61 does not", "h"), ("e", "d", 3, "Annex 5", ["2.1.1"], "under", "h"), ("f", "d", 4, "Annex 5", ["2.1"], "exact", "h")]
        + [(f"g{i}", "d", 5 + i, "Annex 8", [], "part", "h") for i in range(3)], schema).withColumns(pages)
    hits = spark.createDataFrame([("q", "a", 1), ("q", "gone", 2)], "query_id string, chunk_id string, final_rank int")
    got = [(r["label"], r["chunk_id"], r["origin"]) for r in references.build_context(hits, chunks).orderBy("label").collect()]
    assert got == [("C1", "a", "retrieved"), ("C2", "b", "reference"), ("C3", "f", "reference")], "Annex 8 has more than two chunks"
    prompt = references.render_prompts(spark.createDataFrame([("q", "Why?"), ("p", "What?")], "query_id string, question string"), references.build_context(hits, chunks), chunks)
    said = {r["query_id"]: r["prompt"] for r in prompt.collect()}
    assert said["q"].index("C1") < said["q"].index("C3") < said["q"].index("Question: Why?")
    assert said["p"].startswith("Regulation excerpts:\n\nQuestion: What?\n\nRespond with a JSON object: {")
    assert '<chunk id="C2" source="d · Annex 4 · unnumbered · p.3–4">\nh\nFigure 6 shows it\n</chunk>\n\n' in said["q"]


def test_citations_and_replies(spark):
    chunks = spark.createDataFrame([("c", "The gangway shall  be “450 mm” wide")], "id string, text string")
    cites = spark.createDataFrame([("c", 'shall be "450 mm"'), ("c", "invented"), ("c", " "), ("none", "gangway"), (None, "x")], "chunk_id string, quote string")
    assert [r["verified"] for r in answers.verify_citations(cites, chunks).orderBy(F.desc("verified"), "quote").collect()] == [True, False, False, False, False]
    raw = spark.createDataFrame([('{"answer":"a","citations":[{"chunk":"C1","quote":"q"}],"covered":true}',), ('{"answer":"a","cit',), (None,)], "reply string")
    assert [(r["covered"], r["error"], len(r["citations"])) for r in answers.parse_replies(raw).collect()] == [(True, None, 1), (False, "JSONDecodeError", 0), (False, "JSONDecodeError", 0)]


def test_cache_calls_only_for_what_is_missing(spark):
    inputs = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("k1", "old")], "key string, verdict string")
    every, made = answers.with_cache(inputs, cache, lambda prompts: "new " + prompts)
    assert sorted((r["key"], r["verdict"]) for r in every.collect()) == [("k1", "old"), ("k2", "new p2"), ("k2", "new p2")]
    assert made.count() == 1


def verdict(name, **flags):
    return json.dumps({"verdict": name, **flags})


def test_verdicts(spark):
    raw = spark.createDataFrame([(verdict("partial", overstated=True),), (verdict("great"),), ("no json",), (None,)], "reply string")
    got = [(r["judge"] and (r["judge"]["verdict"], r["judge"]["overstated"], r["judge"]["explanation"]), bool(r["judge_error"])) for r in answers.parse_verdicts(raw).collect()]
    assert got == [(("partial", True, ""), False), (None, True), (None, True), (None, True)]


def test_judging_asks_once_and_caches_no_error(spark):
    inputs = spark.createDataFrame([("k1", "p1", "a"), ("k2", "p2", "b"), ("k2", "p2", "c"), ("k3", "bad", "d")], "key string, prompt string, id string")
    old = spark.createDataFrame([("k1", (("correct", False, False, False, "old")))], f"key string, judge struct<{answers.VERDICT}>")
    judged, new = answers.judge_answers(inputs, old, lambda p: "nonsense" if p == "bad" else json.dumps({"verdict": "incorrect"}))
    assert {r["id"]: r["judge"]["verdict"] if r["judge"] else r["judge_error"][:10] for r in judged.collect()} == {"a": "correct", "b": "incorrect", "c": "incorrect", "d": "JudgeError"}
    assert [r["key"] for r in new.collect()] == ["k2"]


def test_judge_consistency(spark):
    rows = [(f"q{i}", f"p{i}", ("correct", False, False, False, "")) for i in range(5)] + [("q9", "p9", None)]
    judged = spark.createDataFrame(rows, f"id string, prompt string, judge struct<{answers.VERDICT}>")
    assert tuple(answers.judge_consistency(judged, lambda p: json.dumps({"verdict": "partial" if p == "p1" else "correct"}), 3).first()) == (3, 0.667)
    assert tuple(answers.judge_consistency(judged.limit(0), lambda p: p, 3).first()) == (0, None)


def test_disagreements(spark):
    judge = f"judge struct<{answers.VERDICT}>"
    results = spark.createDataFrame([("r", "q1", "h", ("partial", False, False, False, "too short " * 20)), ("r", "q2", "h", ("correct", False, False, False, ""))], f"run_id string, id string, answer_hash string, {judge}")
    labels = spark.createDataFrame([("q1", "h", 1, "partial", False, False), ("q1", "h", 2, "correct", False, False), ("q2", "h", 1, "correct", False, False)], "id string, answer_hash string, seq int, verdict string, overstated boolean, missing_condition boolean")
    got = evaluation.judge_disagreements(results, labels).collect()
    assert [r["disagreement"] for r in got] == ["q1: human=correct judge=partial (" + ("too short " * 20)[:80] + ")"]


def test_blocks_of_queries_rank_alike(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import retrieval

    chance = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in chance.integers(-2, 3, 6)]) for i in range(300)]
    rows = spark.createDataFrame([*vectors, (998, None), (999, [0.0] * 6)], "chunk_id int, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in vectors[:20]], "query_id int, vector array<double>")
    whole = {tuple(r) for r in retrieval.dense_ranking(asked, rows, 7).collect()}
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 200)
    monkeypatch.setattr(retrieval, "SCORE_ROWS", 16)
    assert {tuple(r) for r in retrieval.dense_ranking(asked, rows, 7).collect()} == whole and len(whole) == 140
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in [*vectors, (999, [0.0] * 6)]}
    for q, v in vectors[:20]:
        best = sorted(((-round(float(unit[q] @ u), 9), i) for i, u in unit.items()))[:7]
        assert {i for _, i in best} == {c for a, c, *_ in whole if a == q}


def test_gold_text_follows_numbers_within_a_scope(spark):
    from quillspark import schemas

    def row(i, text, number=None, scope="A", page=1, role="body"):
        return ("d", i, f"d:{i}", text, page, None, 10.0, False, role, None, "text", number, scope, [])

    rows = [row(0, "a", "7.6.1"), row(1, "a1", "7.6.1.1"), row(2, "table"), row(3, "skip", role="footer"), row(4, "b", "7.6.2"), row(5, "loose", scope="B"), row(6, "late", "7.6.10"), row(7, "fig", scope="C", page=82)]
    blocks = spark.createDataFrame(rows, schemas.BLOCK)
    golden = spark.createDataFrame([("q", [("d", "A", "7.6.1", None), ("d", "C", None, 82)])], GOLD)
    got = {r["ref_no"]: r["text"] for r in evaluation.gold_text(blocks, evaluation.gold_references(golden)).collect()}
    assert got == {0: "a\na1\ntable", 1: "fig"}


def test_references_to_other_scopes_are_walked_first(spark):
    schema = "id string, doc_id string, chunk_index int, scope string, sections array<string>, text string, header string"
    chunks = spark.createDataFrame(
        [("a", "d", 0, "Annex 1", ["1"], "see paragraph 2.", "h"), ("b", "d", 1, "Annex 1", ["2"], "second", "h"), ("c", "d", 2, "Annex 2", ["1"], "see paragraph 3.1 of Annex 3", "h"), ("e", "d", 3, "Annex 3", ["3.1"], "third", "h")], schema
    )
    hits = spark.createDataFrame([("q", "a", 1), ("q", "c", 2)], "query_id string, chunk_id string, final_rank int")
    got = {r["chunk_id"] for r in references.build_context(hits, chunks, max_expansions=1).filter("origin = 'reference'").collect()}
    assert got == {"e"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_counts_rank_as_counted(spark, monkeypatch):
    import numpy as np

    chance = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(f"c{i:03}", " ".join(chance.choice(words, chance.integers(0, 25)))) for i in range(400)]
    asked = {f"q{i}": set(chance.choice(words, chance.integers(1, 20))) | {f"only{i}"} for i in range(70)}
    corpus = spark.createDataFrame([*texts, ("c999", None)], "chunk_id string, text string").repartition(3)
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id string, term string")
    want = set()
    for q, ts in asked.items():
        counted = sorted((-len(ts & set(x.split())), c) for c, x in texts if ts & set(x.split()))
        want |= {(q, c, float(-n), r + 1) for r, (n, c) in enumerate(counted[:7])}
    rank = lambda: {tuple(r) for r in retrieval.overlap_ranking(terms, corpus, 7).collect()}
    assert rank() == want
    joined = retrieval.sparse_ranking(terms, retrieval.postings(corpus, "chunk_id", "text"), 7)
    assert {tuple(r) for r in joined.collect()} == want
    for name, few in (("QUERY_TERMS", 200), ("COUNT_ROWS", 70), ("LAID_QUERIES", 16), ("COUNT_QUERIES", 5)):
        monkeypatch.setattr(retrieval, name, few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        assert rank() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert retrieval.overlap_ranking(terms.limit(0), corpus, 7).count() == 0 == retrieval.overlap_ranking(terms, corpus.limit(0), 7).count()


def test_sparse_topk_lists_no_pairs(spark, data):
    from quillspark.plans.queries import QUERIES

    assert "Join" not in plan(QUERIES["sparse_topk"](spark, data)), "a row a shared word of a query and a chunk"


def test_equal_vectors_are_cut_by_key(spark, monkeypatch):
    seen, ranked = [], retrieval.top_ranked
    monkeypatch.setattr(retrieval, "top_ranked", lambda scored, *a: seen.append(scored) or ranked(scored, *a))
    rows = spark.range(3000).select(F.format_string("c%04d", "id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector")).repartition(1)
    asked = spark.createDataFrame([("q", [2.0, 1.0])], "query_id string, vector array<double>")
    got = retrieval.dense_ranking(asked, rows, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c0000", "c0001", "c0002"]
    assert seen[0].count() <= 6, "three of each batch, not all that equal them"


def test_only_candidates_meet_their_texts(spark, corpus):
    fused = spark.createDataFrame([("q", "c1", 1, True, "gangway"), ("q", "c2", 2, False, "gangway")], "query_id string, chunk_id string, fused_rank int, is_candidate boolean, query string")
    ranked = retrieval.rerank(fused, corpus)
    assert any("Join" in x and "is_candidate" in x for x in plan(ranked).splitlines())
    assert {(r["chunk_id"], r["rerank_score"], r["final_rank"]) for r in ranked.collect()} == {("c1", 1.0, 1), ("c2", None, 2)}


#: Queries over the pool of the hybrid search.
POOLED = ["rrf_fusion", "hybrid_search", "expand_context", "question_records", "recall_and_mrr", "stage_summary", "question_diagnosis", "stage_rankings", "prompt_render"]


@pytest.mark.parametrize("name", POOLED)
def test_pool_lists_no_pairs(spark, data, monkeypatch, name):
    from quillspark.plans.queries import QUERIES

    monkeypatch.setattr(retrieval, "postings", lambda *a: pytest.fail("a row a shared word of a query and a chunk"))
    QUERIES[name](spark, data).collect()


def test_words_are_those_of_the_column_function(spark):
    odd = ["İstanbul ΣΑΣ ΑΣ. ﬁn", "été ① Ⅷ ½ x_1", "𝒳𝒴 𝟙 😀a😀b", "مُحَرِّك الباب", "№5 ªb c‍d e­f\x85g", "ѫѫ҇ \U0001f1e9x \U00010400 \U00010428", "", None]
    corpus = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "chunk_id int, text string")
    asked = retrieval.postings(corpus.withColumnRenamed("chunk_id", "query_id"), "query_id", "text")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    want = rows(retrieval.sparse_ranking(asked, retrieval.postings(corpus, "chunk_id", "text"), 5))
    assert rows(retrieval.overlap_ranking(asked, corpus, 5)) == want and len(want) >= 6


def test_words_of_pieces_are_those_of_texts(spark):
    import pyarrow as pa

    odd = ["Foo, (bar) foo-BAR\nbar_1 3.5\tA\u00a0b", "İX ÀÉ! 'École' x\u200dy 𝒳😀b", "ДВЕРЬ дверь; Ǆ ﬁ", "the-word", "", None]
    texts = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "id int, text string")
    want = {(r["term"], r["id"]) for r in retrieval.postings(texts, "id", "text").collect()}
    # terms that are no words are held by no text
    words = [*sorted({w for w, _ in want}), "the-word", "", "absent"]
    word, row = retrieval._words_of(pa.array(words), retrieval._word_class(spark), retrieval._lower_signs(spark))(pa.array(odd))
    assert {(words[w], r) for w, r in zip(word, row)} == want and len(want) > 15


def test_whole_texts_are_not_lowered(spark):
    corpus = spark.createDataFrame([(1, "ΑΣ ΑΣΑ"), (2, "Door door"), (3, "ας"), (4, "ασα")], "chunk_id int, text string")
    asked = spark.createDataFrame([("q", "ας"), ("q", "ασα"), ("q", "door")], "query_id string, term string")
    ranked = retrieval.overlap_ranking(asked, corpus)
    assert {r["chunk_id"]: r["score"] for r in ranked.collect()} == {1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0}
    lowered = [line for line in plan(ranked).splitlines() if "lower(" in line]
    assert all("CASE WHEN Contains" in line for line in lowered), "only those with a sign that goes by its place"


def test_counts_are_the_rerank_scores(spark, monkeypatch):
    import numpy as np

    chance = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)]
    said = lambda n: " ".join(chance.choice(words, n))
    corpus = spark.createDataFrame([(f"c{i:03}", said(i % 9)) for i in range(200)], "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([*[(f"q{i}", said(i)) for i in range(9)], ("q9", "none of these")], "query_id string, query string")
    config = retrieval.RetrievalConfig(dense_k=7, sparse_k=5, rerank_candidates=6)
    rows = lambda c: {tuple(r[k] for k in ("query_id", "chunk_id", "query", "dense_rank", "dense_score", "sparse_rank", "sparse_score", "fused_rank", "rerank_score", "final_rank")) for r in retrieval.hybrid_search(queries, c, config).collect()}
    got = rows(corpus)
    assert got == rows(corpus.withColumn("passage", F.col("text"))) and len({r[0] for r in got}) == 10
    apart = retrieval.fuse(
        retrieval.dense_ranking(queries.withColumn("vector", retrieval.hashed_vector(F.col("query"))), corpus.withColumn("vector", retrieval.hashed_vector(F.col("text"))), 7),
        retrieval.sparse_ranking(retrieval.postings(queries, "query_id", "query"), retrieval.postings(corpus, "chunk_id", "text"), 5), config)
    assert {r[:2] + r[3:8] for r in got} == {tuple(r[k] for k in ("query_id", "chunk_id", "dense_rank", "dense_score", "sparse_rank", "sparse_score", "fused_rank")) for r in apart.collect()}
    for name, few in (("QUERY_BYTES", 200), ("SCORE_ROWS", 40), ("LAID_QUERIES", 4), ("COUNT_QUERIES", 3), ("SCORE_QUERIES", 3)):
        monkeypatch.setattr(retrieval, name, few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        assert rows(corpus) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


#: Queries over the pool that read each text once for it.
READ_ONCE = ["stage_rankings", "expand_context", "prompt_render", "question_records", "recall_and_mrr", "stage_summary", "question_diagnosis"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_pool_reads_texts_once(spark, data, monkeypatch, name):
    from quillspark.plans.queries import QUERIES

    passes, best = [], getattr(retrieval, "_best", None)
    monkeypatch.setattr(retrieval, "_best", lambda *a: passes.append(a) or best(*a), raising=False)
    monkeypatch.setattr(retrieval, "rerank", lambda *a: pytest.fail("passages are read again for their words"))
    QUERIES[name](spark, data).collect()
    assert len(passes) == 1, "one pass for both rankings and the rerank score"


def test_captions_in_any_writing(spark):
    texts = ["Figure 1 and fIGURE 12a, figure 1", "F\u0131gure 3, f\u0130gure 4", "figures 5", "Figure  6, Figure 7ab, Figure 8b", "", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", references.captions(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["c"] or [] for r in got][:4] == [["figure 1", "figure 12a"], ["f\u0131gure 3", "fi\u0307gure 4"], [], ["figure 8b"]]


def test_context_writes_no_texts(spark, monkeypatch):
    chunks = spark.createDataFrame([("a", "d", 0, "A", ["1"], "see paragraph 2."), ("b", "d", 1, "A", ["2"], "x"), ("b", "d", 1, "A", ["2"], "x")], "id string, doc_id string, chunk_index int, scope string, sections array<string>, text string")
    written, cut = [], references.cut_lineage
    monkeypatch.setattr(references, "cut_lineage", lambda d: written.append(d.columns) or cut(d))
    hits = spark.createDataFrame([("q", "a", 1)], "query_id string, chunk_id string, final_rank int")
    got = references.build_context(hits, chunks)
    assert [tuple(r)[1:3] for r in got.orderBy("label").collect()] == [("C1", "a"), ("C2", "b")]
    assert written and not any("text" in c for c in written), "texts are read once and not written"


def test_scores_of_a_pool_are_those_of_its_stages(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "Annex 1" if i % 2 else None, [f"7.{i}"], i, i) for i in range(6)], "id string, doc_id string, scope string, sections array<string>, page_start int, page_end int")
    pool = spark.createDataFrame(
        [("q1", f"c{i}", i + 1, 6 - i if i > 2 else None, i + 1, i < 4, 4 - i if i < 4 else i + 1) for i in range(6)] + [("q2", "c5", 1, None, 1, True, 1), ("q3", "c1", None, 1, 1, True, 1)],
        "query_id string, chunk_id string, dense_rank int, sparse_rank int, fused_rank int, is_candidate boolean, final_rank int",
    )
    refs = spark.createDataFrame([("q1", 0, "d", "Annex 1", "7.3", None), ("q1", 1, "d", None, None, 4), ("q1", 2, "e", None, "7", None), ("q2", 0, "d", "Annex 1", "7", None), ("q4", 0, "d", None, "7", None)], "id string, ref_no int, doc_id string, scope string, section string, page int")
    rows = lambda d: sorted(map(str, d.collect()))
    got = rows(evaluation.pool_scores(pool, refs, chunks))
    assert got == rows(evaluation.stage_scores(retrieval.stage_rankings(pool), refs, chunks)) and len(got) == 12 and {"first_rank=4" in r for r in got} == {True, False}


#: Queries whose pool meets chunks and references before it is parted by stage.
MATCHED_FIRST = ["stage_summary", "question_records", "question_diagnosis"]


@pytest.mark.parametrize("name", MATCHED_FIRST)
def test_only_matches_go_by_stage(spark, data, monkeypatch, name):
    from quillspark.plans.queries import QUERIES

    parted, stages = [], retrieval.stage_rankings
    monkeypatch.setattr(retrieval, "stage_rankings", lambda ranked, *a, **k: parted.append(ranked.columns) or stages(ranked, *a, **k))
    QUERIES[name](spark, data).collect()
    assert len(parted) == 1 and "ref_no" in parted[0]


def test_records_match_references_once(spark, data):
    from quillspark.plans.queries import QUERIES

    assert plan(QUERIES["question_records"](spark, data)).count("exists(sections") == 1


def test_captions_lower_no_texts(spark):
    texts = spark.createDataFrame([(1, "see FIGURE 3a"), (2, "gure"), (3, None)], "id int, text string")
    found = texts.select("id", references.captions(F.col("text")).alias("c"))
    assert {r["id"]: r["c"] for r in found.collect()} == {1: ["figure 3a"], 2: None, 3: None} and "lower(text" not in plan(found)


def test_copies_of_chunks_count_once(spark, monkeypatch):
    import numpy as np

    chance = np.random.default_rng(11)
    said = lambda n: " ".join(chance.choice([f"w{i}" for i in range(30)], n))
    made = [(f"c{i:03}", said(i % 9 + 1)) for i in range(150)]
    once = spark.createDataFrame(made, "chunk_id string, text string").repartition(3)
    # some in a row, some in another batch, some in another task
    often = spark.createDataFrame([*made, *made[::-1], *[x for x in made[::7] for _ in range(3)]], "chunk_id string, text string").coalesce(2)
    queries = spark.createDataFrame([*[(f"q{i}", said(i + 1)) for i in range(8)], ("q8", None), ("q9", "")], "query_id string, query string")
    config = retrieval.RetrievalConfig(dense_k=7, sparse_k=5, rerank_candidates=6)
    rows = lambda c: sorted(map(str, retrieval.hybrid_search(queries, c, config).collect()))
    want = rows(once)
    assert rows(often) == want and len(want) > 80
    for name, few in (("SCORE_ROWS", 40), ("POOL_ROWS", 9), ("SEEN_ROWS", 64)):
        monkeypatch.setattr(retrieval, name, few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    try:
        assert rows(often) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_questions_are_searched_once(spark, tmp_path, monkeypatch):
    from quillspark.plans.queries import QUERIES

    gold = [("d", "A", "1", None)]
    golden = [("q0000050", "wide doors", gold), ("q0000100", "wide doors", [("d", "A", "9", None)]), ("q0000150", "high seats", []), ("q0000200", "high seats", gold), ("q0000200", "high seats", gold), ("q0000250", "no gold", None), ("q0000051", "other", gold)]
    spark.createDataFrame(golden, "id string, question string, gold array<struct<doc_id string, scope string, section string, page int>>").write.parquet(str(tmp_path / "golden.parquet"))
    chunks = [("d:0", "d", "A", "wide doors", ["1.1"]), ("d:0", "d", "A", "wide doors", ["1.1"]), ("d:1", "d", "A", "high seats", ["2"])]
    chunks = spark.createDataFrame(chunks, "id string, doc_id string, scope string, embed_text string, sections array<string>").withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1))
    chunks.write.parquet(str(tmp_path / "chunks.parquet"))
    asked, search = [], retrieval.hybrid_search
    monkeypatch.setattr(retrieval, "hybrid_search", lambda q, *a: asked.extend(r["query"] for r in q.collect()) or search(q, *a))
    got = {r["query_id"]: r["diagnosis"] for r in QUERIES["question_diagnosis"](spark, str(tmp_path)).collect()}
    assert got == {"q0000050": "ok", "q0000100": "not_retrieved", "q0000200": "ok"}
    assert sorted(asked) == ["high seats", "wide doors"], "equal questions once, and none without gold"

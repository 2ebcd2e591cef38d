import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.plans import pipeline


@pytest.fixture(scope="module")
def annotated(spark):
    rows = []
    for page in range(1, 7):
        rows.append(("d", page, 0, "Regulation No. 107", (70.0, 34.0, 300.0, 46.0), 8.0, False))
        rows.append(("d", page, 9, str(page), (70.0, 806.0, 90.0, 816.0), 8.0, False))
    rows.append(("d", 1, 1, "Words of the front page, long enough to be read as body text", (70.0, 100.0, 500.0, 112.0), 10.0, False))
    rows.append(("d", 2, 1, "Annex 3", (70.0, 100.0, 300.0, 112.0), 14.0, True))
    rows.append(("d", 2, 2, "Doors and exits of vehicles with a long title", (70.0, 130.0, 300.0, 142.0), 14.0, True))
    for k in range(1, 25):
        rows.append(("d", 2 + k % 5, 2 + k, f"7.{k}. The {['gangway', 'door', 'hatch'][k % 3]} number {k} shall be wide and clear of all parts that move in service. " * 3, (70.0, 200.0 + k, 500.0, 230.0 + k), 10.0, False))
    raw = spark.createDataFrame(rows, "doc_id string, page_number int, block_no int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, is_bold boolean")
    return pipeline.annotate_blocks(raw).cache()


def test_annotation(annotated):
    roles = {r["role"]: r["count"] for r in annotated.groupBy("role").count().collect()}
    assert roles == {"header": 6, "footer": 6, "body": 27}
    one = annotated.filter(F.col("text").startswith("7.1.")).first()
    assert one["scope"] == "Annex 3" and one["section_number"] == "7.1" and one["breadcrumb"][0] == "Annex 3" and one["heading_level"] is None
    assert annotated.filter("text = 'Annex 3'").first()["heading_level"] == 1


def test_chunks_index_and_answers(spark, annotated):
    chunks = pipeline.chunk_blocks(annotated).cache()
    assert chunks.filter(F.col("header").contains("Annex 3: Doors and exits")).count() == chunks.count() > 1
    empty = spark.createDataFrame([], "point_id string, chunk_id string, doc_id string, text_sha256 string, embedding_model string, dense array<float>, sparse map<int,double>")
    made, report = pipeline.update_index(chunks, empty, lambda: models.HashingEmbedder(16), "m", 16)
    n = chunks.count()
    assert report.first()["embedded"] == n
    again, second = pipeline.update_index(chunks, made.cache(), lambda: 1 / 0, "m", 16)
    assert second.first()["unchanged"] == n and again.count() == n, "nothing is embedded twice"

    def reply(prompt):
        if "broken" in prompt:
            return "{"
        label = prompt.split('id="')[1].split('"')[0]
        return json.dumps({"answer": "Wide.", "citations": [{"chunk": label, "quote": "shall be wide"}, {"chunk": "C99", "quote": "x"}], "covered": True})

    asked = spark.createDataFrame([("q1", "How wide is the gangway?"), ("q2", "broken hatch?")], "query_id string, question string")
    got = {r["query_id"]: r for r in pipeline.ask(asked, chunks, reply).collect()}
    assert [c["verified"] for c in got["q1"]["citations"]] == [True, False] and got["q2"]["error"] == "JSONDecodeError" and not got["q2"]["covered"]


def test_evaluation(spark, data):
    found = pipeline.evaluate_retrieval(spark.read.parquet(f"{data}/golden.parquet"), spark.read.parquet(f"{data}/chunks.parquet"), split="test")
    assert found["summary"].filter("stage = 'fused' AND type IS NULL AND lang IS NULL").count() >= 1 and found["diagnosis"].count() > 0
    records = found["records"]
    assert records.count() > 0 and records.filter("size(top_hits) > 5").count() == 0


def test_generation_is_asked_judged_and_scored(spark, annotated):
    chunks = pipeline.chunk_blocks(annotated).cache()
    gold = "id string, question string, type string, lang string, split string, gold array<struct<doc_id:string,scope:string,section:string,page:int>>, answer string"
    golden = spark.createDataFrame(
        [("g1", "How wide is the gangway number 3?", "numeric", "en", "dev", [("d", "Annex 3", "7.3", None)], "wide"), ("g2", "Who paints it?", "unanswerable", "en", "dev", [], None),
         ("g3", "broken hatch?", "numeric", "en", "test", [("d", "Annex 3", "7.5", None)], "x"), ("g4", "unread door?", "numeric", "en", "test", [("d", "Annex 3", "7.1", None)], "x")], gold)

    def reply(prompt):
        asked = prompt.split("Question: ")[1]
        if "broken" in asked:
            return "{"
        return json.dumps({"answer": asked[:12], "citations": [{"chunk": prompt.split('id="')[1].split('"')[0], "quote": "shall be wide"}], "covered": "paints" not in asked})

    judge = lambda prompt: "?" if "unread" in prompt else json.dumps({"verdict": "partial"})
    results, new = pipeline.evaluate_generation(golden, chunks, annotated, reply, judge)
    got = {r["id"]: r for r in results.collect()}
    assert {k: (r["outcome"], r["score"]) for k, r in got.items()} == {"g1": ("answered", 0.5), "g2": ("correct_refusal", 1.0), "g3": ("error", 0.0), "g4": ("judge_error", None)}
    assert got["g1"]["citations_verified"] == 1 and got["g1"]["context_recall"] is not None and got["g2"]["citation_precision"] is None and got["g4"]["error"].startswith("JudgeError")
    assert new.count() == 1


def test_a_pipeline_is_built_from_settings(spark, annotated, tmp_path):
    path = str(tmp_path / "chunks")
    pipeline.chunk_blocks(annotated).write.parquet(path)
    made = pipeline.build_pipeline(spark, pipeline.Settings(path, context_k=2), lambda prompt: json.dumps({"answer": str(prompt.count("<chunk")), "citations": [], "covered": False}))
    asked = spark.createDataFrame([("q", "How wide is the gangway number 3?")], "query_id string, question string")
    assert made.search(asked).count() == made.settings.retrieval.top_k or made.chunks.count() < 5
    assert int(made.ask(asked).first()["answer"]) >= 2
    spark.read.parquet(path).limit(0).write.parquet(path + "-empty")
    with pytest.raises(ValueError, match="no chunks"):
        pipeline.build_pipeline(spark, pipeline.Settings(path + "-empty"))

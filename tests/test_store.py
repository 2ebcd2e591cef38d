import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import models
from quillspark.operators.layout import LayoutConfig
from quillspark.sources import store
from quillspark.streaming.index_stream import stream_index


def test_jsonl_gates(spark, tmp_path):
    good = tmp_path / "good"
    rows = spark.createDataFrame([("q1", "Почему?", "ru", "numeric", [("d", "A", "1", None)], "a", None, "verified", None)], schemas.GOLDEN)
    store.write_jsonl(rows, str(good), "id")
    assert store.load_golden(spark, str(good)).first()["question"] == "Почему?"
    for i, bad in enumerate(['{"id": "q1", "unknown": 1}', "{broken"]):
        (tmp_path / f"bad{i}.jsonl").write_text(bad + "\n")
        with pytest.raises(store.StoreError, match=f"bad{i}"):
            store.read_jsonl(spark, str(tmp_path / f"bad{i}.jsonl"), schemas.GOLDEN)
    (tmp_path / "twice.jsonl").write_text('{"id": "q1"}\n\n{"id": "q1"}\n')
    with pytest.raises(store.StoreError, match="q1"):
        store.load_golden(spark, str(tmp_path / "twice.jsonl"))


def test_staleness(spark, tmp_path):
    (tmp_path / "A B.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "note.pdf").write_bytes(b"hello")
    raw = store.raw_documents(spark, str(tmp_path))
    assert {r["doc_id"]: r["is_pdf"] for r in raw.collect()} == {"a-b": True, "note": False}
    table = spark.createDataFrame([("a-b", 1), ("a-b", 2)], "doc_id string, n int")
    manifest = store.manifest_rows(table, raw, LayoutConfig(), "1")
    reasons = lambda m, c=LayoutConfig(), v="1": {r["doc_id"]: r["reason"] for r in store.staleness(raw, m, c, v).collect()}
    assert reasons(manifest) == {"a-b": None, "note": "no manifest"}
    assert reasons(manifest, v="2")["a-b"] == "version"
    assert reasons(manifest, LayoutConfig(band=6.0))["a-b"] == "config"
    assert reasons(manifest.withColumn("source_sha256", F.lit("x")))["a-b"] == "source"
    store.check_counts(table, manifest)
    with pytest.raises(store.StoreError):
        store.check_counts(table.limit(1), manifest)
    with pytest.raises(store.SchemaVersionError):
        store.check_manifest(manifest.withColumn("schema_version", F.lit(9)))


def test_saving_one_document_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    store.save_table(spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, n int"), path)
    store.save_table(spark.createDataFrame([("a", 2)], "doc_id string, n int"), path)
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_pages_from_an_extractor(spark):
    def fake(content):
        if content == b"bad":
            raise ValueError("broken")
        span = lambda t, s, b: {"text": t, "size": s, "bold": b}
        yield {"number": 1, "width": 595.0, "height": 842.0, "rects": [{"x0": 70.0, "y0": 747.0, "x1": 144.0, "y1": 747.5}, {"x0": 0.0, "y0": 0.0, "x1": 90.0, "y1": 90.0}],
               "blocks": [{"type": 0, "bbox": [1.04, 2.0, 3.0, 4.0], "lines": [[span("Head", 12.0, True), span("ing", 12.0, True)], [span("x", 9.0, False)]]}, {"type": 1, "bbox": [0.0] * 4, "lines": []}]}

    raw = spark.createDataFrame([("d", bytearray(b"ok")), ("e", bytearray(b"bad"))], "doc_id string, content binary")
    pages = store.pdf_pages(raw, fake)
    assert pages.filter("error IS NOT NULL").select("doc_id").collect()[0][0] == "e"
    assert store.page_rules(pages.filter("error IS NULL")).first()["hlines"][0]["y"] == 747.0
    got = store.page_blocks(pages.filter("error IS NULL")).collect()
    assert len(got) == 1 and got[0]["text"] == "Heading x" and got[0]["font_size"] == 12.0 and got[0]["is_bold"] and got[0]["bbox"]["x0"] == 1.0


def test_golden_rules(spark):
    rows = [("1", "unanswerable", [], None), ("2", "unanswerable", [("d", "A", "1", None)], None), ("3", "numeric", [], "x"), ("4", "numeric", [("d", "A", None, None)], "x")]
    df = spark.createDataFrame(rows, "id string, type string, gold array<struct<doc_id:string,scope:string,section:string,page:int>>, answer string")
    assert {r["id"]: r["violation"] for r in store.golden_violations(df).collect()} == {"2": "unanswerable with gold", "3": "answerable without gold", "4": "reference without section and page"}


def test_embedding_strategy(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "one")], "id string, embed_text string")
    got = {r["id"]: r for r in models.embed_texts(df, lambda: models.HashingEmbedder(16), 16).collect()}
    assert len(got["a"]["dense"]) == 16 and got["b"]["dense"] is None and len(got["c"]["sparse"]) == 1
    with pytest.raises(Exception, match="dimensions"):
        models.embed_texts(df, lambda: models.HashingEmbedder(8), 16).collect()

    class Overlap:
        model_id = "overlap"

        def score(self, query, passages):
            return [float(len(set(query.split()) & set(p.split()))) for p in passages]

    pairs = spark.createDataFrame([("one two", "two one"), ("one two", None), ("x", "x y")], "query string, passage string")
    assert sorted(r["rerank_score"] for r in models.rerank_pairs(pairs, Overlap).collect()) == [0.0, 1.0, 2.0]
    answered = models.ask(spark.createDataFrame([("p",), ("boom",)], "prompt string"), lambda p: 1 / 0 if p == "boom" else p.upper()).collect()
    assert [(r["reply"], bool(r["call_error"])) for r in answered] == [("P", False), (None, True)]


def test_streamed_index(spark, tmp_path):
    source, target = str(tmp_path / "chunks"), str(tmp_path / "index")
    empty = spark.createDataFrame([], "point_id string, chunk_id string, doc_id string, text_sha256 string, embedding_model string")
    empty.write.parquet(target)
    spark.createDataFrame([("d:0", "d", "x"), ("d:1", "d", "y")], "id string, doc_id string, embed_text string").write.parquet(source)
    seen = []

    def apply(current, diff, number):
        seen.extend((r["action"]) for r in diff.collect())
        current.write.mode("overwrite").parquet(f"{target}-{number}")

    stream = spark.readStream.schema("id string, doc_id string, embed_text string").parquet(source)
    stream_index(stream, "m", lambda: spark.read.parquet(target), apply, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(seen) == ["insert", "insert"]


def test_a_set_is_rewritten_where_it_was_read(spark, tmp_path):
    path = str(tmp_path / "golden")
    store.write_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), path)
    store.write_jsonl(spark.read.json(path).filter("id = 'b'"), path, order="id")
    assert [r["id"] for r in spark.read.json(path).collect()] == ["b"] and sorted(p.name for p in tmp_path.iterdir()) == ["golden"]


def test_checkpoints_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from quillspark import session

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, getConf=lambda: {})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.cut_lineage(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))


class FakeTokenizer:
    def enable_truncation(self, length, strategy="longest_first"):
        self.cut = (length, strategy)

    def enable_padding(self):
        pass

    def encode_batch(self, texts):
        from types import SimpleNamespace

        words = [[0, *(5 + len(w) for w in (t if isinstance(t, str) else " ".join(t)).split()), 2] for t in texts]
        most = max(map(len, words))
        return [SimpleNamespace(ids=w + [1] * (most - len(w)), attention_mask=[1] * len(w) + [0] * (most - len(w))) for w in words]


class FakeSession:
    def run(self, names, feed):
        import numpy as np

        ids = feed["input_ids"]
        return [np.stack([ids, ids * 0 + 1, feed["attention_mask"]], axis=2).astype(float)] if names is None and ids.shape[1] != 99 else None


def test_exported_models():
    import numpy as np

    from quillspark.functions import models

    assert models.pooled_weights([7, 5, 7, 0, 9], [0.5, 0.2, 0.9, 3.0, -1.0], {0}) == {5: 0.2, 7: 0.9}
    model = models.OnnxEmbedder(FakeSession(), FakeTokenizer(), "m", (np.array([1.0, 0.0, 0.0]), -7.0))
    (dense, sparse), (_, other) = model.embed(["abc de abcd", "a"])
    assert abs(sum(x * x for x in dense) - 1) < 1e-9 and sparse == {8: 1.0, 9: 2.0} and other == {}

    class Scores:
        def run(self, names, feed):
            return [feed["attention_mask"].sum(axis=1, keepdims=True)]

    ranker = models.OnnxReranker(Scores(), FakeTokenizer(), "m", max_length=64, batch=2)
    assert ranker.score("q", ["a b", "a", "a b c"]) == [5.0, 4.0, 6.0] and ranker.tokenizer.cut == (64, "only_second")

"""Jobs from the command line: ``python -m quillspark chunk BLOCKS OUT`` and the like; tables are Parquet folders."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.operators import answers, evaluation, layout, retrieval
from quillspark.plans import pipeline
from quillspark.session import cut_lineage
from quillspark.sources import store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillspark", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, args in {
        "ingest": ["raw", "out"], "chunk": ["blocks", "out"], "index": ["chunks", "index", "out"], "search": ["chunks", "question"], "inspect": ["blocks", "document"],
        "check": ["golden", "chunks"], "eval": ["golden", "chunks", "out", "run"],
        "ask": ["chunks", "question", "url", "model"], "eval-generation": ["golden", "chunks", "blocks", "cache", "out", "run", "url", "model", "judge_model"],
        "label": ["results", "labels", "out"],
    }.items():
        job = jobs.add_parser(name)
        for arg in args:
            job.add_argument(arg)
    ask = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"quillspark {ask.job}").getOrCreate()
    read = spark.read.parquet
    if ask.job == "ingest":
        raw = store.raw_documents(spark, ask.raw).filter("is_pdf")
        pages = store.pdf_pages(raw)
        failed = pages.filter("error IS NOT NULL").select("doc_id", "error").collect()  # one row a broken file
        good = pages.filter("error IS NULL")
        store.save_table(pipeline.annotate_blocks(store.page_blocks(good), store.page_rules(good)), ask.out)
        for row in failed:
            print(f"{row['doc_id']}: {row['error']}")
        return int(bool(failed))
    if ask.job == "chunk":
        store.save_table(pipeline.chunk_blocks(read(ask.blocks)), ask.out)
    elif ask.job == "index":
        made, report = pipeline.update_index(read(ask.chunks), read(ask.index), models.HashingEmbedder, "hashing-64", 64)
        made.write.mode("overwrite").parquet(ask.out)
        report.orderBy("doc_id").show(1000, False)
    elif ask.job == "search":
        asked = spark.createDataFrame([("q", ask.question)], "query_id string, query string")
        corpus = read(ask.chunks).select(F.col("id").alias("chunk_id"), F.col("embed_text").alias("text"), F.col("embed_text").alias("passage"))
        retrieval.final_hits(retrieval.hybrid_search(asked, corpus)).orderBy("final_rank").show(20, 80)
    elif ask.job == "inspect":
        layout.role_counts(read(ask.blocks).filter(F.col("doc_id") == ask.document)).show(1, False)
    elif ask.job == "check":
        golden = read(ask.golden)
        evaluation.golden_profile(golden).orderBy("field", "value").show(200, False)
        bad = store.golden_violations(golden)
        bad.show(50, False)
        return int(bad.head(1) != [] or evaluation.unknown_gold_documents(evaluation.gold_references(golden), read(ask.chunks)).head(1) != [])
    elif ask.job == "eval":
        found = pipeline.evaluate_retrieval(read(ask.golden), read(ask.chunks))
        store.save_run(found["scores"], ask.out, ask.run)
        found["summary"].orderBy("stage", "type", "lang").show(200, False)
    elif ask.job == "ask":
        asked = spark.createDataFrame([("q", ask.question)], "query_id string, question string")
        pipeline.ask(asked, read(ask.chunks), models.ChatEndpoint(ask.url, ask.model)).show(1, False, True)
    elif ask.job == "eval-generation":
        judge = models.ChatEndpoint(ask.url, ask.judge_model, system=answers.JUDGE_PROMPT)
        results, new = pipeline.evaluate_generation(read(ask.golden), read(ask.chunks), read(ask.blocks), models.ChatEndpoint(ask.url, ask.model), judge, read(ask.cache), ask.judge_model)
        results = cut_lineage(results)
        store.append_rows(new, ask.cache)
        store.save_run(results, ask.out, ask.run)
        results.groupBy("outcome").agg(F.count("*").alias("n"), F.avg("score").alias("score")).show()
    elif ask.job == "label":
        evaluation.judge_disagreements(read(ask.results), read(ask.labels)).write.mode("overwrite").parquet(ask.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

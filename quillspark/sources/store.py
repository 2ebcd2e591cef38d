"""Sources and sinks: raw documents, JSON Lines and Parquet tables with manifests, staleness, golden sets, caches."""

from __future__ import annotations

import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text as T

PDF_MAGIC = b"%PDF"


class StoreError(Exception):
    """Stored data that is missing or broken."""


class SchemaVersionError(StoreError):
    """Stored data of another schema version."""


@dataclass(frozen=True)
class KnownDocument:
    key: str
    url: str
    filename: str


def download_document(document: KnownDocument, folder: str, force: bool = False, timeout: float = 60.0) -> str:
    """Fetches a document on the driver unless it is there; refuses what is no PDF. The file appears whole or not at all."""
    target = os.path.join(folder, document.filename)
    if os.path.exists(target) and not force:
        return target
    request = urllib.request.Request(document.url, headers={"User-Agent": "Mozilla/5.0", "Accept": "application/pdf"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        body = reply.read()
    if not body.startswith(PDF_MAGIC):
        raise ValueError(f"{document.key}: not a PDF")
    os.makedirs(folder, exist_ok=True)
    with open(target + ".part", "wb") as out:
        out.write(body)
    os.replace(target + ".part", target)
    return target


def resolve_document(name: str, folder: str, known: dict[str, KnownDocument] | None = None, fetch: Callable[..., str] = download_document) -> str:
    """A local file first, a known document else."""
    local = os.path.join(folder, name)
    if os.path.exists(local):
        return local
    if known and name in known:
        return fetch(known[name], folder)
    raise FileNotFoundError(f"{name} is neither in {folder} nor known; place the file there")


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, sha256, is_pdf, content`` of the files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(T.slug(stem).alias("doc_id"), "path", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(PDF_MAGIC)).alias("is_pdf"), "content")


RawPages = Callable[[bytes], Iterator[dict]]


def pdf_pages(raw: DataFrame, extract: RawPages | None = None) -> DataFrame:
    """``doc_id, number, width, height, rects, blocks`` by an extractor run where the bytes are.

    The default extractor needs PyMuPDF on the executors. A file that it cannot read gives one row with ``error``.
    """
    schema = (
        "doc_id string, number int, width double, height double, rects array<struct<x0:double,y0:double,x1:double,y1:double>>, "
        "blocks array<struct<type:int,bbox:array<double>,lines:array<array<struct<text:string,size:double,bold:boolean>>>>>, error string"
    )
    reader = extract or _mupdf_pages

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "number", "width", "height", "rects", "blocks", "error"]
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    rows = [{"doc_id": doc, "error": None, **page} for page in reader(bytes(content))]
                except Exception as broken:  # one bad file must not end the job
                    rows = [dict.fromkeys(names) | {"doc_id": doc, "error": f"{type(broken).__name__}: {broken}"}]
                yield pd.DataFrame(rows, columns=names)

    return raw.select("doc_id", "content").mapInPandas(read, schema)


def _mupdf_pages(content: bytes) -> Iterator[dict]:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            lines = lambda b: [[{"text": s["text"], "size": s["size"], "bold": bool(s["flags"] & 16)} for s in line["spans"]] for line in b.get("lines", [])]
            blocks = [{"type": b["type"], "bbox": list(b["bbox"]), "lines": lines(b)} for b in page.get_text("dict")["blocks"]]
            rects = [{"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1} for r in (d["rect"] for d in page.get_drawings())]
            yield {"number": page.number + 1, "width": page.rect.width, "height": page.rect.height, "rects": rects, "blocks": blocks}


def page_rules(pages: DataFrame) -> DataFrame:
    """The page table: thin wide rectangles become horizontal rules."""
    thin = F.filter("rects", lambda r: (r["y1"] - r["y0"] < 1.5) & (r["x1"] - r["x0"] > 1))
    return pages.select("doc_id", "number", "width", "height", F.transform(thin, lambda r: F.struct(r["y0"].alias("y"), r["x0"].alias("x0"), r["x1"].alias("x1"))).alias("hlines"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, block_no, text, bbox, font_size, is_bold`` of the text blocks.

    Spans of a line are joined as they are, lines by breaks; the size is the one that most characters have, the first
    among equals; bold is what more than half of them are.
    """
    rows = pages.select("doc_id", F.col("number").alias("page_number"), F.posexplode("blocks").alias("block_no", "b")).filter("b.type = 0")
    text = F.array_join(F.transform("b.lines", lambda line: F.array_join(F.transform(line, lambda s: s["text"]), "")), "\n")
    spans = F.filter(F.flatten("b.lines"), lambda s: F.length(F.trim(s["text"])) > 0)
    sizes = F.array_distinct(F.transform(spans, lambda s: F.bround(s["size"], 1)))
    chars = lambda keep: F.aggregate(F.filter(spans, keep), F.lit(0), lambda a, s: a + F.length(s["text"]))
    rated = F.transform(sizes, lambda z, i: F.struct(F.aggregate(spans, F.lit(0), lambda a, s: a + F.when(F.bround(s["size"], 1) == z, F.length(s["text"])).otherwise(0)).alias("n"), (-i).alias("first"), z.alias("size")))
    box = F.transform("b.bbox", lambda v: F.bround(v, 1))
    corner = lambda i: F.get(box, F.lit(i))
    out = rows.select(
        "doc_id", "page_number", "block_no", T.normalize_text(text).alias("text"),
        F.struct(corner(0).alias("x0"), corner(1).alias("y0"), corner(2).alias("x1"), corner(3).alias("y1")).alias("bbox"),
        F.coalesce(F.array_max(rated)["size"], F.lit(0.0)).alias("font_size"), (2 * chars(lambda s: s["bold"]) > chars(lambda s: F.lit(True))).alias("is_bold"),
    )
    return out.filter(F.length("text") > 0)


def save_table(df: DataFrame, path: str, doc_key: str = "doc_id") -> None:
    """Replaces the documents that ``df`` holds and leaves the others; Spark's commit makes it whole or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(doc_key).parquet(path)


def manifest_rows(df: DataFrame, sources: DataFrame, config: object, version: str) -> DataFrame:
    """One manifest row per document; written after the table, so a manifest always has its rows."""
    return df.groupBy("doc_id").agg(F.count("*").alias("rows")).join(sources.select("doc_id", F.col("sha256").alias("source_sha256")), "doc_id", "left").select(
        "doc_id", F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(version).alias("logic_version"), F.lit(schemas.canonical(config)).alias("config"), "source_sha256", "rows", F.current_timestamp().alias("created_at")
    )


def check_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest, if all of it is of this schema version."""
    other = manifest.filter(F.col("schema_version") != schemas.SCHEMA_VERSION).select("doc_id").head(1)
    if other:
        raise SchemaVersionError(f"{other[0]['doc_id']}: stored under another schema version")
    return manifest


def check_counts(table: DataFrame, manifest: DataFrame) -> None:
    """Raises if a document has not as many rows as its manifest says."""
    counts = table.groupBy("doc_id").count()
    wrong = manifest.join(counts, "doc_id", "left").filter(~F.col("rows").eqNullSafe(F.coalesce("count", F.lit(0)))).head(1)
    if wrong:
        raise StoreError(f"{wrong[0]['doc_id']}: {wrong[0]['rows']} rows by its manifest, {wrong[0]['count']} stored")


def staleness(sources: DataFrame, manifest: DataFrame, config: object, version: str) -> DataFrame:
    """``doc_id, reason``: the first reason why a document must be made anew, null where it is fresh."""
    m = manifest.select("doc_id", "logic_version", "config", "source_sha256", F.lit(True).alias("__kept"))
    joined = sources.select("doc_id", "sha256").join(m, "doc_id", "left")
    reason = (
        F.when(F.col("__kept").isNull(), "no manifest").when(~F.col("logic_version").eqNullSafe(F.lit(version)), "version")
        .when(~F.col("config").eqNullSafe(F.lit(schemas.canonical(config))), "config").when(~F.col("source_sha256").eqNullSafe(F.col("sha256")), "source")
    )
    return joined.select("doc_id", reason.alias("reason"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines under a fixed schema; a broken line, or one with other fields, is an error that names its file."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("file", F.col("_metadata.file_path"))
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    parsed = lines.withColumn("row", F.from_json("value", schema)).withColumn("keys", F.json_object_keys("value"))
    bad = parsed.filter(F.col("row").isNull() | F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*[F.lit(n) for n in names]))) > 0)).select("file", "value").head(1)
    if bad:
        raise StoreError(f"{bad[0]['file']}: bad line {bad[0]['value'][:80]!r}")
    return parsed.select("row.*")


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """JSON Lines, text as it is; ordered if asked.

    Written beside the folder and moved into its place when whole, so a set can be rewritten where it was read from and
    a reader never sees half of one. The old folder goes only once the new one stands beside it.
    """
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    beside, old = target.suffix(".writing"), target.suffix(".old")
    (df if order is None else df.orderBy(order)).write.mode("overwrite").json(beside.toString())
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise StoreError(f"{path} could not be moved away")
    if not fs.rename(beside, target):
        raise StoreError(f"{path} could not be put in place; the new lines are in {beside.toString()}")
    fs.delete(old, True)


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set with its derived split; an id that occurs twice is an error."""
    golden = read_jsonl(spark, path, schemas.GOLDEN)
    twice = golden.groupBy("id").count().filter("count > 1").head(1)
    if twice:
        raise StoreError(f"golden id {twice[0]['id']} occurs {twice[0]['count']} times")
    return golden.withColumn("split", T.golden_split(F.col("id")))


def golden_violations(golden: DataFrame) -> DataFrame:
    """``id, violation``: items that break the rules of a golden set."""
    free = F.exists("gold", lambda g: g["section"].isNull() & g["page"].isNull())
    unanswerable = F.col("type") == "unanswerable"
    return golden.dropDuplicates(["id"]).select(
        "id", F.when(free, "reference without section and page").when(unanswerable & (F.size("gold") > 0), "unanswerable with gold")
        .when(~unanswerable & (F.size("gold") == 0), "answerable without gold").when(unanswerable & F.col("answer").isNotNull(), "unanswerable with answer").alias("violation")
    ).filter("violation IS NOT NULL")


def append_rows(df: DataFrame, path: str) -> None:
    """Labels, cache rows and run records are only ever added."""
    df.write.mode("append").parquet(path)


def save_run(df: DataFrame, path: str, run_id: str) -> None:
    """An evaluation run under its own partition."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

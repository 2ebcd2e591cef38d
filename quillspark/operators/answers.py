"""Replies of a language model: parsing, citation checks, groundedness, and the calls themselves as strategies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.session import cut_lineage

REPLY = "answer string, citations array<struct<chunk:string,quote:string>>, covered boolean"


def parse_replies(raw: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``answer, citations, covered, error``; a reply that is no such JSON is an error and covers nothing.

    The error names its class: ``JSONDecodeError`` where the reply is no JSON, ``ValidationError`` where it lacks a field.
    """
    got = raw.withColumn("__r", F.from_json(reply, REPLY))
    kind = F.when(F.try_parse_json(F.col(reply)).isNull(), "JSONDecodeError").otherwise("ValidationError")
    broken = F.col("__r").isNull() | F.col("__r.answer").isNull() | F.col("__r.covered").isNull()
    empty = F.array().cast("array<struct<chunk:string,quote:string>>")
    return (
        got.withColumn("error", F.when(broken, kind)).withColumn("answer", F.when(broken, "").otherwise(F.col("__r.answer")))
        .withColumn("citations", F.when(broken, empty).otherwise(F.coalesce("__r.citations", empty)))
        .withColumn("covered", F.when(broken, False).otherwise(F.col("__r.covered"))).drop("__r")
    )


def verify_citations(citations: DataFrame, texts: DataFrame, chunk_id: str = "chunk_id", quote: str = "quote") -> DataFrame:
    """Citations with ``verified``: the quotation, evened out, stands in its chunk's text; an empty or unknown one does not.

    The texts are evened once a chunk, and only those that are cited.
    """
    cited = citations.select(chunk_id).distinct()
    store = texts.select(F.col("id").alias(chunk_id), "text").join(cited, chunk_id, "left_semi").dropDuplicates([chunk_id])
    store = store.select(chunk_id, T.match_form(F.col("text")).alias("__text"))
    joined = citations.withColumn("__quote", T.match_form(F.col(quote))).join(store, chunk_id, "left")
    good = (F.col("__quote") != "") & F.contains("__text", "__quote")
    return joined.withColumn("verified", F.coalesce(good, F.lit(False))).drop("__text", "__quote")


def is_grounded(covered: Column, citations: Column) -> Column:
    """Whether an answer that claims coverage has a verified citation; others need none."""
    return ~F.coalesce(covered, F.lit(False)) | F.coalesce(F.exists(citations, lambda c: F.coalesce(c["verified"], F.lit(False))), F.lit(False))


def with_cache(inputs: DataFrame, cache: DataFrame, call: Callable[[pd.Series], pd.Series], key: str = "key", prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """``(all, new)``: verdicts of all inputs, from the cache where it has them, and those newly made.

    ``call`` gets the prompts of a batch and runs once per distinct key that the cache lacks.
    """
    missing = inputs.select(key, prompt).dropDuplicates([key]).join(cache.select(key), key, "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "verdict": call(batch[prompt])})

    made = missing.mapInPandas(ask, f"{key} string, verdict string")
    return inputs.join(cache.select(key, "verdict").unionByName(made), key, "left"), made


def cache_key(*parts: Column) -> Column:
    """Hash of all that a model call depends on."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def extractive_answer(context: Column, question: Column) -> Column:
    """Offline stand-in for an answering model: the sentence that shares most words with the question, as a reply."""
    asked = F.array_distinct(T.tokens(question))
    rated = F.transform(T.sentences(context), lambda s: F.struct(F.size(F.array_intersect(asked, T.tokens(s))).alias("n"), s.alias("s")))
    best = F.array_max(rated)
    return F.to_json(F.struct(F.coalesce(best["s"], F.lit("")).alias("answer"), F.array().cast("array<struct<chunk:string,quote:string>>").alias("citations"), (F.coalesce(best["n"], F.lit(0)) > 1).alias("covered")))


VERDICT = "verdict string, overstated boolean, missing_condition boolean, contradicts_reference boolean, explanation string"
VERDICTS = ("correct", "partial", "incorrect")
#: Changes whenever the wording below does, so that cached verdicts of another wording are not taken for its own.
JUDGE_PROMPT_VERSION = "1"
JUDGE_PROMPT = """You check answers to questions about technical regulations. You are given a question, the reference \
answer of an expert, the evidence (the passages that settle the question), the answer to be checked, and its quotations.

Verdict: "correct" if every fact that the question asks for is there and agrees with the evidence, in whatever words or \
language; "partial" if the core is right but a fact or condition is missing, imprecise or not supported; "incorrect" if a \
fact is wrong or the question is left unanswered.
Flags, whatever the verdict: "overstated" if more is claimed than the evidence supports; "missing_condition" if a \
condition, class or exception of the evidence is left out; "contradicts_reference" if the reference or the evidence says \
otherwise. Where reference and evidence differ, the evidence holds. Neither tone nor length counts.

Reply with JSON only: {"verdict": "correct|partial|incorrect", "overstated": false, "missing_condition": false, \
"contradicts_reference": false, "explanation": "one or two sentences"}
"""


def parse_verdicts(raw: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``judge`` and ``judge_error``: the verdict of a judge's reply, flags that it leaves out being false; a reply
    that is no JSON or has no known verdict is an error with its first 200 characters."""
    got = raw.withColumn("__v", F.from_json(reply, VERDICT))
    good = F.coalesce(F.col("__v.verdict").isin(*VERDICTS), F.lit(False))
    flag = lambda n: F.coalesce(F.col(f"__v.{n}"), F.lit(False)).alias(n)
    verdict = F.struct(F.col("__v.verdict").alias("verdict"), flag("overstated"), flag("missing_condition"), flag("contradicts_reference"), F.coalesce("__v.explanation", F.lit("")).alias("explanation"))
    error = F.concat(F.lit("JudgeError: unparseable judge output: "), F.substring(F.coalesce(reply, F.lit("")), 1, 200))
    return got.withColumn("judge", F.when(good, verdict)).withColumn("judge_error", F.when(~good, error)).drop("__v")


def judge_answers(inputs: DataFrame, cache: DataFrame, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """``(judged, new)``: the inputs (``key, prompt`` and more) with ``judge`` and ``judge_error``, and the ``key, judge``
    rows to add to the cache.

    Each distinct key that the cache lacks is asked once. What cannot be read or asked is an error of its rows and is
    not cached, so the next run asks again. ``new`` should be stored before it is used twice, as it makes the calls.
    """
    wanted = inputs.select("key", "prompt").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    asked = cut_lineage(parse_verdicts(models.ask(wanted, call)).withColumn("judge_error", F.coalesce("call_error", "judge_error")))
    new = asked.filter("judge IS NOT NULL").select("key", "judge")
    known = cache.select("key", "judge", F.lit(None).cast("string").alias("judge_error")).dropDuplicates(["key"])
    return inputs.join(known.unionByName(asked.select("key", "judge", "judge_error")), "key", "left"), new


def judge_consistency(judged: DataFrame, call: Callable[[str], str], sample: int, order: str = "id") -> DataFrame:
    """``judged, share``: the first ``sample`` judged rows in order are asked again, without the cache; the share of
    verdicts that stay, to three places (null without any). A reply that cannot be read counts as another verdict."""
    some = judged.filter("judge IS NOT NULL").orderBy(order).limit(sample).select("prompt", F.col("judge.verdict").alias("first"))
    again = parse_verdicts(models.ask(some, call))
    same = F.coalesce(F.col("judge.verdict") == F.col("first"), F.lit(False)).cast("double")
    return again.agg(F.count("*").alias("judged"), F.round(F.avg(same), 3).alias("share"))

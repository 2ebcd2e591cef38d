"""Per-document text statistics, exact per-language ranks of them, and the kind of text they tell.

Statistics come from one pass over whole texts. Their empirical distribution comes from a range-partitioned sort
of the distinct values with partition offsets; tail probabilities are combined into one outlier score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

# Frequent function words by language.
COMMON = {
    "en": "the of and to a in is be shall may with for by not or as at on after when an than was which any each that if must from it this two has are",
    "de": "der die das und zu in ist mit den von des nicht ein eine am für auf bei wird oder nach muss darf soll werden wie vor kann durch sobald sofern dem",
    "fr": "le la les de des du et à en est un une que pour dans par sur au avec ne pas ou se être cas selon entre doit peut",
    "ru": "и в не на с по для от при к как или за то из что до может быть должна так же чем где а если во когда через после о",
    "hi": "के की का में से और है पर को यह हो ने कम होनी चाहिए नहीं अनुसार होती बीच इसे लिखा वह जब तो",
    "ar": "في من على إلى أن لا عن هذا هل بين عند يجب التي وفقا قبل كل هو ألا يجوز",
}
# Frequent function characters of scripts written without blanks.
COMMON_CHARACTERS = {"ja": "のはをにがでとるすい", "zh": "的是在了不应与每须为于", "th": "ต้องให้ไม่ที่และนมา"}
#: Ranked statistics with the number of decimals they are defined to and the largest value told apart; so the distinct
#: values of one language number at most max * 10 ** decimals + 1, whatever the corpus. ``entry_share`` is the share of
#: characters in lines that are list entries or rows of cells.
STATS = {
    "mean_word_length": (2, 60.0),
    "symbol_ratio": (3, 1.0),
    "digit_ratio": (3, 1.0),
    "end_punctuation_share": (3, 1.0),
    "common_word_share": (3, 1.0),
    "distinct_word_index": (2, 60.0),
    "entry_share": (3, 1.0),
    "letter_share": (3, 1.0),
    "short_word_share": (3, 1.0),
}
#: The tail that is unlike prose: 1 the upper, -1 the lower.
TAILS = {
    "mean_word_length": 1, "symbol_ratio": 1, "digit_ratio": 1, "end_punctuation_share": -1, "common_word_share": -1,
    "distinct_word_index": -1, "entry_share": 1, "letter_share": -1, "short_word_share": -1,
}
#: Weight of the corpus in the tail of a language, in documents: a language with few of its own borrows from all.
CORPUS_WEIGHT = 100
#: Documents from this outlier score on are candidates for anything but prose.
OUTLIER = 5.0
UNKNOWN, CORPUS = "und", "*"

# Marks that stand for unreadable or misread print.
DAMAGE_MARKS = "�~^¦¬§¤°#$%@{}\\ÐÑÂÃØÙ"
# Code point ranges of scripts.
SCRIPT_RANGES = {
    "la": [(0x41, 0x24F)], "ru": [(0x400, 0x52F)], "ar": [(0x600, 0x6FF)], "hi": [(0x900, 0x97F)],
    "th": [(0xE00, 0xE7F)], "ja": [(0x3040, 0x30FF)], "zh": [(0x3400, 0x9FFF)],
}
_SPACE, _DIGIT, _DAMAGE, _OTHER, _LETTER = 0, 1, 2, 3, 4

_END = re.compile(r"""[.!?…。！？।؟:;]\s?["'’”»)\]）」』“]*\s*$""")
_CELL = r"[^,;\t|\n]{0,60}"
_TABLE = re.compile(
    "|".join(
        [
            r"\t",
            r"\|\|",
            r"</?t[rdh]\b",
            r"\s\|\s",
            r"\s{2}[·•]\s{2}",
            r"\S {3,}\S.*\S {3,}\S",
            r"^\S.{0,60}? {4,}\S.{0,60}$",
            rf"^(?:{_CELL};(?!\s)){{2,}}{_CELL}$",
            rf"^(?:{_CELL},(?!\s)){{2,}}{_CELL}$",
            r"^[\s|+:—=-]*-{3,}[\s|+:—=-]*$",
        ]
    )
)
_HARD_CELL = re.compile(r"\t|\|\||</?t[rdh]\b")
_CONTENTS = re.compile(r"(?:\.{4,}|…{2,}|(?:\. ){4,}|_{4,})\s*\d+\s*$")
_MARKED = re.compile(r"^\s*(?:[-*•·–—◦▪+]|\[[ xX]?\]|\(?[^\W_]{1,3}[.)]|\d+(?:\.\d+)*\.?)\s+\S")
#: An entry is shorter than a line of running text; scripts without blanks say more in a character.
ENTRY_CHARS, ENTRY_CHARS_DENSE, MARKED_CHARS = 52, 26, 90
_DENSE = ("ja", "zh", "th")
# Thai words of a clause; a line that holds one is no entry.
_THAI_CLAUSE = re.compile("ต้อง|ให้|ห้าม|เมื่อ|ไม่|ตาม")

STATISTICS = (
    "lang_found string, n_chars int, word_count int, mean_word_length double, symbol_ratio double, digit_ratio double, "
    "end_punctuation_share double, common_word_share double, distinct_word_index double, letter_share double, "
    "short_word_share double, list_share double, table_share double, line_count int"
)


def _code_classes() -> np.ndarray:
    """Class of each code point of the basic plane; letters and their marks by script from ``_LETTER`` on."""
    classes = np.full(0x10000, _OTHER, dtype=np.uint8)
    scripts = list(SCRIPT_RANGES)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if chr(c).isspace():
            classes[c] = _SPACE
        elif kind == "Nd":
            classes[c] = _DIGIT
        elif 0x80 <= c <= 0x9F or 0x2500 <= c <= 0x259F or chr(c) in DAMAGE_MARKS:
            classes[c] = _DAMAGE
        elif kind[0] in "LM":
            at = next((i for i, k in enumerate(scripts) if any(a <= c <= b for a, b in SCRIPT_RANGES[k])), len(scripts))
            classes[c] = _LETTER + at
    return classes


def _statistics(text: str, classes: np.ndarray, common: dict[str, frozenset[str]]) -> tuple:
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    tally = np.bincount(classes[np.minimum(points, 0xFFFF)], minlength=_LETTER + len(SCRIPT_RANGES) + 1)
    letters = int(tally[_LETTER:].sum())
    by_script = dict(zip(SCRIPT_RANGES, tally[_LETTER:].tolist()))
    words = text.split()
    low = [w.strip(".,;:!?()\"'«»“”„").lower() for w in words]
    distinct = set(low)
    script = max(by_script, key=by_script.get)
    # kana make a text Japanese, however many other characters it holds
    if script in ("ja", "zh"):
        script = "ja" if by_script["ja"] * 8 > by_script["zh"] else "zh"
    lang = script
    if n == 0 or by_script[script] < 0.2 * n and script not in ("ja", "zh"):
        lang = "und"
    elif script == "la":
        hits, lang = max((len(distinct & common[k]), k) for k in ("en", "de", "fr"))
        lang = lang if hits >= 2 else "und"
    if lang in COMMON_CHARACTERS:
        share = sum(map(text.count, COMMON_CHARACTERS[lang])) / max(letters, 1)
    elif lang in common:
        known = common[lang]
        share = sum(w in known for w in low) / max(len(low), 1)
    else:
        share = 0.0
    entry, marked = (ENTRY_CHARS_DENSE, 20) if lang in ("ja", "zh") else (ENTRY_CHARS, 40)
    solid = max(n - int(tally[_SPACE]), 1)
    in_list = in_table = ended = lines = 0
    for line in text.split("\n"):
        trimmed = line.strip()
        if not trimmed:
            continue
        lines += 1
        size = len(line)
        if _CONTENTS.search(line):
            in_list += size
        elif _END.search(trimmed[-8:]) and not _HARD_CELL.search(line):
            ended += 1
            if size < marked and _MARKED.match(line):
                in_list += size
        elif _TABLE.search(line):
            in_table += size
        elif lang == "th" and _THAI_CLAUSE.search(line):
            pass
        elif lang in common and sum(w in common[lang] for w in trimmed.lower().split()) >= 2:
            pass
        elif len(trimmed) <= entry or size <= MARKED_CHARS and _MARKED.match(line):
            in_list += size
    whole, n_words = max(n, 1), max(len(words), 1)
    return (
        lang, n, len(words), (n - int(tally[_SPACE])) / n_words, int(tally[_DAMAGE]) / solid, int(tally[_DIGIT]) / solid,
        ended / max(lines, 1), share, len(set(words)) / n_words**0.5, letters / solid,
        sum(len(w) <= 3 for w in low) / n_words, in_list / whole, in_table / whole, lines,
    )


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the statistics, the language found in the text itself, and character shares by kind of line.

    Defined for every document: null and empty texts have zeros and language ``und``. Whole texts, no shuffle. A pass
    over code points in Arrow batches; as built-in expressions the same took seven times the CPU.
    """
    names = [x.split()[0] for x in STATISTICS.split(", ")]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = _code_classes()
        common = {k: frozenset(v.split(" ")) for k, v in COMMON.items()}
        for batch in batches:
            rows = [_statistics(t or "", classes, common) for t in batch[text]]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "doc_id", batch[doc_id].to_numpy())
            yield out

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInPandas(measure, f"doc_id {kind}, {STATISTICS}")


def _steps(name: str) -> Column:
    decimals, most = STATS[name]
    return F.round(F.least(F.greatest(F.col(name), F.lit(0.0)), F.lit(most)) * 10**decimals).cast("int")


def tail_tables(stats: DataFrame) -> DataFrame:
    """``lang_found, stat, step, lower, upper, docs``: for each distinct value the exact share of the language's
    documents at or below it and at or above it, and their number; the whole corpus is the language ``*``.

    Counts are aggregated first, so a value that a third of all documents share is one row. The distinct values are
    sorted by ranges; a partition's ranks start at the offset that the partitions before it add up to.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), _steps(k).alias("step")) for k in STATS]))
    counts = stats.select("lang_found", pairs.alias("x")).groupBy("lang_found", "x.stat", "x.step").count()
    both = counts.select(F.explode(F.array("lang_found", F.lit(CORPUS))).alias("lang_found"), "stat", "step", "count")
    counts = both.groupBy("lang_found", "stat", "step").agg(F.sum("count").alias("count"))
    ranged = counts.repartitionByRange("lang_found", "stat", "step").sortWithinPartitions("lang_found", "stat", "step")
    placed = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("lang_found", "stat", "part").agg(F.sum("count").alias("n"))
    before = totals.select(
        "lang_found", "stat", "part",
        F.expr("sum(n) over (partition by lang_found, stat order by part) - n").alias("offset"),
        F.expr("sum(n) over (partition by lang_found, stat)").alias("docs"),
    )
    # bounded by languages x statistics x partitions
    local = placed.withColumn("upto", F.expr("sum(count) over (partition by lang_found, stat, part order by step)"))
    ranks = local.join(F.broadcast(before), ["lang_found", "stat", "part"]).withColumn("rank", F.col("offset") + F.col("upto"))
    upper = F.col("docs") - F.col("rank") + F.col("count")
    return ranks.select("lang_found", "stat", "step", (F.col("rank") / F.col("docs")).alias("lower"), (upper / F.col("docs")).alias("upper"), "docs")


def surprise_tables(tails: DataFrame) -> DataFrame:
    """``lang_found`` and one array per statistic: at place ``step`` the negative logarithm of the tail probability.

    The tail of a language is that of its own documents and, with the weight of ``CORPUS_WEIGHT`` documents, that of
    the corpus; texts of no known language are ranked in the corpus alone. One row a language, each array at most
    max * 10 ** decimals + 1 long (see ``STATS``).
    """
    side = F.lit(None).cast("double")
    for name, way in TAILS.items():
        side = F.when(F.col("stat") == name, F.col("upper" if way > 0 else "lower")).otherwise(side)
    one = tails.select("lang_found", "stat", "step", "docs", side.alias("tail"))
    corpus = one.filter(F.col("lang_found") == CORPUS).select("stat", "step", F.col("tail").alias("all"))
    own = one.filter(F.col("lang_found") != CORPUS).join(corpus, ["stat", "step"])
    n = F.when(F.col("lang_found") == UNKNOWN, 0).otherwise(F.col("docs"))
    value = -F.ln((n * F.col("tail") + CORPUS_WEIGHT * F.col("all")) / (n + CORPUS_WEIGHT))
    grid = own.groupBy("lang_found", "stat").agg(F.max("step").alias("top")).select("lang_found", "stat", F.explode(F.sequence(F.lit(0), "top")).alias("step"))
    dense = grid.join(own.select("lang_found", "stat", "step", value.alias("v")), ["lang_found", "stat", "step"], "left")
    placed = F.transform(F.array_sort(F.collect_list(F.struct("step", F.coalesce("v", F.lit(0.0)).alias("v")))), lambda x: x["v"])
    arrays = dense.groupBy("lang_found", "stat").agg(placed.alias("values"))
    return arrays.groupBy("lang_found").agg(*[F.max(F.when(F.col("stat") == k, F.col("values"))).alias(f"__{k}") for k in STATS])


def scored(stats: DataFrame) -> DataFrame:
    """The statistics with ``outlier_score``: the summed negative logarithms of the tail probabilities."""
    stats = cut_lineage(stats.withColumn("entry_share", F.col("list_share") + F.col("table_share")))
    surprise = cut_lineage(surprise_tables(tail_tables(stats))).withColumnRenamed("lang_found", "__lang")
    # one row a language
    out = stats.join(F.broadcast(surprise), F.col("lang_found") == F.col("__lang"), "left")
    score = F.lit(0.0)
    for name in STATS:
        score = score + F.coalesce(F.get(f"__{name}", _steps(name)), F.lit(0.0))
    return out.withColumn("outlier_score", F.round(score, 6)).drop("__lang", *[f"__{k}" for k in STATS])


def with_kind(rated: DataFrame) -> DataFrame:
    """Adds ``kind``: prose, list, table or junk.

    The outlier score decides which documents can be other than prose at all. An exact check of the candidates' lines
    and characters then says which kind of outlier it is, or that it is unusual prose (short, of many figures, or with
    a list in it) after all.
    """
    dense = F.col("lang_found").isin(*_DENSE)
    rows = F.col("entry_share")
    loose = rows < 0.5
    unreadable = (
        (F.col("letter_share") < 0.12) & (F.col("digit_ratio") < 0.2)
        | (F.col("letter_share") < 0.3) & (F.col("digit_ratio") < 0.2) & loose
        | (F.col("symbol_ratio") > 0.1)
        | ~dense & (F.col("mean_word_length") > 28) & (F.col("table_share") < 0.5)
    )
    wordless = (
        ~dense & loose & (F.col("common_word_share") < 0.05) & (F.col("short_word_share") < 0.1) & (F.col("word_count") >= 6)
    )
    repeated = (F.col("distinct_word_index") < 1.6) & (F.col("word_count") >= 12) & (F.col("end_punctuation_share") < 0.5) & (F.col("table_share") < 0.5)
    empty = F.col("word_count") == 0
    return rated.withColumn(
        "kind",
        F.when(F.col("outlier_score") < OUTLIER, F.when(empty, "junk").otherwise("prose"))
        .when(empty | unreadable | wordless | repeated, "junk")
        .when(rows > 0.5, F.when(F.col("table_share") >= F.col("list_share"), "table").otherwise("list"))
        .otherwise("prose"),
    )


def document_kinds(docs: DataFrame) -> DataFrame:
    """Statistics, outlier score and kind of every document; repeated rows come out as often as they come in."""
    return with_kind(scored(text_statistics(docs)))


def not_prose(docs: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents that are not prose."""
    return document_kinds(docs).filter("kind <> 'prose'").select("doc_id", "kind").distinct()

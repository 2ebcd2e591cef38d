"""Unfit prompt and reply pairs: empty, truncated, refusing, copying and foreign-language answers.

Refusals are not looked up in a list, nor told by any label. Reply openings, with the question's own words masked, are
clustered by the exact Jaccard similarity of their shingles. An opening that recurs across unrelated questions is a
template; where the replies that use it say nothing that the question did not hold, it is one of refusals, for only what
answers nothing fits any question. The other defects are told by checks of the single pair.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.graph import components
from quillspark.llm.overlap import evened, flat_text, question_classes, question_terms, without_frames
from quillspark.llm.quality import COMMON
from quillspark.session import cut_lineage

SHINGLE = 5
#: Shingles that two openings of similarity 0.8 may differ in, to those they share.
ROOM = 0.25
#: Different questions over which an opening recurs that is a template.
MIN_QUESTIONS = 3
#: A last word is cut off if a longer one that it begins is used so many times as often.
CUT_RATIO = 10
OPENING_WORDS, OPENING_SENTENCES = 18, 3

# Placeholders that stand for no answer.
PLACEHOLDERS = "null none nil nan n/a na n.a. tbd todo undefined empty blank missing - -- ... {} [] () \"\" '' ? . no_answer noanswer placeholder xxx".split()
# Words and signs that a finished sentence does not end on.
DANGLING = frozenset(
    "the a an of to in on at by for with from and or but as that which who if when than is are was be shall must may not its this into per only because while since "
    "provided until unless less between under over after before "
    "der die das dem den des ein eine einem einer von zu im mit auf und oder aber wie wenn als ist sind muss darf für durch bei sofern sobald nicht "
    "le la les de des du et à en un une que pour par sur au avec ou dont est sont qui ne pas "
    "и в на не с по для от при к как или что который которая которое которые если а но без до из об о так то чем мин при когда где".split()
)
DANGLING_CJK = ("并且", "但是", "以及", "因为", "所以", "如果", "而且", "或者", "的", "和", "与", "在", "为", "是", "且", "见", "および", "ので", "が", "を", "に", "の", "と", "は")
# Units, which are the same in any language.
UNITS = frozenset("mm cm m km kg g t n kn hz s h min kmh v a w kw c мм см м км кг г т н кн гц с ч мин в а вт".split())

# Articles and prepositions, which hold one mention of a thing together.
LINKS = frozenset(
    "the a an of to in on at by for with from s der die das des dem den von zu zum zur im am le la les de des du l d "
    "в на у с о об для к по".split()
)
# Words that answer a question on their own.
POLAR = frozenset("yes no ja nein oui non да нет sí si não sim 是 否 不是 はい いいえ نعم لا हाँ नहीं ใช่ ไม่ใช่".split())

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_TERMINAL = re.compile(r"[.!?。！？।؟．]$")
_CLOSERS = re.compile(r"(?:[\s\"'”’»）)\]】」』“]|\[[A-Za-z]?\d+(?:\s*[,;-]\s*[A-Za-z]?\d+)*\])+$")
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"'”»)]+|(?<=[。！？])[\s”」』]*|\s[—–]\s")
_OPENING_PART = re.compile(_SENTENCE.pattern + r"|(?<=[:：])\s*")
_CITED = re.compile(r"\[[A-Za-z]?\d+(?:\s*[,;-]\s*[A-Za-z]?\d+)*\]\s*$")
_FIGURE = re.compile(r"\d+(?:[.,]\d+)*")
_LABEL = re.compile(r"(?i)\b[cс]\d+\b")
_WORDS = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|\d+(?:[.,  ]\d+)*|[^\W\d_]+")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"]*\"|「[^」]*」|『[^』]*』|《[^》]*》")
_SCRIPTS = {
    "la": re.compile(r"[A-Za-zÀ-ɏ]"), "ru": re.compile(r"[Ѐ-ӿ]"), "zh": re.compile(r"[㐀-鿿]"), "ja": re.compile(r"[぀-ヿ]"),
    "ar": re.compile(r"[؀-ۿ]"), "hi": re.compile(r"[ऀ-ॿ]"), "th": re.compile(r"[฀-๿]"),
}
# Frequent function words of further languages in Latin letters.
_FURTHER = {
    "es": "el los las del y en es una que para con por se debe según al como lo no su más puede cada entre está",
    "it": "il lo gli della del e di è una che per con non si deve secondo al come più può ogni tra alla dal nel",
    "nl": "het een van en is voor met niet moet volgens aan op bij dat wordt worden ten minste als de elke tussen zoals",
    "pt": "o os da do e em é uma que para com por não deve segundo ao como se mais pode cada entre pela",
    "pl": "i w na nie jest że dla z do oraz się musi według jak co lub każdy przez od po",
    "sv": "och att det som en är för med inte på av enligt till måste den ett vid eller varje mellan",
}
_COMMON = {k: frozenset(COMMON[k].split()) for k in ("en", "de", "fr")} | {k: frozenset(v.split()) for k, v in _FURTHER.items()}
_LANGUAGES = {w: tuple(k for k, known in _COMMON.items() if w in known) for w in frozenset().union(*_COMMON.values())}
# Letters that one Cyrillic language has and another lacks.
_CYRILLIC_MARKS = {"ru": "ыэёъ", "uk": "іїєґ", "be": "ўі", "sr": "ђјљњћџ"}


@lru_cache(maxsize=256)
def _clean(text: str | None) -> str:
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text or "")).strip()


def is_empty(answer: str | None) -> bool:
    """Null, blank, a placeholder, or nothing but signs."""
    text = _clean(answer).lower()
    bare = text.strip(" \t\r\n<>()[]{}\"'`*_")
    return not any(c.isalnum() for c in text) or text in PLACEHOLDERS or bare in PLACEHOLDERS


@lru_cache(maxsize=50_000)
def _asked(question: str) -> list[str]:
    return evened(question_terms(question))


def is_copy(question: str | None, answer: str | None) -> bool:
    """Whether the answer gives the question back, in any writing or introduced by a few words, and ends with it."""
    # most of the question's terms must be there, so most of its length
    if not question or not answer or 2 * len(answer) < len(question):
        return False
    asked = _asked(question)
    if len(asked) < 3:
        return False
    have = set(asked)
    # most terms must be there as they are; figures, classes and words that replace one another may be written otherwise
    plain = flat_text(answer)
    if sum(w not in plain for w in have) > 2 + 0.3 * len(have):
        return False
    said = evened(question_terms(answer))
    if not said:
        return False
    given = set(said)
    if len(have & given) < 0.9 * len(have):
        return False
    extra = given - have
    last = max(i for i, w in enumerate(said) if w in have)
    return len(extra) <= max(8, len(have) // 2) and not any(w[0].isdigit() for w in extra) and len(set(said[last + 1 :]) - have) == 0


def _script(text: str) -> str | None:
    if text.isascii():
        return "la" if any(map(str.isalpha, text)) else None
    counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    if counts["ja"]:
        counts["ja"] += counts["zh"]
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def _latin_language(words: list[str]) -> tuple[str, dict[str, int]]:
    hits = dict.fromkeys(_COMMON, 0)
    for w in words:
        for k in _LANGUAGES.get(w, ()):
            hits[k] += 1
    return max(hits, key=hits.get), hits


def is_foreign(question: str | None, answer: str | None) -> bool:
    """Whether the answer is in another language than the question; names, figures, units and quotations aside."""
    asked = _clean(question)
    own = {w.lower() for w in _WORDS.findall(asked)}
    said = _QUOTED.sub(" ", _clean(answer))
    words = [w for w in _WORDS.findall(said) if not w[0].isdigit() and w.lower() not in UNITS]
    # a capital inside a sentence or a word of the question may be a name
    telling = [w for w in words if w.lower() not in own or w.islower()]
    a, b = _script(_QUOTED.sub(" ", asked)), _script("".join(w for w in telling if w.lower() not in own))
    if a is None or b is None:
        return False
    if {a, b} == {"zh", "ja"}:
        # Japanese prose does not go without kana, nor Chinese with them
        return b == "ja" and len(_SCRIPTS["ja"].findall(said)) >= 3 or b == "zh" and sum(map(bool, map(_SCRIPTS["zh"].match, telling))) >= 8
    if a != b:
        # a capital inside a sentence may be a name's, the first one is not
        first = {part.split()[0].strip("\"'«»“”„()[]") for part in _SENTENCE.split(said) if part.split()}
        foreign = [w for w in telling if _SCRIPTS[b].match(w) and (w.islower() or w in first or b not in ("la", "ru"))]
        home = [w for w in telling if _SCRIPTS[a].match(w) and w.lower() not in own]
        # a character says less than a word
        return len(foreign) >= 2 and len(foreign) > 2 * len(home) / (3 if a in ("zh", "ja", "th") else 1)
    if a == "ru":
        marks = lambda t: {k for k, m in _CYRILLIC_MARKS.items() if sum(map(t.lower().count, m)) >= 2}
        return bool(marks(said) - {"ru"}) and "ru" not in marks(said) and not marks(asked) - {"ru"}
    if a != "la":
        return False
    low = [w.lower() for w in words]
    mine, hits_q = _latin_language([w.lower() for w in _WORDS.findall(asked)])
    theirs, hits = _latin_language(low)
    return hits_q[mine] >= 2 and mine != theirs and hits[theirs] >= 2 and hits[theirs] >= 2 * hits[mine] + 1


def is_truncated(answer: str | None, cut: bool) -> bool:
    """Whether the answer breaks off: no end mark, and more than a short complete reply.

    ``cut`` tells that its last word is the beginning of a far more frequent one (see ``cut_words``).
    """
    text = _clean(answer)
    bare = _CLOSERS.sub("", text)
    if not bare:
        return False
    # a bracket that stays open, and a quotation, whatever mark the text ends on
    opened = sum(text.count(x) for x in "([（「『«") - sum(text.count(x) for x in ")]）」』»")
    if opened > 0 or text.count('"') % 2 and not re.search(r"\d\s?\"", text):
        return True
    if _TERMINAL.search(bare) and not bare.endswith("..."):
        return False
    if _CITED.search(text):
        return False
    opened = sum(text.count(x) for x in "“„") - sum(text.count(x) for x in "”") - min(text.count("„"), text.count("“"))
    if opened > 0 or text[-1] in ",;:，、；：-–—(（/" or text.endswith(("...", "…")):
        return True
    *done, part = _SENTENCE.split(bare)
    words = _WORDS.findall(part)
    if not words:
        return False
    last = words[-1].lower()
    figure = any(w[0].isdigit() for w in words)
    if figure and text[-1] in ")）]" and len(words) <= 12:
        return False
    if figure and (last[0].isdigit() or last in UNITS or part.rstrip().endswith(("毫米", "厘米", "米", "千克", "公斤", "秒", "度"))) and len(words) <= 8:
        return False
    if last in DANGLING or bare.endswith(DANGLING_CJK) or cut and last not in UNITS:
        return True
    dense = bool(_SCRIPTS["zh"].search(part) or _SCRIPTS["ja"].search(part))
    short = (8 if dense else 4) if figure else (6 if dense else 3)
    return bool(done) or len(words) > short


def _mentions(question: str, part: str) -> int:
    """How many things of the question a part of the reply speaks of: runs of the question's words, with articles and
    prepositions between. Characters of scripts without blanks count from two in the question's order on."""
    own = _WORDS.findall(without_frames(question))
    exact, starts, joined = set(own), {w[:4] for w in own if len(w) > 4}, "".join(own)
    words = _WORDS.findall(part)
    n, apart = 0, True
    for i, w in enumerate(words):
        low = w.lower()
        if _SCRIPTS["zh"].match(low) or _SCRIPTS["ja"].match(low) or _SCRIPTS["th"].match(low):
            near = words[i - 1 : i + 2] if i else words[:2]
            meant = any(x + y in joined for x, y in zip(near, near[1:]) if w in (x, y))
        else:
            common = low in _LANGUAGES or len(low) < 4
            meant = not common and (low in exact or len(low) > 4 and low[:4] in starts)
        if meant:
            n += apart
            apart = False
        elif low not in LINKS:
            apart = True
    return n


def says_nothing(question: str | None, answer: str | None) -> bool:
    """Whether a reply adds nothing to its question: no figure but the question's and the labels of the context, no
    sentence that ties two of the question's things together, and no plain yes or no."""
    text = _LABEL.sub(" ", _clean(answer))
    asked = _clean(question)
    if set(_FIGURE.findall(text)) - set(_FIGURE.findall(asked)):
        return False
    parts = [x for x in _OPENING_PART.split(text) if x.strip()]
    words = _WORDS.findall(parts[0].lower()) if parts else []
    return bool(words) and not POLAR.issuperset(words) and all(_mentions(asked, x) < 2 for x in parts)


def openings(question: str | None, answer: str | None) -> list[list[str]]:
    """The masked beginnings of the first sentences of a reply; a sentence of a word or two is left out beside others."""
    parts = [x for x in _OPENING_PART.split(_clean(answer)) if x.strip()][:OPENING_SENTENCES]
    masked_parts = [opening(question, x) for x in parts]
    return [m for m in masked_parts if len(m) > 1] or masked_parts


def opening(question: str | None, answer: str | None) -> list[str]:
    """The first words of a sentence with the question's words and all names and figures masked by one sign a run."""
    own = _WORDS.findall(without_frames(question or ""))
    exact, starts = set(own), {w[:4] for w in own if len(w) > 4}
    out: list[str] = []
    for i, w in enumerate(_WORDS.findall(answer or "")):
        low = w.lower()
        common = low in _LANGUAGES or len(low) < 4 and not low.isdigit() and not _SCRIPTS["zh"].match(low)
        if w[0].isdigit() or not common and (low in exact or len(low) > 4 and low[:4] in starts) or i and w[0].isupper() and w[1:].islower() and len(w) > 3:
            low = "\x01"
        if len(low) == 1 and low.isalpha() and low.isascii() and out[-1:] == ["\x01"]:
            continue  # the s of a masked word
        if out[-1:] != [low] or low != "\x01":
            out.append(low)
    return out[:OPENING_WORDS]


def _shingles(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def _signatures(words: list[str]) -> list[tuple[int, int, int]]:
    """``(signature, size, left_out)`` of each subset of an opening's shingles that a similar opening may share.

    Two sets that share C and leave out x and y shingles have a similarity of |C| / (|C| + x + y) at least, so for 0.8
    x + y may be |C| / 4 at most. An opening has at most 14 shingles, so x is at most 2 and subsets at most 106.
    """
    codes = [int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "big") for s in _shingles(words)]
    n, total = len(codes), sum(codes)
    out = []
    for x in range(n):
        if x > (n - x) * ROOM:
            break
        out += [((total - sum(c)) % 2**64 - 2**63, n - x, x) for c in combinations(codes, x)]
    return out


def opening_clusters(keyed: DataFrame) -> DataFrame:
    """``key, root`` for distinct openings with ``key, opening``: the connected components of all pairs of openings whose
    shingles have a Jaccard similarity of 0.8 or more.

    Every such pair shares a subset of shingles (see ``_signatures``), and among the openings that hold a subset each one
    that is similar to any by it is similar to the one that leaves out least. So one edge to that one a row and subset
    gives the same components as all pairs, without a bucket being paired.
    """
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *s) for k, o in zip(batch["id"], batch["opening"]) for s in _signatures(list(o))]
            yield pd.DataFrame(rows, columns=["id", "sign", "size", "x"])

    ids = keyed.withColumn("id", F.xxhash64("key"))
    signed = cut_lineage(ids.select("id", "opening").mapInPandas(sign, "id long, sign long, size int, x int"))
    heads = signed.groupBy("sign", "size").agg(F.min(F.struct("x", "id")).alias("h"), F.count("*").alias("n")).filter("n > 1")
    near = signed.join(heads, ["sign", "size"]).filter((F.col("x") + F.col("h.x")) <= F.col("size") * F.lit(ROOM))
    roots = components(near.select(F.col("id").alias("a"), F.col("h.id").alias("b")))
    return ids.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", F.coalesce("root", "id").alias("root"))


def template_openings(replies: DataFrame) -> DataFrame:
    """``opening`` of each template among replies with ``opening, question``.

    Distinct openings are counted first, so a template that a third of all replies use is one row; then they are
    clustered by ``opening_clusters``. A cluster is a template if it answers ``MIN_QUESTIONS`` unrelated questions:
    distinct classes of equal ones (``overlap.question_classes``), not rows or writings.
    """
    uses = cut_lineage(replies.select("opening", "question").distinct())
    counted = uses.select("opening").distinct().withColumn("key", F.array_join("opening", " "))
    label = cut_lineage(opening_clusters(counted))
    asked = uses.select("question", F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("source")).distinct()
    classes = question_classes(asked, item="question")[0].select(F.col("id").alias("question"), "class")
    # a question without words is a class of its own, and so is the null one
    classed = uses.join(classes, "question", "left").withColumn("class", F.coalesce("class", F.xxhash64(F.lit("?"), "question")))
    recurring = (
        classed.select(F.array_join("opening", " ").alias("key"), "class").join(label, "key").select("root", "class").distinct()
        .groupBy("root").agg(F.count("*").alias("q")).filter(F.col("q") >= MIN_QUESTIONS)
    )
    return counted.join(label, "key").join(recurring.select("root"), "root").select("opening")


def cut_words(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``word``: words that are the beginning of one ``CUT_RATIO`` times as frequent, in how many answers they stand.

    A ratio of counts, so it means the same in a small table and a large one. Beginnings meet their words by an
    equality join of aggregated counts; nothing is broadcast.
    """
    words = answers.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(answer), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    heads = counts.filter("length(word) > 2").select(F.explode(F.expr("transform(sequence(2, length(word) - 1), i -> substr(word, 1, i))")).alias("word"), F.col("n").alias("m"))
    longest = heads.groupBy("word").agg(F.max("m").alias("m"))
    return counts.join(longest, "word").filter(F.col("m") >= CUT_RATIO * F.col("n")).select("word")


def defects(results: DataFrame) -> DataFrame:
    """``run_id, id, defect`` of each unfit reply, one row each.

    Null keys are kept as they are; a null question has no language and cannot be copied; a null ``answerable`` counts
    as unanswerable, so it makes no refusal. Repeated rows count once. Needs the columns run_id, id, question, answer,
    answerable; others are not read. ``answerable`` only says which refusals are defects.
    """
    rows = results.select("run_id", "id", "question", "answer", "answerable").distinct()
    last = F.lower(F.regexp_extract("answer", r"([\p{L}]+)[^\p{L}]*$", 1))
    rows = cut_lineage(rows.withColumn("word", last))
    rows = rows.join(cut_words(rows).withColumn("cut", F.lit(True)), "word", "left").select("run_id", "id", "question", "answer", "answerable", F.coalesce("cut", F.lit(False)).alias("cut"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for q, a, cut in zip(batch["question"], batch["answer"], batch["cut"]):
                kind, said = None, []
                if is_empty(a):
                    kind = "empty"
                elif is_copy(q, a):
                    kind = "copy"
                elif is_truncated(a, cut):
                    kind = "truncated"
                else:
                    kind = "language" if is_foreign(q, a) else None
                    said = openings(q, a) if says_nothing(q, a) else []
                out.append((kind, said))
            yield pd.DataFrame(
                {"run_id": batch["run_id"], "id": batch["id"], "question": batch["question"], "answerable": batch["answerable"],
                 "defect": [k for k, _ in out], "openings": [o for _, o in out]}
            )

    kinds = dict(results.dtypes)
    seen = cut_lineage(
        rows.mapInPandas(look, f"run_id {kinds['run_id']}, id {kinds['id']}, question string, answerable boolean, defect string, openings array<array<string>>")
    )
    said = seen.select("run_id", "id", "question", F.explode("openings").alias("opening"))
    templates = template_openings(said).withColumn("refuses", F.lit(True))
    refused = said.join(templates, "opening").select("run_id", "id", "refuses").distinct()
    judged = seen.join(refused, ["run_id", "id"], "left")
    label = F.when(F.col("refuses"), F.when(F.col("answerable"), "refusal")).otherwise(F.col("defect"))
    return judged.select("run_id", "id", label.alias("defect")).filter(F.col("defect").isNotNull()).dropDuplicates(["run_id", "id"])

"""Same or almost the same questions across splits: a weighted cosine join over inverted lists, then an exact check.

Questions are reduced to terms, misspelt terms are set right from the corpus' own vocabulary, and rows that reduce to
the same terms become one class, so copies are never compared. Between classes of different splits, lists are kept only
for the rarest terms of each vector (residual-norm prefix), postings that no partner can lift over the threshold are
dropped (maximum-weight bound), dot products are exact, and each surviving pair is checked term by term.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

THRESHOLD = 0.6
#: A word this much rarer than one at most two slips away is a misspelling of it.
SLIP_RATIO = 15

# Letters of other alphabets that look like Latin ones.
_LOOKALIKES = dict(zip("аеорсухкмтвнёіјѕԁһαενορτυχικ", "aeopcyxkmtbheijsdhaevoptuxik"))
_SKELETON = str.maketrans(_LOOKALIKES)
# Polite or framing phrases that ask nothing.
FRAMES = (
    r"thank you(?: very much)?(?: in advance)?|thanks(?: in advance)?|many thanks|please answer briefly|please tell me|could you tell me|"
    r"please|hello|hi|good (?:morning|day)|quick question|i would like to know|i wonder|according to the regulation|under the current text|"
    r"\(?\s*see the regulation\s*\)?|"
    r"vielen dank(?: im voraus)?|danke(?: im voraus)?|bitte(?: sagen sie mir)?|guten tag|hallo|eine frage|kurze frage|nach der regelung|gemäß der regelung|laut vorschrift|"
    r"заранее спасибо|спасибо(?: заранее)?|подскажите(?:,? пожалуйста)?|скажите(?:,? пожалуйста)?|пожалуйста|здравствуйте|добрый день|вопрос(?=\s*:)|"
    r"ответьте кратко(?:,? пожалуйста)?|будьте добры|antworten sie(?: bitte)? kurz|so kurz wie möglich|так(?=,)|согласно правилам|в правилам|по правилам|"
    r"请问|谢谢|您好|你好|麻烦问一下|请告诉我|根据规定|按照规定|请简要回答"
)
# Words that shape a question and carry none of its content.
SHAPE = (
    "the a an of to in on at by for with from is are was were be been being has have had do does did shall must may can will should would "
    "it its that this these those which what who whom whose when where how why not like than as and or if under any each there "
    "der die das den dem des ein eine einen einem einer von zu im in am an auf mit nach bei und oder ist sind wird werden muss darf soll kann "
    "haben hat welchen welche welcher welches was wer wo wie wann warum "
    "в на у с по к из за до от о и или а не ли же то это что как так где когда если при для какой какая какое какова каково каковы какие кто почему "
    "быть был была было"
)
# Ways to say the least and the most, and other words that replace one another in questions.
EVEN = {
    "minimum": "least smallest lowest minimal min mindest minimale minimaler kleinste kleinster geringste минимальная минимальный минимальное "
    "наименьшая наименьший наименьшее мин минимум минимальной наименьшей",
    "maximum": "greatest largest biggest highest maximal max most höchst maximale größte größter höchste максимальная максимальный максимальное "
    "наибольшая наибольший наибольшее макс максимум максимальной наибольшей",
    "need": "require requires required needed needs necessary",
    "without": "lost lacks lacking",
    "mean": "means meant meaning",
    "differ": "differently different differs",
    "hold": "held holds",
    "carry": "carrying carries carried",
}
EXTREMES = ("minimum", "maximum")
# Words that turn a question round. The first group must be on both sides or on none; of the others two
# questions differ where one has only the words of one group and the other only those of its opposite.
# To be treated differently is not to be treated alike. Characters of Chinese negation stand in the extremes, too.
NEGATIONS = (
    "not no never cannot different differently differs differ unlike nicht kein keine keinen keiner nie anders verschieden "
    "не нет никогда нельзя иначе отличается"
)
OPPOSITES = (
    ("may can might darf dürfen kann können можно может могут", "must shall muss müssen soll sollen должен должна должно должны обязан"),
    ("from von aus из от с", "to zu nach в на до"),
    ("under below beneath unter ниже под", "over above über выше над"),
    ("before vor bevor до", "after nach nachdem после"),
)

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_THOUSANDS = re.compile(r"(?<=\d)[,'’\s   ](?=\d{3}(?!\d))")
_CLASS = re.compile(r"\b(class|klasse|classe|kлacca|клacc\w*|kлacc\w*)\s+(i{1,3}|iv|v|[a-d]|\d)\b")
_CLASS_CJK = re.compile(r"(i{1,3}|iv|v|[a-d]|[一二三四])\s*级")
_WORD = re.compile(r"class:\w+|\d+(?:\.\d+)*|[぀-ヿ㐀-鿿฀-๿]|[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_CJK_SHAPE = frozenset("的了在上中由后前吗呢是有时得于多少为与和须应何哪些什么并请")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text).lower()
    return _INVISIBLE.sub("", text)


def flat_text(text: str) -> str:
    """A text in lower case, compatibility forms and letters by their shape, as terms are made from it."""
    return _plain(text).translate(_SKELETON)


_FRAME = re.compile(rf"(?<!\w)(?:{FRAMES})(?!\w)|(?:请问|谢谢|您好|你好|麻烦问一下|请告诉我|请简要回答)")
_FRAME_SKELETON = re.compile(_FRAME.pattern.translate(_SKELETON))
_CLASS_NAMES = ("class", "klasse", "classe", "kлacca", "kлacc", "kлacce")
_CLASS_LIKE = re.compile(r"\b([^\W\d_]{4,8})\s+(i{1,3}|iv|v|[a-d])\b")
_SHAPE_WORDS = frozenset(w.translate(_SKELETON) for w in SHAPE.split())
_NEGATION_WORDS = frozenset(w.translate(_SKELETON) for w in NEGATIONS.split())
_OPPOSITE_WORDS = tuple(tuple(frozenset(w.translate(_SKELETON) for w in side.split()) for side in pair) for pair in OPPOSITES)
_EVEN_WORDS = {w.translate(_SKELETON): k for k, v in EVEN.items() for w in (*v.split(), k)}


def without_frames(text: str) -> str:
    """A text in plain lower case without the phrases that only frame a question."""
    return _FRAME.sub(" ", re.sub(r"\s+", " ", _plain(text)))


def _class_like(m: re.Match) -> str:
    """A class word with a slip before a class letter is a class, too."""
    near = m[1][0] in "ck" and any(_within(m[1], name, 1 if len(name) < 6 else 2) for name in _CLASS_NAMES)
    return f" class:{m[2]} " if near else m[0]


def question_terms(text: str | None) -> list[str]:
    """Terms of a question: figures in one writing, classes with their letter, words by the shape of their letters,
    single characters of scripts without blanks. Empty for a null or wordless text."""
    return [w for w in all_terms(text) if w not in _SHAPE_WORDS]


def all_terms(text: str | None) -> list[str]:
    """The terms of a question together with the words that only shape it."""
    if not text:
        return []
    text = re.sub(r"\s+", " ", _plain(text)).translate(_SKELETON)
    text = _FRAME_SKELETON.sub(" ", text)
    text = _THOUSANDS.sub("", text)
    text = re.sub(r"(?<=\d),(?=\d)", ".", text)
    text = _CLASS.sub(lambda m: f" class:{m[2]} ", text)
    text = _CLASS_LIKE.sub(_class_like, text)
    text = _CLASS_CJK.sub(lambda m: f" class:{m[1]} ", text)
    terms = _WORD.findall(text)
    if any(map(_CJK.match, terms)):
        joined = text
        if re.search("不得小于|不少于|至少|最小|不低于", joined):
            terms.append("minimum")
        if re.search("不得大于|不得超过|至多|最大|不高于", joined):
            terms.append("maximum")
    return [w for w in terms if w not in _CJK_SHAPE]


def evened(terms: list[str]) -> list[str]:
    """Terms with the words that replace one another made one, without the words that shape a question."""
    return [_EVEN_WORDS.get(w, w) for w in terms if w not in _SHAPE_WORDS]


def _within(a: str, b: str, most: int) -> bool:
    """Whether two words are at most ``most`` slips (insert, drop, change, swap of neighbours) apart."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return False
    return row[-1] <= most


def _drops(word: str, depth: int) -> set[str]:
    out, front = {word}, {word}
    for _ in range(depth):
        front = {w[:i] + w[i + 1 :] for w in front for i in range(len(w))}
        out |= front
    return out


def _slip_depth(*words: str) -> int:
    return 1 if max(map(len, words)) < 5 else 2


def _may_slip(word: str) -> bool:
    return len(word) >= 3 and word.isalpha() and not _CJK.match(word)


def slips_of(words: DataFrame) -> DataFrame:
    """``t, v``: rare words ``t`` with the word ``v`` that they are a slip or two away from, of ``t, n`` with counts.

    Where ``words`` says so (``named``), words that are written as names are slips of nothing, as most rare words are names.
    ``v`` is ``SLIP_RATIO`` times as frequent at least, so no share of the table's size decides; words that shape a
    question or replace others count as frequent. Both sides meet on what is left of them when a letter or two are
    dropped, by an equality join, so no vocabulary is broadcast; each pair is then measured exactly.
    """
    always = words.sparkSession.createDataFrame([(w, SLIP_RATIO) for w in sorted({*_SHAPE_WORDS, *_EVEN_WORDS})], "t string, n long")
    frequent = words.select("t", "n").filter(F.col("n") >= SLIP_RATIO).unionByName(always).groupBy("t").agg(F.max("n").alias("n"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, t, n) for t, n in zip(batch["t"], batch["n"]) if _may_slip(t) for d in _drops(t, _slip_depth(t + "x"))]
            yield pd.DataFrame(rows, columns=["d", "t", "n"])

    plain = words.filter("NOT named") if "named" in words.columns else words
    left = plain.select("t", "n").join(F.broadcast(always.select("t")), "t", "left_anti").mapInPandas(keys, "d string, t string, n long").select(F.xxhash64("d").alias("d"), "t", "n")
    right = frequent.filter("length(t) >= 4").mapInPandas(keys, "d string, t string, n long").select(F.xxhash64("d").alias("d"), F.col("t").alias("v"), F.col("n").alias("m"))
    pairs = left.join(right, "d").filter(F.col("m") >= SLIP_RATIO * F.col("n")).select("t", "v", "m").distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, v, m in zip(batch["t"], batch["v"], batch["m"]):
                # slips leave the first letter, or swap it; they double, drop and swap letters more than they bring in new ones
                if (t[0] == v[0] or t[:2] == v[1::-1]) and _within(t, v, _slip_depth(t, v)):
                    apart = sum(((Counter(t) - Counter(v)) + (Counter(v) - Counter(t))).values())
                    # only a slip of a word that shapes the question or replaces others is taken for it, not a name near it
                    if v not in _SHAPE_WORDS and v not in _EVEN_WORDS or _slip(t, v):
                        out.append((t, v, apart, int(not _within(t, v, 1)), -m))
            yield pd.DataFrame(out, columns=["t", "v", "apart", "far", "m"])

    near = pairs.mapInPandas(measure, "t string, v string, apart int, far int, m long")
    return near.groupBy("t").agg(F.min(F.struct("apart", "far", "m", "v")).alias("x")).select("t", "x.v")


def turns(text: str | None) -> list[str]:
    """The marks that turn a question round: ``neg``, and of each pair of opposites the group that it has alone."""
    plain = re.sub(r"\s+", " ", _plain(text or "")).translate(_SKELETON)
    words = {*_WORD.findall(_FRAME_SKELETON.sub(" ", plain))}
    out = ["neg"] if not words.isdisjoint(_NEGATION_WORDS) else []
    for k, (one, other) in enumerate(_OPPOSITE_WORDS):
        a, b = not words.isdisjoint(one), not words.isdisjoint(other)
        if a != b:
            out.append(f"{k}{'+' if a else '-'}")
    return out


def turned(a: list[str], b: list[str]) -> bool:
    """Whether one question says the opposite of the other by its turns."""
    left, right = set(a), set(b)
    return ("neg" in left) != ("neg" in right) or any(f"{k}+" in x and f"{k}-" in y for k in range(len(OPPOSITES)) for x, y in ((left, right), (right, left)))


def written_names(text: str | None) -> list[str]:
    """Terms written as names: a capital inside a sentence, in a text that is not all capitals."""
    raw = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text or ""))
    words = [(m.group(), m.start()) for m in re.finditer(r"[^\W\d_]+", raw)]
    if not words or sum(w[0].isupper() for w, _ in words) > 0.6 * len(words):
        return []
    inside = lambda at: re.search(r"[.!?:–—\"“„«(]\s*$|^\s*$", raw[:at]) is None
    return sorted({w.lower().translate(_SKELETON) for w, at in words if w[0].isupper() and w[1:].islower() and inside(at)})


def _close(w: str, v: str) -> bool:
    """Whether two writings may be one name: one slip, two in a long word."""
    return _within(w, v, 1 if min(len(w), len(v)) < 9 else 2)


def _slip(w: str, v: str) -> bool:
    """Whether a word two slips from a known one is a slip of it rather than a name: slips bring in no new letters."""
    return _close(w, v) or set(w) <= set(v)


def _same_word(x: tuple[str, str], y: tuple[str, str]) -> bool:
    return x[1] == y[1] and (_close(x[0], y[0]) or set(x[0] + y[0]) <= set(x[1]))


def agreed_terms(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The terms of two questions from their ``(written, right)`` terms, for the exact check: a word that was set right
    counts as its partner's only where both are close as they were written or hold no letter that the right word lacks.
    One without a partner counts as set right if it is a slip in that sense, and as it was written otherwise."""
    left, right = list(a), list(b)
    out_a, out_b = [], []
    for same in (lambda x, y: x[0] == y[0], _same_word):
        for x in list(left):
            y = next((y for y in right if same(x, y)), None)
            if y is not None:
                left.remove(x)
                right.remove(y)
                out_a.append(x[1])
                out_b.append(x[1])
    # the same right word in two writings that are not close: two names
    met = {r for _, r in left} & {r for _, r in right}
    alone = lambda x: x[1] if _slip(*x) and x[1] not in met else x[0]
    return out_a + [alone(x) for x in left], out_b + [alone(y) for y in right]


def same_question(a: list[str], b: list[str], names: frozenset[str] | set[str] = frozenset()) -> bool:
    """The exact check of two lists of terms: figures, classes and extremes alike, names alike but for one slip, and no
    other word of one exchanged for another. ``names`` are the terms that either question writes as names; a word that
    is none is never forgiven for another, nor may a name stand on one side only."""
    left, right = Counter(a), Counter(b)
    over, under = list((left - right).elements()), list((right - left).elements())
    for w in list(over):
        for v in under:
            caseless = w.upper() == w
            slip = (w in names or v in names or caseless) and _within(w, v, 1 if len(w) < 9 else 2)
            if len(w) > 3 and w.isalpha() and v.isalpha() and (slip or _stem(w, v)):
                over.remove(w)
                under.remove(v)
                break
    hard = lambda w: w[0].isdigit() or w.startswith("class:") or w in EXTREMES
    if any(map(hard, over)) or any(map(hard, under)):
        # a figure or extreme said twice on one side only is still the same one
        if any(hard(w) and w not in right for w in over) or any(hard(w) and w not in left for w in under):
            return False
    over, under = [w for w in over if not hard(w)], [w for w in under if not hard(w)]
    if over and under:
        return False
    rest = over or under
    return not rest or len(rest) <= 2 and not any(w in names or _CJK.match(w) for w in rest)


def _stem(w: str, v: str) -> bool:
    n = min(len(w), len(v))
    return n >= 4 and w[: n - 1] == v[: n - 1] and abs(len(w) - len(v)) <= 2


def _features(terms: list[str]) -> list[str]:
    """Vector features: words, figures and classes; pairs of neighbours where terms are single characters."""
    out = [t for t in terms if not _CJK.match(t)]
    chars = [t for t in terms if _CJK.match(t)]
    return out + [x + y for x, y in zip(chars, chars[1:])] + (chars if len(chars) == 1 else [])


def question_classes(golden: DataFrame, question: str = "question", item: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, classes, variants)``: id, split, source, class and variant of each item; class and terms of each
    class, as set right; variant, class, terms as written and as set right, names and turns of each writing in a class."""
    items = golden.select(F.col(item).alias("id"), "split", "source", F.col(question).alias("q")).dropDuplicates(["id"])
    fields = "id string, split string, source string, terms array<string>, names array<string>, turns array<string>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read_all = lambda f: [f(q) for q in batch["q"]]
            yield batch[["id", "split", "source"]].assign(terms=read_all(all_terms), names=read_all(written_names), turns=read_all(turns))

    raw = cut_lineage(items.mapInPandas(read, fields).filter("size(terms) > 0"))
    spread = raw.select(F.explode(F.array_distinct("terms")).alias("t"), "names").groupBy("t").agg(F.count("*").alias("n"), F.max(F.array_contains("names", F.col("t"))).alias("named"))
    spread = cut_lineage(spread)
    # each rare word is looked up once, with the true number of items that use it
    slips = slips_of(spread)
    slipped = raw.select("id", F.explode(F.array_distinct("terms")).alias("t")).join(slips, "t").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("slips"))

    def even(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            written, rights = [], []
            for ts, fix in zip(batch["terms"], batch["slips"]):
                fix = {} if fix is None else dict(fix)
                pairs = [(_EVEN_WORDS.get(v, _EVEN_WORDS.get(t, t)), _EVEN_WORDS.get(v, v)) for t in ts for v in [fix.get(t, t)] if v not in _SHAPE_WORDS]
                written.append([t for t, _ in pairs])
                rights.append([v for _, v in pairs])
            yield batch[["id", "split", "source", "names", "turns"]].assign(written=written, terms=rights)

    spelt = raw.join(slipped, "id", "left").mapInPandas(even, fields + ", written array<string>").filter("size(terms) > 0")
    spelt = spelt.withColumn("class", F.xxhash64(F.to_json(F.array_sort("terms")))).withColumn("variant", F.xxhash64(F.to_json(F.array_sort(F.arrays_zip("written", "terms"))), "names", "turns"))
    spelt = cut_lineage(spelt)
    held = F.coalesce(F.col("split") == "test", F.lit(False))
    sides = [F.max(held.cast("int")).alias("held"), F.max((~held).cast("int")).alias("tuned")]
    variants = spelt.groupBy("variant").agg(F.first("class").alias("class"), F.first(F.struct("written", "terms", "names", "turns")).alias("x"), *sides)
    variants = cut_lineage(variants.select("variant", "class", "x.*", "held", "tuned"))
    classes = variants.groupBy("class").agg(F.first("terms").alias("terms"), F.max("held").alias("held"), F.max("tuned").alias("tuned"))
    return spelt.select("id", "split", "source", "class", "variant"), cut_lineage(classes), variants


def class_vectors(classes: DataFrame) -> DataFrame:
    """``class, held, tuned, vector``: features by falling weight with their weight and the norm of the vector from
    there on; unit vectors of inverse document frequencies."""
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(c, f) for c, ts in zip(batch["class"], batch["terms"]) for f in dict.fromkeys(_features(list(ts)))], columns=["class", "t"])

    total, kind = max(classes.count(), 1), dict(classes.dtypes)["class"]
    flat = classes.select("class", "terms").mapInPandas(features, f"class {kind}, t string")
    idf = flat.groupBy("t").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(total) / F.col("df")))
    rated = flat.join(idf, "t")
    vectors = rated.groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct(F.col("idf"), "t")), asc=False).alias("v"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")
    )
    # the norm that is left from each place on
    tail = F.expr(
        "reverse(aggregate(reverse(v), named_struct('s', 0D, 'out', cast(array() as array<struct<t:string,w:double,left:double>>)), "
        "(a, x) -> named_struct('s', a.s + pow(x.idf / norm, 2), 'out', concat(a.out, array(named_struct('t', x.t, 'w', x.idf / norm, "
        "'left', sqrt(a.s + pow(x.idf / norm, 2)))))), a -> a.out))"
    )
    return vectors.select("class", tail.alias("vector")).join(classes.select("class", "held", "tuned"), "class")


def cosine_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``class_a, class_b, cosine``: all pairs of a held-out and a tuned-on class at or over the threshold.

    Two vectors whose rarest common feature leaves norms a and b have a dot product of at most a * b; a posting goes
    to a list only if its norm times the largest norm of the other side's list reaches the threshold.
    """
    posting = vectors.select("class", "held", "tuned", F.explode("vector").alias("x")).filter(F.col("x.left") >= threshold)
    posting = posting.select("class", "held", "tuned", "x.t", "x.left")
    most = posting.groupBy("t").agg(F.max(F.when(F.col("held") == 1, F.col("left"))).alias("m_held"), F.max(F.when(F.col("tuned") == 1, F.col("left"))).alias("m_tuned"))
    able = cut_lineage(posting.join(most.filter((F.col("m_held") * F.col("m_tuned")) >= threshold), "t"))
    held = able.filter((F.col("held") == 1) & (F.col("left") * F.col("m_tuned") >= threshold)).select("t", F.col("class").alias("class_a"), F.col("left").alias("left_a"))
    tuned = able.filter((F.col("tuned") == 1) & (F.col("left") * F.col("m_held") >= threshold)).select("t", F.col("class").alias("class_b"), F.col("left").alias("left_b"))
    met = held.join(tuned, "t").filter((F.col("left_a") * F.col("left_b") >= threshold) & (F.col("class_a") != F.col("class_b")))
    pairs = met.select("class_a", "class_b").distinct()
    side = lambda s: vectors.select(F.col("class").alias(f"class_{s}"), F.map_from_entries(F.transform("vector", lambda x: F.struct(x["t"], x["w"]))).alias(f"v_{s}"))
    dots = pairs.join(side("a"), "class_a").join(side("b"), "class_b")
    dot = F.expr("aggregate(map_entries(v_a), 0D, (s, e) -> s + e.value * coalesce(try_element_at(v_b, e.key), 0D))")
    return dots.select("class_a", "class_b", dot.alias("cosine")).filter(F.col("cosine") >= threshold - 1e-9)


def cross_split_pairs(golden: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``held_id, tuned_id, cosine`` of items of split test and items of the other split that ask the same question.

    Null and wordless questions ask nothing and pair with nothing; repeated rows count once; an item without split
    counts as tuned on. All pairs of ids are given; copies were compared once, as classes.
    """
    members, classes, variants = question_classes(golden)
    vectors = cut_lineage(class_vectors(classes))
    near = cosine_pairs(vectors, threshold)
    itself = classes.filter("held = 1 AND tuned = 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(1.0).alias("cosine"))
    fields = ("variant", "written", "terms", "names", "turns")
    side = lambda s, on: variants.filter(f"{on} = 1").select(F.col("class").alias(f"class_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in fields])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for wa, ta, na, sa, wb, tb, nb, sb in zip(*[batch[f"{c}_{s}"] for s in "ab" for c in fields[1:]]):
                pairs = agreed_terms(list(zip(wa, ta)), list(zip(wb, tb)))
                kept.append(not turned(sa, sb) and same_question(*pairs, {*na, *nb}))
            yield batch.loc[kept, ["variant_a", "variant_b", "cosine"]]

    met = near.unionByName(itself).join(side("a", "held"), "class_a").join(side("b", "tuned"), "class_b")
    pairs = met.mapInPandas(check, "variant_a long, variant_b long, cosine double")
    held = members.filter("split = 'test'").select(F.col("variant").alias("variant_a"), F.col("id").alias("held_id"), F.col("source").alias("held_source"))
    tuned = members.filter("split <> 'test' OR split IS NULL").select(F.col("variant").alias("variant_b"), F.col("id").alias("tuned_id"), F.col("source").alias("tuned_source"))
    return pairs.join(held, "variant_a").join(tuned, "variant_b").select("held_id", "tuned_id", "held_source", "tuned_source", "cosine")


def found_pairs(golden: DataFrame) -> DataFrame:
    """``id_a, id_b``: the pairs with the smaller id first."""
    return cross_split_pairs(golden).select(F.least("held_id", "tuned_id").alias("id_a"), F.greatest("held_id", "tuned_id").alias("id_b")).distinct()


def overlap_report(golden: DataFrame) -> DataFrame:
    """``split, source, items, overlapping, pairs``: per split and source, how many items have a partner in the other."""
    pairs = cut_lineage(cross_split_pairs(golden))
    ends = pairs.select(F.col("held_id").alias("id")).unionAll(pairs.select(F.col("tuned_id").alias("id"))).groupBy("id").agg(F.count("*").alias("pairs"))
    items = golden.select("id", "split", "source").dropDuplicates(["id"])
    return (
        items.join(ends, "id", "left").groupBy("split", "source")
        .agg(F.count("*").alias("items"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )

"""Sentence boundaries across languages and scripts, as SQL expressions only.

Full stops that do not end a sentence are masked by a private-use character of the same length, then the
terminators that are left get a boundary mark; offsets of the masked copy are those of the text, so the
sentences are cut from the text itself and nothing has to be mapped back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, CUT, OPEN, CLOSE = "", "", "", ""

# Abbreviations whose full stop never ends a sentence.
NEVER = (
    r"i\.e e\.g cf vs viz approx Mr Mrs Ms Dr Prof St resp incl excl "
    r"z\.\s?B d\.\s?h u\.\s?a z\.\s?T o\.\s?ä vgl bzw ca evtl ggf sog Hr "
    r"p\.\s?ex c\.-à-d MM Mme "
    r"т\.\s?е т\.\s?к напр ср"
).split(" ")
# Abbreviations whose full stop does not end a sentence before a figure or a named item.
BEFORE_FIGURE = (
    "No Nos Ver ver vers Fig Figs para paras tab Tab Tabs rev Rev Art Arts art arts Sec sec Ch ch Vol vol pp p Annex Ann Reg "
    "Nr Nrn Abb Abs Anh Kap Ziff S fig chap al "
    "п пп рис табл гл ст стр прил разд "
    "Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec"
).split(" ")
# Months, before which a number with a full stop is a day.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Words before a German ordinal.
ORDINAL_LEADS = "am vom zum bis ab der dem den des im".split()
# Endings of company names and titles behind names; they may close a sentence, too.
NAME_ENDS = "Inc Ltd Co Corp Bros Jr Sr Ph\\.\\s?D GmbH Cie".split()
# Words that begin a sentence rather than go on with a name.
STARTERS = (
    "The A An It He She They We I You In On At If When This That These Those But And As For No Not All Each Every Any "
    "Where After Before Its His Her Their There Here What Who How Is Are Was Were Does Do Der Die Das Ein Eine Es Er Sie Wir Im Wenn Le La Les Un Une Il Elle En"
).split()
# First halves of two-part abbreviations.
FIRST_HALF = r"z(?=\.\s?[BT]\.) d(?=\.\s?h\.) u(?=\.\s?a\.) o(?=\.\s?ä\.) p(?=\.\s?ex\.) т(?=\.\s?[едпк]\.) и\sт(?=\.\s?[дп]\.)".split(" ")
# Words after which a single capital is a class or grade, not an initial.
CLASS_WORDS = "Class Classes Grade Type Klasse Typ classe type класса класс классе тип типа".split(" ")

_CLOSER = r"[\"'’”»\)\]）】」』》〉]"
_TAIL = rf"(?:(?:[   ]?[»])|{_CLOSER})"
_STOP = r"[.．。!！?？।॥؟۔…‽]"
_CASELESS = r"[\p{Lo}&&[^ªº]]"


def _mask_pattern() -> str:
    """A terminator that does not end its sentence: the stop is matched first, so the look-behinds run only at stops."""
    never = "|".join(NEVER)
    figure = "|".join(BEFORE_FIGURE)
    classes = "|".join(CLASS_WORDS)
    word = r"(?<![\p{L}\p{N}])"
    goes_on = rf"(?=\s{{1,3}}[\p{{Lu}}&])(?!\s{{1,3}}(?:{'|'.join(STARTERS)})\b)"
    point = "|".join(
        [
            r"(?<=\d\.)(?=\d)",
            r"(?<=^[\s\d.]{1,40}\.)(?=\s)",
            r"(?=\.)",
            r"(?=\s?[,;:])",
            # its sentence visibly goes on in lower case
            rf"(?={_TAIL}{{0,3}}\s{{0,3}}\p{{Ll}})",
            rf"(?<={word}(?:{never})\.)",
            rf"(?<={word}(?:{figure})\.)(?=\s{{0,3}}(?:[\d№#(]|[IVX]+\b))",
            rf"(?<={word}[zduopтДв]\.)(?=\s?(?:B|T|h|a|ä|ex|е|д|п|к)\.)",
            # initials before a name; a unit after a figure or a class letter is none
            rf"(?<={word}\p{{Lu}}\.)(?=\p{{Lu}}(?:\.|[^\p{{L}}]))",
            rf"(?<=\p{{Lu}}\.\p{{Lu}}\.){goes_on}",
            rf"(?<={word}(?:{'|'.join(NAME_ENDS)})\.){goes_on}",
            # a day before its month, an ordinal before its noun
            rf"(?<=\d\.)(?=\s{{1,3}}(?:{'|'.join(MONTHS)})\b)",
            rf"(?<={word}(?:{'|'.join(ORDINAL_LEADS)})\s\d{{1,2}}\.)(?=\s\p{{Lu}})",
            rf"(?<!\p{{Lu}}\.\p{{Lu}}\.)(?<={word}\p{{Lu}}\.)(?=\s\p{{Lu}}(?:\.|\p{{Ll}}))(?<!(?:\d|{classes}|and|or|und|oder|et|ou|и|или)\s{{1,2}}\p{{Lu}}\.)",
        ]
    )
    # bare ? and ! do end a sentence before lower case; quoted ones do not, nor do they before a letter without case
    quoted = rf"(?={_TAIL}{{1,3}}\s{{0,3}}(?:[\p{{Ll}},;:，、；：]|{_CASELESS}))"
    # one character class for all of them, so that other characters cost one test
    return rf"{_STOP}(?:(?<=\.)(?:{point})|(?<=…)(?={_TAIL}{{0,3}}\s{{0,3}}[\p{{Ll}},;:])|{quoted})"


# Stops inside web and mail addresses: some of the address follows them.
_ADDRESS = (
    r"[.?!](?:(?<=(?i:https?://|ftp://|www\.)[^\s\p{Z}]{0,500})(?=[^\s\p{Z}]{0,500}?[\p{L}\p{N}/])"
    r"|(?<=@[\w.-]{1,255})(?=\w)|(?=[\w.+-]{1,64}@\w))"
)


def masked(text: Column) -> Column:
    """``text`` with non-final stops masked and quotation marks told apart; same length as ``text``."""
    clean = F.translate(text, MASK + CUT + OPEN + CLOSE, "￼" * 4)
    paired = F.regexp_replace(clean, r'"([^"]*)"', OPEN + "$1" + CLOSE)
    paired = F.regexp_replace(paired, "„([^„“”]*)[“”]", OPEN + "$1" + CLOSE)
    paired = F.when(text.rlike(r"(?i)://|www\.|@"), F.regexp_replace(paired, _ADDRESS, MASK)).otherwise(paired)
    return F.regexp_replace(paired, _mask_pattern(), MASK)


def marked(text: Column) -> Column:
    """The masked text with a boundary mark after each sentence."""
    ends = F.regexp_replace(masked(text), rf"({_STOP}+(?:[\s]{{0,1}}{_STOP})*{_TAIL}*)", "$1" + CUT)
    # Thai puts a space, not a stop, between sentences
    thai = F.regexp_replace(ends, r"(?<=[฀-๿])(\s+)(?=[฀-๿\p{Lu}])", CUT + "$1")
    return F.when(text.rlike("[฀-๿]"), thai).otherwise(ends)


# Unicode white space, as an SQL string.
_WHITE = "".join(f"\\u{c:04X}" for c in (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def split_sentences(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per sentence: the columns ``keep``, ``sentence_no`` (from 1), ``start_char``, ``end_char``, ``sentence``.

    ``end_char`` counts Unicode characters from the start of the text through the sentence's last one.
    Null, empty and blank texts give no row; repeated rows give repeated sentences; other columns whose
    names clash with the result's are replaced by them. Row-local, no shuffle, whole texts.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("sentence_no", "start_char", "end_char", "sentence")]
    parts = F.split(marked(F.col(text)), CUT)
    rows = (
        df.filter(F.col(text).isNotNull())
        .select(*keep, F.col(text).alias("__text"), parts.alias("__parts"))
        .select(
            *keep,
            "__text",
            F.expr(
                # trailing and leading blanks are trimmed by character, which is far cheaper than a pattern on each part
                f"aggregate(__parts, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int>>)), (a, p) -> "
                f"named_struct('at', a.at + length(p), 'out', if(length(trim(LEADING '{_WHITE}' FROM p)) = 0, a.out, "
                f"concat(a.out, array(named_struct('s', a.at + length(p) - length(trim(LEADING '{_WHITE}' FROM p)), "
                f"'e', a.at + length(trim(TRAILING '{_WHITE}' FROM p))))))), a -> a.out)"
            ).alias("__spans"),
        )
    )
    # the outer form, as the plain one would have the whole expression evaluated once more in a filter below it
    found = rows.select(*keep, "__text", F.posexplode_outer("__spans").alias("__i", "__span")).filter("__span IS NOT NULL")
    return found.select(
        *keep,
        (F.col("__i") + 1).alias("sentence_no"),
        F.col("__span.s").alias("start_char"),
        F.col("__span.e").alias("end_char"),
        F.expr("substring(__text, __span.s + 1, __span.e - __span.s)").alias("sentence"),
    )


def body_sentence_ends(blocks: DataFrame) -> DataFrame:
    """``id, end_char`` of each sentence of the body text blocks; a block delivered twice counts once."""
    body = blocks.filter("role = 'body' AND block_type = 'text'")
    return split_sentences(body, keep=["id"]).select("id", "end_char").distinct()

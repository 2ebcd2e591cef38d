"""Text functions as column expressions: normal forms, numbering, hashes and ids, names and rendering."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns of the document family's conventions.
BLANKS = r"\s\x0B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE = f"[{BLANKS}]"
TOC = rf"\.{{4,}}{SPACE}*\p{{Nd}}+{SPACE}*$"
NUMBERING = rf"^{SPACE}*(\p{{Nd}}+(?:\.\p{{Nd}}+)*)\.{SPACE}+[^{BLANKS}]"
SCOPE = r"(?iU)^\s*(Annex\s+\d+[A-Z]?(?:\s*[-–—]\s*(?:Part|Appendix)(?:\s+\d+)?)*)"
PLACEHOLDER = r"(?i)^[(\[]?(reserved|deleted)[)\]]?\.?$"
DOC_ID = r"^[a-z0-9][a-z0-9._-]{0,99}$"
# The namespace of point ids, the same for ever.
POINT_NAMESPACE = "6f1d2a8e4c3b5e7f9a0b1c2d3e4f5a6b"
# What words are made of, inside a character class.
WORD_SIGNS = r"\p{L}\p{N}\p{M}_"
TEST_PERCENT = 30
VERDICT_SCORES = {"correct": 1.0, "partial": 0.5, "incorrect": 0.0}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """Blanks to one space, line breaks with the blanks around them to one space, no outer blanks."""
    one = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(one, rf"{SPACE}*\n{SPACE}*", " "))


def pattern_key(text: Column) -> Column:
    """What repeats of a running line share: lower case, figures as #, single spaces, at most 80 characters."""
    hashed = F.regexp_replace(F.lower(text), r"\p{Nd}+", "#")
    return F.substring(strip(F.regexp_replace(hashed, rf"{SPACE}+", " ")), 1, 80)


def slug(name: Column) -> Column:
    """Document id of a file stem; ``document`` where nothing usable is left."""
    bare = F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(bare, r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("document"))


def is_doc_id(value: Column) -> Column:
    return value.rlike(DOC_ID)


def is_toc(text: Column) -> Column:
    return text.rlike(TOC)


def section_number(text: Column) -> Column:
    """``7.6.1`` of ``7.6.1. Title``; null where the text is not numbered."""
    return F.nullif(F.regexp_extract(text, NUMBERING, 1), F.lit(""))


def number_path(number: Column) -> Column:
    """A section number as integers, which compare like the number."""
    return F.transform(F.split(number, r"\."), lambda x: x.cast("int"))


def scope_name(text: Column) -> Column:
    """``Annex 8 - Part 1`` of a scope heading in one writing; null for others."""
    found = F.nullif(F.regexp_extract(text, SCOPE, 1), F.lit(""))
    return F.regexp_replace(strip(found), r"(?U)\s*[-–—]\s*", " - ")


def scope_title(text: Column) -> Column:
    """What a scope heading says beside the scope."""
    return F.regexp_replace(F.regexp_replace(text, SCOPE, ""), r"^[ \-–—:]+|[ \-–—:]+$", "")


def is_label(rest: Column, most: int = 80) -> Column:
    """Whether what follows a number is a title rather than a sentence."""
    bare = F.regexp_replace(rest, r'^[ "“”]+|[ "“”]+$', "")
    return (
        (F.length(bare) > 0) & ~bare.rlike(PLACEHOLDER) & (F.length(bare) <= most) & ~bare.rlike(r"[.;:,]$") & ~bare.rlike(r"(?U)\b(and|or)$")
    )


def words(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_extract_all(text, F.lit(f"[^{BLANKS}]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Words of letters, figures and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_SIGNS}]+"), F.lit(0))


def short_label(text: Column, most: int = 8) -> Column:
    """The first words, with an ellipsis where more follow."""
    w = words(text)
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…"))).otherwise(F.array_join(w, " "))


def join_lines(lines: Column) -> Column:
    """Title fragments in one line; a hyphen at a break is kept and closed up where the next line is in lower case."""
    return F.aggregate(
        lines, F.lit(""), lambda a, b: F.when(a == "", b).when(a.endswith("-") & b.rlike(r"^\p{Ll}"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))
    )


def sentences(text: Column) -> Column:
    """Simple sentence units: after a full stop, semicolon or colon and blanks."""
    return F.split(text, r"(?U)(?<=[.;:])\s+")


def text_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def answer_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def point_id(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def split_percent(name: Column) -> Column:
    """The hash of an id as a number modulo 100."""
    h = F.sha2(name, 256)
    return F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(F.substr(h, i, F.lit(1)), 16, 10).cast("int")),
        F.lit(0), lambda a, d: (a * 16 + d) % 100,
    )


def golden_split(name: Column) -> Column:
    return F.when(split_percent(name) < TEST_PERCENT, "test").otherwise("dev")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which has no built-in."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def match_form(text: Column) -> Column:
    """Form in which quotations are compared: compatibility forms, plain quotes and dashes, single spaces, lower case."""
    plain = F.translate(nfkc(text), "“”‘’–—", "\"\"''--")
    return F.lower(strip(F.regexp_replace(plain, rf"{SPACE}+", " ")))


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))


def mentions_figure(text: Column, figure: Column) -> Column:
    """Whether a text names the figure itself, not one whose number goes on."""
    return F.expr("true") & F.call_function("rlike", text, F.concat(F.lit(r"(?i)\b\Q"), figure, F.lit(r"\E(?![0-9A-Za-z])")))


def covers(section: Column, gold: Column) -> Column:
    """Whether a section is the gold section or lies under it: 7.6.1.2 under 7.6.1, 7.6.10 not."""
    return (section == gold) | F.startswith(section, F.concat(gold, F.lit(".")))


def verdict_score(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, score in VERDICT_SCORES.items():
        out = F.when(verdict == name, score).otherwise(out)
    return out


def parse_gold(raw: Column) -> Column:
    """``Annex 3|7.6.1; Annex 4|p.82`` as references."""
    return F.transform(
        F.filter(F.transform(F.split(raw, ";"), F.trim), lambda x: x != ""),
        lambda x: F.struct(
            F.trim(F.get(F.split(x, r"\|"), F.lit(0))).alias("scope"),
            F.when(~F.coalesce(F.trim(F.get(F.split(x, r"\|"), F.lit(1))), F.lit("")).rlike(r"^p\.\d+$"), F.trim(F.get(F.split(x, r"\|"), F.lit(1)))).alias("section"),
            F.nullif(F.regexp_extract(x, r"\|\s*p\.(\d+)\s*$", 1), F.lit("")).cast("int").alias("page"),
        ),
    )


def common_prefix(paths: Column) -> Column:
    """The longest common beginning of an array of arrays."""
    def shared(a: Column, b: Column) -> Column:
        differs = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: (i > F.size(a)) | (i > F.size(b)) | ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
        return F.slice(a, F.lit(1), F.coalesce(F.get(differs, F.lit(0)) - 1, F.size(a)))

    return F.aggregate(F.slice(paths, F.lit(2), F.greatest(F.size(paths) - 1, F.lit(0))), F.get(paths, F.lit(0)), shared)


def chunk_header(doc_id: Column, path: Column, title_words: int = 8) -> Column:
    """``doc | Annex 3: short title > 7.6 Exits``."""
    head = F.get(path, F.lit(0))
    at = F.locate(": ", head)
    scope = F.when(at > 0, F.expr("1")).otherwise(F.expr("0"))
    name = F.when(scope == 1, F.substring_index(head, ": ", 1)).otherwise(head)
    title = F.when(at > 0, F.substr(head, at + 2, F.length(head)))
    shown = F.when(title.isNull() | (title == ""), name).otherwise(F.concat(name, F.lit(": "), short_label(title, title_words)))
    rest = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
    trail = F.array_join(F.concat(F.array(shown), rest), " > ")
    return F.when(F.size(path) > 0, F.concat(doc_id, F.lit(" | "), trail)).otherwise(doc_id)


def embed_text(header: Column, body: Column) -> Column:
    return F.concat(header, F.lit("\n\n"), body)


def unit_vector(vector: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

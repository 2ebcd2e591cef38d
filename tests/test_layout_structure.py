import functools
import math
import random
import re

import pytest

from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.operators import chunking, layout, structure


def block(i, text, page=1, y0=300.0, size=10.0, bold=False, role="body", level=None, scope="Regulation", number=None, crumbs=(), doc="d"):
    return (doc, i, f"{doc}:{i:05d}", text, page, (70.0, y0, 500.0, y0 + 12.0), size, bold, role, level, "text", number, scope, list(crumbs))


def blocks_of(spark, rows):
    return spark.createDataFrame(rows, schemas.BLOCK)


def test_furniture_depths(spark):
    topics = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows, i = [], 0
    for page in range(1, 11):
        for text, y in (("Regulation No. 107", 34.0), (f"Body about {topics[page - 1]}", 80.0), (str(page), 804.0)):
            rows.append(block(i, text, page, y))
            i += 1
    rows.append(block(i, "stamp", 3, 36.0))
    tagged = {r["id"]: r["tagged"] for r in layout.furniture(blocks_of(spark, rows)).collect()}
    assert tagged["d:00000"] == "header" and tagged["d:00001"] == "body" and tagged["d:00002"] == "footer"
    assert tagged[f"d:{i:05d}"] == "header", "what stands within the learned depth belongs to it"
    assert layout.body_font_size(blocks_of(spark, rows)).first()["body_size"] == 10.0


def test_footnotes_need_a_lone_short_rule(spark):
    pages = spark.createDataFrame(
        [("d", 1, 595.0, 842.0, [(747.0, 70.0, 144.0)]), ("d", 2, 595.0, 842.0, [(600.0, 70.0, 140.0), (600.0, 140.0, 210.0), (602.0, 210.0, 280.0), (200.0, 70.0, 144.0)])], schemas.PAGE
    )
    assert [(r["page_number"], r["separator_y"]) for r in layout.footnote_separators(pages).collect()] == [(1, 747.0)]
    rows = [block(0, "long body text " * 9, 1, 300.0), block(1, "1/ a note", 1, 750.0, 8.0), block(2, "small but high", 1, 200.0, 8.0)]
    found = {r["ordinal"] for r in layout.footnotes(blocks_of(spark, rows), pages).filter("is_footnote").collect()}
    assert found == {1}


def test_contents_and_noise(spark):
    rows = [block(0, "1. Scope ........ 3"), block(1, "x2"), block(2, "plain text")]
    assert [r["retagged"] for r in layout.contents_and_noise(blocks_of(spark, rows)).orderBy("ordinal").collect()] == ["toc", "noise", "body"]


def test_heading_styles(spark):
    rows = [block(i, "body paragraph " * 20) for i in range(30)]
    rows += [block(30, "a heading that is long enough to count", size=14.0, bold=True), block(31, "another heading long enough to be seen", size=12.0, bold=True), block(32, "bold at the size of the body, long enough", bold=True)]
    levels = {(r["size"], r["bold"]): r["level"] for r in layout.heading_styles(blocks_of(spark, rows)).collect()}
    assert levels == {(10.0, False): None, (14.0, True): 1, (12.0, True): 2, (10.0, True): 3}


def test_scopes_and_crumbs(spark):
    rows = [
        block(0, "Front words"), block(1, "7. Requirements", level=2), block(2, "7.6. Exits"), block(3, "7.6.1. Number of exits shall be two."), block(4, "(a) an item"),
        block(5, "7.9. Later"), block(6, "7.6. Back again"), block(7, "Annex 8", level=1), block(8, "Power-", level=1), block(9, "operated doors", level=2), block(10, "1. First"), block(11, "more"),
    ]
    df = blocks_of(spark, rows)
    crumbs = {r["ordinal"]: (r["scope"], r["crumbs"]) for r in structure.breadcrumbs(df).collect()}
    assert crumbs[0] == ("Front matter", [])
    assert crumbs[4] == ("Regulation", ["7 Requirements", "7.6 Exits", "7.6.1 Number of exits shall be two."])
    assert crumbs[11] == ("Annex 8", ["1 First"])
    assert [(r["number"], r["before"]) for r in structure.backward_jumps(df).collect()] == [("7.6", "7.9")]
    assert [(r["scope"], r["title"]) for r in structure.scopes(df).orderBy("segment").collect()] == [("Regulation", ""), ("Annex 8", "Power-operated doors")]


def test_frames_equal_the_stack(spark):
    chance = random.Random(5)
    rows, i = [], 0
    for doc in range(25):
        for k in range(40):
            number = ".".join(str(chance.randint(1, 3)) for _ in range(chance.randint(1, 4)))
            text = f"{number}. Title" if chance.random() < 0.7 else "plain words here"
            if chance.random() < 0.05:
                rows.append(block(k, f"Annex {chance.randint(1, 4)}", level=1, doc=f"d{doc}"))
            else:
                rows.append(block(k, text, doc=f"d{doc}"))
            i += 1
    df = blocks_of(spark, rows)
    frames = {(r["doc_id"], r["ordinal"]): r["crumbs"] for r in structure.breadcrumbs(df).collect()}
    stack = {(r["doc_id"], r["ordinal"]): r["crumbs"] for r in structure.breadcrumbs_by_fold(df).collect()}
    assert frames == stack


def test_chunks_keep_every_block_once_and_in_scope(spark):
    rows = [block(0, "ignored front words", scope="Front matter")]
    i = 1
    for annex in (1, 2):
        for section in range(1, 6):
            for leaf in range(3):
                rows.append(block(i, " ".join(f"w{i}" for _ in range(22)), scope=f"Annex {annex}", number=f"{section}.{leaf}", crumbs=[f"Annex {annex}", f"{section} S", f"{section}.{leaf} L"]))
                i += 1
    rows.append(block(i, " ".join(f"Sentence {k} has ten plain words in it right here now." for k in range(12)), scope="Annex 2", crumbs=["Annex 2", "6 Long"]))
    config = chunking.ChunkerConfig(target_tokens=60, max_tokens=80, min_tokens=8)
    got = chunking.chunk_documents(blocks_of(spark, rows), config=config).orderBy("chunk_index").collect()
    assert all(r["token_count"] <= 80 for r in got)
    seen = [b for r in got for b in r["block_ids"]]
    assert list(dict.fromkeys(seen)) == [f"d:{k:05d}" for k in range(1, i + 1)], "each block, in order, none from the front"
    assert all(len({b for b in r["block_ids"] if int(b[-5:]) <= 15}) in (0, len(r["block_ids"])) for r in got), "no chunk crosses scopes"
    words = " ".join(r["text"] for r in got).split()
    assert sorted(words) == sorted(w for r in rows[1:] for w in r[3].split())
    assert [r["id"] for r in got][:2] == ["d:c00000", "d:c00001"]


def test_chunker_on_empty_and_null(spark):
    assert chunking.chunk_documents(blocks_of(spark, [])).count() == 0
    rows = [block(0, None), block(1, "words", scope=None)]
    got = chunking.chunk_documents(blocks_of(spark, rows)).collect()
    assert [r["block_ids"] for r in got] == [["d:00001"]]


def plain_chunks(doc, texts, paths, config, count):
    """The definition, word by word: a section that fits is a chunk; of another, its own blocks and then its parts, packed."""

    def head(path):
        title = path[0].split(": ", 1)[1].split() if ": " in path[0] else []
        first = path[0] if len(title) <= config.max_scope_title_words else path[0].split(": ", 1)[0] + ": " + " ".join(title[: config.max_scope_title_words]) + "…"
        return " > ".join([f"{doc} | {first}", *path[1:]])

    def size(unit):
        common = [x[0] for x in zip(*[paths[b] for b, _ in unit])]
        depth = next((k for k in range(len(common)) if len({paths[b][k] for b, _ in unit}) > 1), min(len(paths[b]) for b, _ in unit))
        return count(head(paths[unit[0][0]][:depth]) + "\n\n" + "\n".join(t for _, t in unit))

    fits = lambda b, text: size([(b, text)]) <= config.max_tokens

    def windows(b, words):
        if not words:
            return []
        k = max([1, *(j for j in range(1, len(words) + 1) if fits(b, " ".join(words[:j])))])
        return [[(b, " ".join(words[:k]))], *windows(b, words[k:])]

    def split(b):
        sentences = re.split(r"(?<=[.;:])\s+", texts[b])
        return [u for x in sentences for u in ([[(b, x)]] if fits(b, x) else windows(b, x.split()))]

    def joined(packed, unit):
        both = size(packed[-1] + unit) if packed else math.inf
        small = packed and min(size(packed[-1]), size(unit)) < config.min_tokens
        return [*packed[:-1], packed[-1] + unit] if both <= (config.max_tokens if small else config.target_tokens) else [*packed, unit]

    def tree(blocks, depth):
        own, parts = [], []
        for at, b in enumerate(blocks):
            if len(paths[b]) == depth:
                own.append(b)
            elif at and parts and parts[-1][-1] == blocks[at - 1] and paths[b][: depth + 1] == paths[parts[-1][-1]][: depth + 1]:
                parts[-1].append(b)
            else:
                parts.append([b])
        ordered = [tree(p, depth + 1) for p in parts]
        flat = [(b, texts[b]) for b in own] + [x for t in ordered for x in t[1]]
        if size(flat) <= config.max_tokens:
            return [flat], flat
        units = [u for b in own for u in ([[(b, texts[b])]] if size([(b, texts[b])]) <= config.max_tokens else split(b))] + [u for t in ordered for u in t[0]]
        return functools.reduce(joined, units, []), flat

    return tree(list(range(len(texts))), 1)[0]


@pytest.mark.parametrize("count", [chunking.count_words, lambda t: len(t) // 4 + 1], ids=["words", "characters"])
def test_chunker_equals_its_definition(count):
    chance = random.Random(8)
    config = chunking.ChunkerConfig(target_tokens=40, max_tokens=60, min_tokens=20)
    for _ in range(150):
        path, texts, paths = ["Annex 1: A title of rather many words that is cut somewhere here"], [], []
        for _ in range(chance.randint(1, 25)):
            if chance.random() < 0.4:
                path = [*path, f"s{chance.randint(1, 3)}"]
            elif len(path) > 1 and chance.random() < 0.5:
                path = path[: chance.randint(1, len(path) - 1)]
            paths.append(tuple(path))
            texts.append(" ".join(chance.choice(["w", "w.", "long;", "a"]) for _ in range(chance.choice([1, 3, 8, 20, 80]))))
        run = chunking._Run("d", texts, paths, config, count)
        assert [list(zip(b, t)) for b, t, _ in chunking.chunk_units(run)] == plain_chunks("d", texts, paths, config, count)


def test_scope_titles_come_late(spark):
    rows = [block(0, "Annex 3", scope="Annex 3", crumbs=["Annex 3"]), block(1, "7. Requirements", scope="Annex 3", number="7", crumbs=["Annex 3: Doors and exits", "7 Requirements"])]
    got = chunking.chunk_documents(blocks_of(spark, rows)).collect()
    assert [r["header"] for r in got] == ["d | Annex 3: Doors and exits"]
    report = chunking.chunking_report(blocks_of(spark, [*rows, block(2, "x", scope="Front matter")]), chunking.chunk_documents(blocks_of(spark, rows))).first()
    assert (report["input_blocks"], report["excluded_blocks"], report["split_blocks"], report["chunks"]) == (2, 1, 0, 1)


def test_pack_additive(spark):
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate([5, 5, 5, 11, 2, 2])], "doc string, at int, size int")
    got = [(r["at"], r["bin"]) for r in chunking.pack_additive(df, ["doc"], "at", "size", 10).orderBy("at").collect()]
    assert got == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4)]


def test_role_counts(spark):
    rows = [block(0, "a"), block(1, "b", role=None), block(2, "c")]
    assert layout.role_counts(blocks_of(spark, rows)).first()["role_counts"] == {"body": 2, "unknown": 1}


def test_document_text(spark):
    rows = [block(1, "second"), block(0, "first"), block(1, "second"), block(2, "x", role="toc")]
    assert structure.document_text(blocks_of(spark, rows)).select(F.col("text")).first()["text"] == "first\n\nsecond"

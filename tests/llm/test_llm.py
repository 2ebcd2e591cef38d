"""The training-data operators against brute force, hand-made cases and hard inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import leaks, mixing, overlap, packing, pieces, quality, replies, sentences
from quillspark.llm import queries as llm_queries

LONG = "The cover of the Gadrozul box must not touch the handrail. " * 4000


# --- 1 overlap

GOLDEN = "id string, question string, split string, source string, lang string, status string"
SAME = [
    ("What is the minimum width of the Negutrim step well during a Tiplehapom journey longer than 1,040 hours?", "dev"),
    ("WHAT IS THE SMALLEST WIDTH OF THE NEGUTRIM STEP WELL DURING A TIPLEHAPOM JOURNEY LONGER THAN 1040 HOURS", "test"),
    ("Please tell me: during a Tiplehapom journey longer than １０４０ hours, what is the min. widht of the Negutrim step well? Thanks!", "test"),
    ("What is the maximum width of the Negutrim step well during a Tiplehapom journey longer than 1040 hours?", "test"),
    ("What is the minimum width of the Negutrim step well during a Tiplehapom journey longer than 1041 hours?", "test"),
    ("What is the minimum width of the Bafolut step well during a Tiplehapom journey longer than 1040 hours?", "test"),
]


def golden(spark, rows):
    return spark.createDataFrame([(f"q{i}", q, s, "x", None, None) for i, (q, s) in enumerate(rows)], GOLDEN)


def test_same_questions_and_others(spark):
    filler = [(f"What is the width of the Name{chr(97 + i % 26)}{chr(97 + i // 26)}x step well during a Trip{chr(97 + i % 26)}q journey longer than {i} hours?", "dev") for i in range(60)]
    df = golden(spark, SAME + filler + [(None, "test"), ("", "test"), ("???", "dev")])
    assert {(r["id_a"], r["id_b"]) for r in overlap.found_pairs(df.unionAll(df)).collect()} == {("q0", "q1"), ("q0", "q2")}
    report = {r["split"]: (r["items"], r["overlapping"]) for r in overlap.overlap_report(df).collect()}
    assert report["test"] == (7, 2) and report["dev"][1] == 1


def test_no_golden(spark):
    assert overlap.found_pairs(golden(spark, [])).count() == 0
    assert overlap.found_pairs(golden(spark, SAME[:1])).count() == 0


def test_cosine_join_equals_brute_force(spark):
    chance = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(str(i), [chance.choice(words) for _ in range(chance.randint(2, 7))], int(i % 3 == 0), int(i % 3 != 0)) for i in range(120)]
    classes = spark.createDataFrame(rows, "class string, terms array<string>, held int, tuned int")
    vectors = overlap.class_vectors(classes)
    got = {(r["class_a"], r["class_b"]): r["cosine"] for r in overlap.cosine_pairs(vectors, 0.5).collect()}
    v = {r["class"]: {x["t"]: x["w"] for x in r["vector"]} for r in vectors.collect()}
    side = {r[0]: r[2] for r in rows}
    want = {}
    for a, b in itertools.product(v, v):
        if side[a] == 1 and side[b] == 0:
            c = sum(w * v[b].get(t, 0.0) for t, w in v[a].items())
            if c >= 0.5:
                want[a, b] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_items_without_split_count_as_tuned_on(spark):
    assert overlap.found_pairs(golden(spark, [(SAME[0][0], None), (SAME[1][0], "test"), (SAME[0][0], None)])).count() == 2


def test_copies_are_compared_once(spark):
    df = golden(spark, [SAME[0]] * 30 + [(SAME[1][0], "test")] * 20)
    assert overlap.found_pairs(df).count() == 600


def test_names_near_a_common_word_stay_names(spark):
    filler = [(f"Which roads lead to the Name{chr(97 + i % 26)}{chr(97 + i // 26)}q side gate?", "dev") for i in range(100)]
    pairs = [("Who inspects the Rogado pump in the winter months?", "dev"), ("Who inspects the Rofido pump in the winter months?", "test"), ("Who inspects the Rogadoo pump in the winter months?", "test")]
    got = {(r["id_a"], r["id_b"]) for r in overlap.found_pairs(golden(spark, pairs + filler)).collect()}
    assert got == {("q0", "q2")}


DIFFERENT = [
    ("Is the brass coupling allowed in the wet bay?", "Is the brass coupling not allowed in the wet bay?"),
    ("Does the lamp shine to the right side of the deck?", "Does the lamp shine to the light side of the deck?"),
    ("Is the third bench seated near the middle door?", "Is the third bench heated near the middle door?"),
    ("Does the cable run from the front pump during tests?", "Does the cable run to the front pump during tests?"),
    ("May the driver open the rear hatch alone?", "Must the driver open the rear hatch alone?"),
    ("Which bolt holds the Zotalim frame in winter?", "Which bolt holds the frame in winter?"),
]


@pytest.mark.parametrize("often", [1, 40])
def test_one_word_may_turn_a_question(spark, often):
    """Whatever the size of the table: the same pairs meet with few other questions and with many."""
    rows = [x for a, b in DIFFERENT for x in ((a, "dev"), (b, "test"))] + [("Is the brass copling allowed in the wet bay, please?", "test")]
    filler = [f"Is the right lamp seated near the coupling Na{chr(97 + i % 26)}{chr(97 + i // 26)}x of the light bay from deck {i}?" for i in range(often)]
    got = {(r["id_a"], r["id_b"]) for r in overlap.found_pairs(golden(spark, rows + [(f, "dev") for f in filler])).collect()}
    assert got <= {("q0", "q12")}
    assert often == 1 or got


def test_slips_are_told_by_ratio_alone(spark):
    words = [("width", 60), ("widht", 2), ("coupling", 300), ("copling", 9), ("cuopling", 30), ("heated", 4), ("seated", 90), ("light", 2), ("right", 50), ("rails", 50), ("rail", 40)]
    got = {r["t"]: r["v"] for r in overlap.slips_of(spark.createDataFrame(words, "t string, n long")).collect()}
    assert got == {"widht": "width", "copling": "coupling"}
    ten = {r["t"]: r["v"] for r in overlap.slips_of(spark.createDataFrame([(w, 10 * n) for w, n in words], "t string, n long")).collect()}
    assert ten == got


# --- 2 pieces


def test_pieces_lose_nothing_and_fit():
    chance = random.Random(1)
    for _ in range(150):
        text = "".join(chance.choice(["word ", "Wort. ", "A heading\n\n", "- item, part; rest\n", "中文字。", "ข้อความ ", "x" * chance.randint(1, 60), "  ", " ", "\n"]) for _ in range(chance.randint(0, 120)))
        limit, lap = chance.randint(8, 40), chance.randint(0, 12)
        got = pieces.piece_spans(text, limit, lap)
        assert "".join(text[o:b] for _, o, b in got) == text
        count = lambda t: len(pieces._TOKEN.findall(t))
        assert all(count(text[a:b]) <= limit for a, _, b in got) or len(got) == 1
        assert all(a <= o for a, o, _ in got)
        for (a, o, b), before in zip(got[1:], got):
            assert before[1] <= a <= o == before[2]


def test_cuts_fall_on_sentences():
    text = " ".join(f"Sentence number {i} has exactly eight words here." for i in range(40))
    got = pieces.piece_spans(text, 64, 8)
    assert all(text[o:b].strip().endswith(".") for _, o, b in got)
    assert all(len(text[a:o].split()) == 8 for a, o, _ in got[1:])


def test_headings_own_their_sections():
    body = lambda k, n: " ".join(f"Sentence {k} {i} has exactly seven words." for i in range(n))
    text = f"# Title\n\n## A heading\n\n{body('a', 9)}\n\n## B heading\n\n{body('b', 5)}\n\n### Part\n\n{body('c', 2)}\n\n## C heading\n\n{body('d', 30)}\n"
    got = [text[o:b] for _, o, b in pieces.piece_spans(text, 80, 8)]
    assert "".join(got) == text
    assert got[0].startswith("# Title\n\n## A heading") and "Sentence a 8" in got[0]
    assert got[1].startswith("## B heading") and "Sentence c 1" in got[1] and "## C" not in got[1]
    assert got[2].startswith("## C heading\n\nSentence d 0")
    assert not any(p.rstrip().split("\n")[-1].startswith("#") for p in got), "no piece ends on a heading"
    numbered = "\n".join(["1. Scope", "1.1 Doors", *[f"Line {i} of the door part, which is rather long." for i in range(6)], "1.2 Steps", *[f"Line {i} of the step part, which is rather long." for i in range(6)]])
    cut = [numbered[o:b] for _, o, b in pieces.piece_spans(numbered, 70, 4)]
    assert cut[0].startswith("1. Scope\n1.1 Doors") and cut[1].startswith("1.2 Steps") and len(cut) == 2
    nested = "\n".join(f"- entry {i} of the outer list\n" + "\n".join(f"  - inner {i} {k} says a little more" for k in range(4)) for i in range(8))
    assert all(nested[o:b].startswith("- entry") for _, o, b in pieces.piece_spans(nested, 90, 5))


def test_oversized(spark):
    rows = [("a", LONG, 1), ("a", LONG, 1), ("b", "short", 2), ("c", None, 3), ("d", "", 4), ("e", "字" * 513, 5), ("f", "字" * 512, 6)]
    chunks = spark.createDataFrame(rows, "id string, text string, piece_no int")
    blocks = spark.createDataFrame([("g", "x " * 600, 0)], "id string, text string, tokens int")
    assert sorted(r["id"] for r in pieces.oversized_ids(chunks, blocks).collect()) == ["a", "e", "g"]
    whole = pieces.split_oversized(chunks, ["id"], all_items=True).groupBy("id").count().collect()
    assert {r["id"] for r in whole} == {"a", "b", "d", "e", "f"}
    assert pieces.chunk_and_block_pieces(chunks.limit(0), blocks.limit(0)).count() == 0


# --- 3 packing


def test_windows_are_valid_and_few():
    chance = np.random.default_rng(2)
    for n in (0, 1, 7, 300):
        sizes = chance.integers(0, 900, n)
        where = packing.assign_windows(sizes, 1000)
        used = np.bincount(where, weights=sizes) if n else np.array([])
        assert (used <= 1000).all()
        if n:
            assert len(used) <= packing._best_fit(np.sort(sizes)[::-1], 1000).max() + 1
    even = packing.assign_windows(np.array([500] * 8), 1000)
    assert sorted(np.bincount(even)) == [2, 2, 2, 2]


def test_no_window_falls_back_to_plain_best_fit():
    chance = np.random.default_rng(5)
    for _ in range(200):
        sizes = chance.integers(100, 700, chance.integers(2, 30))
        where = packing.assign_windows(sizes, 1000)
        assert (np.bincount(where, weights=sizes) <= 1000).all()
        fitted = packing._best_fit(np.sort(sizes)[::-1], 1000)
        assert where.max() <= fitted.max()
        price = lambda at, s: np.bincount(at, weights=s + s * s / 1024).max()
        if where.max() == fitted.max():
            assert price(where, sizes) <= price(fitted, np.sort(sizes)[::-1]) + 1e-6


def test_a_longer_document_keeps_its_windows(spark):
    def items(n):
        df = spark.createDataFrame([("d", f"i{k:04d}", k, 1, 5 + k * 7 % 23) for k in range(n)], "doc_id string, id string, chunk_index int, piece_no int, tokens int")
        return df.withColumn("sections", F.array(F.lit("s"))).withColumn("block_ids", F.array("id"))

    windows = lambda n: {(r["segment"], r["window_no"], tuple(r["chunk_ids"])) for r in packing.pack_windows(items(n), 60, segment_items=64).collect()}
    short, long = windows(192), windows(640)
    assert short <= long and len(long) > 3 * len(short)


def test_chunk_windows(spark):
    rows = [(f"d:c{i}", "d", i, "w " * (10 + i), [f"{i}"], [f"b{i}"], -5) for i in range(20)] + [("d:c0", "d", 0, "w " * 10, ["0"], ["b0"], -5)]
    rows += [("e:c0", "e", None, "w " * 5000, ["1"], ["x"], 0), ("e:c1", "e", 1, None, None, None, 0), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, doc_id string, chunk_index int, embed_text string, sections array<string>, block_ids array<string>, tokens int")
    got = packing.chunk_windows(df, 100).collect()
    assert all(r["used_tokens"] <= 100 and r["free_tokens"] == 100 - r["used_tokens"] for r in got)
    of_d = [r for r in got if r["doc_id"] == "d"]
    assert sorted(i for r in of_d for i in r["chunk_ids"]) == sorted(f"d:c{i}" for i in range(20)), "each chunk whole, once"
    assert sum(r["used_tokens"] for r in of_d) == sum(10 + i for i in range(20)) and len(of_d) <= 5
    assert sum(r["used_tokens"] for r in got if r["doc_id"] == "e") == 5000
    assert packing.chunk_windows(df.limit(0), 100).count() == 0


def test_crowded_segments_are_divided(spark):
    items = spark.createDataFrame([("d", f"i{k}", None, 1, 3) for k in range(300)], "doc_id string, id string, chunk_index int, piece_no int, tokens int")
    items = items.withColumn("sections", F.array(F.lit("s"))).withColumn("block_ids", F.array("id"))
    got = packing.pack_windows(items, 30, segment_items=64).collect()
    assert len({r["segment"] for r in got}) > 4 and sum(r["items"] for r in got) == 300


# --- 4 replies

PAIRS = [
    ("How wide must the Zotal door be?", None, "empty"), ("How wide must the Zotal door be?", " {} ", "empty"), ("How wide must the Zotal door be?", "​", "empty"), ("How wide must the Zotal door be?", "N/A", "empty"),
    ("How wide must the Zotal door be?", "HOW WIDE MUST THE ZOTAL DOOR BE", "copy"), ("How wide must the Zotal door be?", "You ask: How wide must the Zotal door be?", "copy"),
    ("How wide must the Zotal door be?", "How wide must the Zotal door be? — 80 mm", None), ("How wide must the Zotal door be?", "80 mm", None), ("How wide must the Zotal door be?", "Up to 80 mm (Annex 3, 7.9)", None),
    ("How wide must the Zotal door be?", "The Zotal door must be 80 mm wide according to", "truncated"), ("How wide must the Zotal door be?", "The Zotal door must be as wide as set out in the table of (see", "truncated"),
    ("How wide must the Zotal door be?", "Die Tür muss mindestens 80 mm breit sein, siehe Absatz 3 der Anlage.", "language"), ("How wide must the Zotal door be?", "Не менее 80 мм для исполнения Zotal, как указано в пункте 3.", "language"),
    ("How wide must the Zotal door be?", 'It must be 80 mm wide; the German text says "Die Tür muss breit sein".', None), ("Какова ширина двери Зотал?", "Потрібно щонайменше 80 мм для виконання Зотал, і це перевіряється.", "language"),
]
RESULTS = "run_id string, id string, question string, answer string, answerable boolean, defect string"


def test_defects(spark):
    rows = [("r", f"p{i}", q, a, True, "x") for i, (q, a, _) in enumerate(PAIRS)]
    for i in range(40):
        rows.append(("r", f"u{i}", f"Which colour has the Name{chr(97 + i % 26)}lo lamp?", f"The passages say nothing at all on Name{chr(97 + i % 26)}lo lamps, so I cannot answer.", i % 5 == 0, "x"))
        rows.append(("r", f"a{i}", f"How many bolts hold the Name{chr(97 + i % 26)}lo ramp?", f"The Name{chr(97 + i % 26)}lo ramp is held by {i} bolts.", i % 9 != 0, "x"))
    rows += [("r", "n1", None, "An answer to nothing.", None, "x"), ("r", "n2", None, None, None, None), (None, None, "Q?", "Fine.", True, None), ("r", "long", "How long?", LONG, True, None)]
    df = spark.createDataFrame(rows, RESULTS)
    got = {r["id"]: r["defect"] for r in replies.defects(df.unionAll(df)).collect()}
    for i, (_, _, want) in enumerate(PAIRS):
        assert got.get(f"p{i}") == want, PAIRS[i]
    assert {k for k, v in got.items() if v == "refusal"} == {f"u{i}" for i in range(0, 40, 5)}
    assert got["n2"] == "empty" and "n1" not in got and "long" not in got and not any(k and k.startswith("a") for k in got)
    assert replies.defects(df).count() == len(got)
    assert replies.defects(df.limit(0)).count() == 0


def test_opening_clusters_equal_all_pairs(spark):
    chance = random.Random(7)
    # chains of many hops: each opening is the one before it with a word more at its end and one less at its start
    walk = [f"w{i}" for i in range(60)]
    texts = [walk[i : i + 18] for i in range(40)] + [[f"v{i}" for i in range(17)] + [f"end{k}"] for k in range(25)]
    texts += [[chance.choice("abcdef") for _ in range(chance.randint(1, 18))] for _ in range(200)]
    texts = sorted({tuple(t) for t in texts})
    keyed = spark.createDataFrame([(" ".join(t), list(t)) for t in texts], "key string, opening array<string>")
    got = {}
    for r in replies.opening_clusters(keyed).collect():
        got.setdefault(r["root"], set()).add(r["key"])
    root = {" ".join(t): " ".join(t) for t in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = {" ".join(t): replies._shingles(list(t)) for t in texts}
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[top(a)] = top(b)
    want = {}
    for k in sets:
        want.setdefault(top(k), set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, got.values())) >= 40, "a long chain is one cluster"


def test_refusals_are_judged_by_distinct_questions(spark):
    rows = []
    for i in range(200):
        name = chr(97 + i % 26) + chr(97 + i // 26)
        rows.append((f"a{i}", f"How many bolts hold the Name{name}lo ramp?", f"The Name{name}lo ramp is held by {i} bolts.", True))
    for i in range(40):  # used on more answerable questions than others, yet far above chance
        name = chr(97 + i % 26) + chr(97 + i // 26)
        rows.append((f"u{i}", f"Which colour has the Other{name}lo lamp?", f"The passages say nothing at all on Other{name}lo lamps, so I cannot answer.", i % 5 < 3))
    for i in range(30):  # one hot answerable question, refused in many runs
        rows.append((f"h{i}", "Who seals the Gadrozul hatch?", "We have no data on this matter and must leave it open.", True))
    rows += [(f"k{i}", f"Where is the {w} kept?", "We have no data on this matter and must leave it open.", False) for i, w in enumerate(("spare wheel", "wooden chock", "first aid box", "fuel gauge"))]
    for i, q in enumerate(("Who tests the Rulotem pump?", "WHO TESTS THE RULOTEM PUMP", "Please tell me: who tests the Rulotem pump?", "who tests the  Rulotem pump ?!")):
        rows.append((f"e{i}", q, "Some friendly inspector from the harbour town does.", i > 2))
    df = spark.createDataFrame([("r", *r[:3], r[3], "x") for r in rows], RESULTS)
    got = {r["id"] for r in replies.defects(df).collect() if r["defect"] == "refusal"}
    assert got == {f"u{i}" for i in range(40) if i % 5 < 3} | {f"h{i}" for i in range(30)}, "e3 is one question in four writings"


def test_templates_need_no_label(spark):
    """The same refusals without a single unanswerable row, and whatever the labels are; a table ten times over gives the same."""
    rows = []
    for i in range(60):
        name = chr(97 + i % 26) + chr(97 + i // 26)
        rows.append((f"u{i}", f"Which colour has the Name{name}lo lamp?", f"Thank you for asking. The passages say nothing at all on Name{name}lo lamps, so I must pass.", True))
        rows.append((f"a{i}", f"How many bolts hold the Name{name}lo ramp?", f"Thank you for asking. The Name{name}lo ramp is held by {i + 2} bolts.", True))
        rows.append((f"d{i}", f"What is a Name{name}lo ramp in a Trip{name}lo coach?", f"It means any ramp which the Name{name}lo maker supplies together with the Trip{name}lo part.", True))
        rows.append((f"y{i}", f"May the Name{name}lo ramp be used in the rain?", "Yes.", True))
    want = {f"u{i}" for i in range(60)}
    df = spark.createDataFrame([("r", *x, None) for x in rows], RESULTS)
    got = {r["id"]: r["defect"] for r in replies.defects(df).collect()}
    assert got == dict.fromkeys(want, "refusal")
    ten = spark.createDataFrame([(f"r{k}", *x, None) for k in range(10) for x in rows], RESULTS)
    assert {(r["run_id"], r["id"]) for r in replies.defects(ten).collect()} == {(f"r{k}", i) for k in range(10) for i in want}
    mixed = df.withColumn("answerable", F.expr("id not like 'u%' or length(id) > 2"))
    assert {r["id"] for r in replies.defects(mixed).collect()} == {f"u{i}" for i in range(10, 60)}


def test_cut_words_mean_the_same_at_any_size(spark):
    answers = ["the part is required here"] * 30 + ["it is req"] + ["a rail is railed"] * 2
    df = spark.createDataFrame([(a,) for a in answers], "answer string")
    small = {r["word"] for r in replies.cut_words(df).collect()}
    assert "req" in small and "rail" not in small
    big = df.crossJoin(spark.range(20)).select("answer")
    assert {r["word"] for r in replies.cut_words(big).collect()} == small


def test_marks_of_broken_and_foreign_replies():
    assert replies.is_truncated("The part shall be marked, that is the frame (see", False) and replies.is_truncated("It is marked “closed” (cf.", False)
    assert replies.is_truncated('Two limits hold. At least 49 cm for "549', False) and not replies.is_truncated("The mark “open” is used (see Annex 3).", False)
    assert replies.is_foreign("How wide is the door?", "До 51,9 мм (приложение 3, 5.14)") and not replies.is_foreign("Who made it?", "Завод Zotal, Zotal")


# --- 5 sentences

TEXTS = {
    "7.6.1. See Fig. 3, para. 2.1 and No. 5 of Annex 2. Widths vary, e.g. by 0.5 mm! Is it so?": 3,
    'The sign reads "Push to open." and stays. The notice says "Keep clear." After that it ends': 3,
    "Parts, etc. shall fit. (See also Annex 3, para. 1.2.) Bolts, nuts, etc. The rest": 4,
    "No gap here.Next one starts.And so on": 3,
    "Covered by cloth ... the cover is removed. Open from 6.30 a.m. to 4.15 p.m. on weekdays.": 2,
    "Gemäß Abs. 3 gilt z. B. Nr. 5, d. h. die Klappe. Die Frage „Ist sie zu?“ stellt der Prüfer.": 2,
    "Selon l'art. 3, p. ex. la porte est vue. La question « Est-elle fermée ? » est posée. Fin": 3,
    "На рис. 3 и в табл. 4, т. е. далее, видно. Вопрос «Закрыт ли люк?» задают. В 2014 г. на участке": 3,
    "“舱门关好了吗？”这一问题应提出。允许偏差为12.3%。停！": 3,
    "「開けるな。」と表示する。交換できますか？係員は「止まれ！」と叫んだ。": 3,
    "क्या यह बदल सकता है? “इसे न खोलें।” लिखा हो। ठीक!": 3,
    "هل يجوز ذلك؟ توضع عبارة «لا تفتح.» هنا. نعم!": 3,
    "ผู้ผลิตต้องระบุขนาด รถต้องกว้าง 166 มิลลิเมตรเสมอ ห้ามแตะ": 3,
    "It weighs 5 N. During the test of Class B. On it goes": 3,
    "See https://example.org/Docs?Id=5 for more. Then stop.": 2,
    "Visit www.Example.Com/A!B now. Or write to John.Smith@Mail.Example.Org today. The end": 3,
    "All is at https://example.org/a.b. It is short.": 2,
    "He lives in the U.S. The law holds. The U.S. Army does not.": 3,
    "Ver. 2.0 is sold by Inc. Smith & Co. Ltd. of Hull. It was bought by Smith Inc. The price is low.": 3,
    "Der Versuch begann am 3. Mai und endete am 14. Juni. Er gilt nach dem 2. Absatz.": 2,
}


@pytest.mark.parametrize("text", TEXTS)
def test_sentences(spark, text):
    got = sentences.split_sentences(spark.createDataFrame([(text,)], "text string")).orderBy("sentence_no").collect()
    assert len(got) == TEXTS[text], [r["sentence"] for r in got]
    assert all(text[r["start_char"] : r["end_char"]] == r["sentence"] for r in got)


def test_sentence_offsets_on_hard_texts(spark):
    odd = ["", "   ", None, "One", "𝔸 b. 𝔸 C.", "... !", LONG]
    df = spark.createDataFrame([(f"d:{i}", t, "body", "text", 1) for i, t in enumerate(odd)], "id string, text string, role string, block_type string, end_char int")
    got = sentences.body_sentence_ends(df.unionAll(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r["end_char"])
    assert "d:0" not in by and "d:1" not in by and "d:2" not in by and by["d:3"] == [3] and sorted(by["d:4"]) == [4, 9] and len(by["d:6"]) == 4000
    assert sentences.body_sentence_ends(df.limit(0)).count() == 0


# --- 6 leaks


def stretch(rng, n):
    return [f"{rng.choice(['bolt', 'frame', 'gate', 'lamp', 'plate', 'rail'])}" if k % 3 else "name" + "".join(rng.choices("abcdefgh", k=6)) for k in range(n)]


def test_leaks(spark):
    rng = random.Random(4)
    items = [stretch(rng, 40) for _ in range(30)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id bigint, text string")
    noise = lambda n: " ".join(stretch(rng, n))
    dropped = items[1][5:12] + items[1][13:30]
    texts = {
        1: noise(50) + " " + " ".join(items[0]).upper() + ". " + noise(9), 2: noise(5) + " " + " ".join(dropped), 3: " ".join(items[2][:9]),
        4: noise(80), 5: " ".join(items[3][10:30]).replace("frame", "fra-\nme").replace(" ", " \n "), 6: "", 7: None, 8: " ".join(w if k % 3 else "other" + chr(97 + k % 26) + "y" for k, w in enumerate(items[4])),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("item_id", F.lit(5))
    got = leaks.find_leaks(docs.unionAll(docs), table)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 0), (2, 1), (5, 3)}
    first = got.filter("doc_id = 1").first()
    assert texts[1][first["start_char"] : first["end_char"]] == " ".join(items[0]).upper()
    kept = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs, got, "spans").collect()}
    assert "NAME" not in kept[1] and kept[4] == texts[4]
    assert {r["doc_id"] for r in leaks.remove_leaks(docs, got).collect()} == {3, 4, 6, 7, 8}
    assert leaks.find_leaks(docs, table.limit(0)).count() == 0 and leaks.find_leaks(docs.limit(0), table).count() == 0


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [" ".join(stretch(rng, 30)) for _ in range(12)]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"Start. {t} End.") for i, t in enumerate(items)], "doc_id bigint, text string")
    whole = {tuple(r) for r in leaks.find_leaks(docs, table).collect()}
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 100)
    assert len(list(leaks._blocks(table, "item_id", "text", 100))) > 3
    assert {tuple(r) for r in leaks.find_leaks(docs, table).collect()} == whole and len(whole) == 12


def test_both_tokenizers_agree():
    for text in ("The “Gadrozul” box: 1,234 mm; dri-\nver's 5.5 kN", "Кромка узла № 5 — 1 009 мм", "中文 text 12,345", "plain ascii 1,234 hand-\nrail don't"):
        assert leaks.tokens_with_spans(text)[0] == leaks.plain_tokens(text)


# --- 7 mixing


def sizes_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


TARGETS = "source string, target_share double, max_repeats int"


def test_allocation(spark):
    sizes = sizes_of(spark, [(i, s, 100) for i, s in enumerate(["a"] * 10 + ["b"] * 50 + ["c"] * 40)])
    targets = spark.createDataFrame([("A", 0.5, 2), ("b ", 0.25, 5), ("c", 0.25, 1), ("none", 0.0, 3), ("gone", None, None)], TARGETS)
    got = {r["source"]: r for r in mixing.allocation(sizes, targets, 8000).collect()}
    assert got["a"]["allotted"] == 2000 and got["b"]["allotted"] == pytest.approx(3000) and got["c"]["allotted"] == pytest.approx(3000) and got["gone"]["allotted"] == 0
    dry = {r["source"]: r["allotted"] for r in mixing.allocation(sizes, targets, 10**9).collect()}
    assert dry["a"] == 2000 and dry["b"] == 25000 and dry["c"] == 4000, "no source is used more often than allowed"


def test_mixture_reaches_its_shares(spark):
    rng = random.Random(8)
    rows = [(i, "big" if i % 3 else "small", rng.randint(1, 300)) for i in range(3000)]
    sizes = sizes_of(spark, rows)
    shares = mixing.allocation(sizes, spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 3)], TARGETS), 300_000)
    got = mixing.mixture(sizes, shares).collect()
    used = {s: sum(r["tokens"] * r["repeats"] for r in got if r["source"] == s) for s in ("big", "small")}
    want = {r["source"]: r["allotted"] for r in shares.collect()}
    assert all(abs(used[s] - want[s]) <= 300 for s in used)
    assert max(r["repeats"] for r in got if r["source"] == "small") <= 3 and len({r["doc_id"] for r in got}) == len(got)


def test_weights_steer_the_sample(spark):
    sizes = sizes_of(spark, [(i, "s", 10) for i in range(4000)]).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    shares = mixing.allocation(sizes, spark.createDataFrame([("s", 1.0, 1)], TARGETS), 10_000)
    got = mixing.mixture(sizes, shares, weight="w").collect()
    heavy = sum(r["doc_id"] % 2 == 0 for r in got)
    assert 2.4 < heavy / (len(got) - heavy) < 3.7


def test_certain_documents_are_taken_out(spark):
    """Ten documents of great weight are certain; the rates of the others make up the rest of the allotment."""
    sizes = sizes_of(spark, [(i, "s", 10) for i in range(2000)]).withColumn("w", F.when(F.col("doc_id") < 10, 1000.0).when(F.col("doc_id") < 20, F.lit(None)).otherwise(1.0 + F.col("doc_id") % 3))
    shares = mixing.allocation(sizes, spark.createDataFrame([("s", 1.0, 2)], TARGETS), 25_000)
    rows = sizes.withColumn("w", F.coalesce("w", F.lit(0.0)))
    rate = mixing.inclusion_rates(rows, shares, F.col("w")).first()["rate"]
    p = [min(1.0, rate * r["w"]) for r in rows.collect()]
    assert sum(x == 1.0 for x in p) == 10 and sum(p) * 10 == pytest.approx(5000)
    got = {r["doc_id"]: r["repeats"] for r in mixing.mixture(sizes, shares, weight="w").collect()}
    assert all(got[i] == 2 for i in range(10)) and not any(got[i] == 2 for i in range(10, 20)) and len(got) == 2000
    assert abs(10 * sum(got.values()) - 25_000) <= 10


def test_mixing_documents(spark):
    docs = spark.createDataFrame([(1, "some words here", "A"), (2, None, "a"), (3, "", "a "), (4, "text", None), (5, "other text", "b"), (5, "other text", "b")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    got = {r["doc_id"]: r["repeats"] for r in mixing.mixed_documents(docs, targets).collect()}
    assert set(got) <= {1, 5} and mixing.mixed_documents(docs.limit(0), targets).count() == 0
    assert {r["source"] for r in mixing.mixing_report(docs, targets).collect()} == {"a", "b"}


# --- 8 quality

KINDS = {
    "prose": "The cover of the box must not touch the handrail of the unit, and it is to be checked in cold weather. It shall be marked in the same way as the frame.",
    "wrapped": "The cover of the box must not touch the\nhandrail of the unit, and it is to be checked\nin cold weather. It shall be marked in the same\nway as the frame of the older model.",
    "list": "\n".join(f"• part {c}{c}" for c in "abcdefghijkl"), "contents": "\n".join(f"{i}. Title of part .......... {i * 3}" for i in range(9)),
    "csv": "name,size,weight\n" + "\n".join(f"p{i},{i * 7},{i}.5" for i in range(12)), "spaced": "\n".join(f"part{i:<12}    {i * 3:<8}    A-{i}" for i in range(9)),
    "noise": "|<§]#:}) .¤<°(<} ) °;,¤O:! ~^(=¤*~°%0l l°$ :! .~ #;1\\/= " * 4, "base64": "\n".join("aQ9zR" * 12 for _ in range(5)), "repeat": "step well roof vent " * 40,
    "mojibake": "Ð§ÐµÑ\x80ÐµÐ· 26 Ñ\x87 Ñ\x80Ð°Ð±Ð¾Ñ\x82Ñ\x8b ÐºÑ\x80Ñ\x8bÑ\x88ÐºÐ°. " * 5, "empty": "", "null": None, "salad": "Тривесаку трутрезетрен dracupem нилелопум polahoras brokemom kradohera truhizo krileste. " * 3,
    "russian": "Кромка узла не должна соприкасаться с рамой, как показано на рисунке. При температуре от нуля проверка проводится в течение часа.", "thai": "ผู้ผลิตต้องระบุขนาดของทางเดินไว้ในคู่มือ ห้ามผู้โดยสารแตะแผงหลังราวจับ",
    "long": LONG,
}
WANT = {"list": "list", "contents": "list", "csv": "table", "spaced": "table", "noise": "junk", "base64": "junk", "repeat": "junk", "mojibake": "junk", "empty": "junk", "null": "junk", "salad": "junk"}


def test_kinds(spark):
    rows = [(i, t, "prose", 7) for i, t in enumerate(KINDS.values())]
    rows += [(1000 + i, f"The cover of the box number {i} must not touch the rail of the unit{', and it is to be checked in winter' * (i % 3)}. It shall be marked in the same way as the frame.", "prose", 7) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, word_count int")
    got = {r["doc_id"]: r["kind"] for r in quality.not_prose(docs.unionAll(docs)).collect()}
    assert {name: got.get(i, "prose") for i, name in enumerate(KINDS)} == {name: WANT.get(name, "prose") for name in KINDS}
    assert set(got) <= set(range(len(KINDS)))
    # the rows come from the score: without it nothing is an outlier but texts without a word
    plain = quality.with_kind(quality.scored(quality.text_statistics(docs)).withColumn("outlier_score", F.lit(0.0)))
    assert {r["doc_id"] for r in plain.filter("kind <> 'prose'").collect()} <= {list(KINDS).index(k) for k in ("empty", "null")}
    assert quality.not_prose(docs.limit(0)).count() == 0


def test_ranks_are_exact(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([0.0, 0.25, 0.5, rng.random()])) for _ in range(500)]
    stats = spark.createDataFrame([(k, v, *[v] * (len(quality.STATS) - 1)) for k, v in rows], "lang_found string, " + ", ".join(f"{n} double" for n in quality.STATS))
    got = {(r["lang_found"], r["step"]): (r["lower"], r["upper"]) for r in quality.tail_tables(stats).filter("stat = 'symbol_ratio'").collect()}
    for lang in "ab":
        steps = [round(v * 1000) for k, v in rows if k == lang]
        for step in set(steps):
            assert got[lang, step][0] == pytest.approx(sum(x <= step for x in steps) / len(steps))
            assert got[lang, step][1] == pytest.approx(sum(x >= step for x in steps) / len(steps))


def test_scores_are_sums_of_tails(spark):
    """Own tails with the weight of the corpus' ones, by brute force."""
    import math

    rng = random.Random(10)
    rows = [(i, rng.choice(["en", "de", "und"]), *[rng.choice([0.0, 0.3, rng.random()]) for _ in quality.STATS]) for i in range(200)]
    names = list(quality.STATS)
    stats = spark.createDataFrame(rows, "doc_id bigint, lang_found string, " + ", ".join(f"{n} double" for n in names))
    halves = stats.withColumn("list_share", F.col("entry_share")).withColumn("table_share", F.lit(0.0)).drop("entry_share")
    got = {r["doc_id"]: r["outlier_score"] for r in quality.scored(halves).collect()}
    step = lambda n, v: round(round(v, 12) * 10 ** quality.STATS[n][0])
    for row in rows:
        want = 0.0
        for k, n in enumerate(names, 2):
            beyond = lambda rs: sum((step(n, r[k]) - step(n, row[k])) * quality.TAILS[n] >= 0 for r in rs)
            own = [r for r in rows if r[1] == row[1]] if row[1] != "und" else []
            want -= math.log((beyond(own) + quality.CORPUS_WEIGHT * beyond(rows) / len(rows)) / (len(own) + quality.CORPUS_WEIGHT))
        assert got[row[0]] == pytest.approx(want, abs=0.02)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat.\nA dog"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in quality.text_statistics(docs).collect()}
    assert got[1]["word_count"] == 8 and got[1]["end_punctuation_share"] == 0.5 and got[1]["mean_word_length"] == pytest.approx(22 / 8) and got[2]["word_count"] == 0


# --- all queries on the smallest tables


@pytest.mark.parametrize("name", sorted(llm_queries.queries()))
def test_query_runs(spark, data, name):
    assert llm_queries.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_as_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("blocks", "chunks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    theirs = {tuple(r) for r in con.execute(llm_queries.oracle_sql()[name]).fetchall()}
    assert {tuple(r) for r in llm_queries.queries()[name](spark, data).collect()} == theirs


# --- 6 leaks, groups of copies and repeats


def leak_world(rng, n_items=40, copies=0):
    items = [" ".join(stretch(rng, 40)) for _ in range(n_items)]
    rows = [(i, t) for i, t in enumerate(items)]
    for c in range(1, copies + 1):  # near copies, one common word exchanged
        rows += [(1000 * c + i, t.replace("bolt", f"nut{c}", 1)) for i, t in enumerate(items)]
    return items, rows


def test_copies_among_the_items_hide_none(spark):
    rng = random.Random(11)
    items, rows = leak_world(rng, copies=3)
    table = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, f"Opening words of a page. {t} Closing words.") for i, t in enumerate(items)], "doc_id bigint, text string")
    got = {tuple(r) for r in leaks.leaked_pairs(docs, table).collect()}
    assert all((i, i) in got for i in range(len(items))), "each item is found in its own text"
    assert got == {(i, 1000 * c + i) for i in range(len(items)) for c in range(4)}


def test_every_stretch_is_reported_and_removed(spark):
    rng = random.Random(12)
    item, other = " ".join(stretch(rng, 40)), " ".join(stretch(rng, 40))
    words = item.split()
    # after a short stretch one name is exchanged, then a long one goes on along the same diagonal
    broken = " ".join([*words[:4], *("another" if k == 4 else w for k, w in enumerate(words) if k >= 4)])
    docs = spark.createDataFrame([(1, f"Start here. {item} And between. {item} The end."), (2, f"Start. {broken} End.")], "doc_id bigint, text string")
    table = spark.createDataFrame([(0, item), (1, other), (2, "Gadrozul"), (3, "a quite short one")], "item_id bigint, text string")
    got = leaks.find_leaks(docs, table)
    assert got.filter("doc_id = 1").count() == 2 and {r["doc_id"] for r in got.collect()} == {1, 2}
    kept = {r["doc_id"]: r["text"] for r in leaks.remove_leaks(docs, got, "spans").collect()}
    assert "name" not in kept[1] and kept[1].startswith("Start here.") and kept[1].endswith("The end.")
    short = spark.createDataFrame([(3, "The GADROZUL box."), (4, "It is a quite short one."), (5, "nothing")], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaked_pairs(short, table).collect()} == {(3, 2), (4, 3)}


def test_block_borders_change_nothing(spark, monkeypatch):
    rng = random.Random(13)
    items, rows = leak_world(rng, n_items=12, copies=2)
    table = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(t.split()[:30])) for i, t in enumerate(items)], "doc_id bigint, text string")
    whole = {tuple(r) for r in leaks.find_leaks(docs, table).collect()}
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 100)
    assert len(list(leaks._blocks(table, "item_id", "text", 100))) > 3
    assert {tuple(r) for r in leaks.find_leaks(docs, table).collect()} == whole and len(whole) == 36


def test_shared_phrasing_with_other_names_is_no_leak(spark):
    frame = "the cover of the {} box must not touch the handrail of the {} unit when the {} lamp is lit near the {} gate on the {} deck"
    rng = random.Random(14)
    fill = lambda: frame.format(*["".join(rng.choices("abcdefgh", k=7)) for _ in range(5)])
    table = spark.createDataFrame([(i, fill()) for i in range(60)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, fill()) for i in range(20)], "doc_id bigint, text string")
    assert leaks.leaked_pairs(docs, table).count() == 0

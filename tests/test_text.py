import hashlib
import uuid

from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()["x"]


def test_normal_forms(spark):
    assert one(spark, T.normalize_text(F.col("t")), t=" a \t b \n\n c ") == "a b c"
    assert one(spark, T.pattern_key(F.col("t")), t="  Page 12  of 340 ") == "page # of #"
    assert one(spark, T.slug(F.col("t")), t="R107 Rév. 9 (final)") == "r107-r-v.-9-final"
    assert one(spark, T.slug(F.col("t")), t="---") == "document"
    assert one(spark, T.scope_name(F.col("t")), t="Annex 8 – Part 1: Doors") == "Annex 8 - Part 1"
    assert one(spark, T.scope_title(F.col("t")), t="Annex 8 – Part 1: Doors") == "Doors"


def test_numbers_and_labels(spark):
    assert one(spark, T.section_number(F.col("t")), t="7.6.1. Exits") == "7.6.1"
    assert one(spark, T.section_number(F.col("t")), t="7.6.1 Exits") is None
    assert one(spark, T.is_label(F.col("t")), t="Exits") is True
    for text in ("(Reserved)", "ends with and", "a sentence.", "", "x" * 81):
        assert one(spark, T.is_label(F.col("t")), t=text) is False
    assert one(spark, T.covers(F.col("s"), F.col("g")), s="7.6.10", g="7.6.1") is False
    assert one(spark, T.covers(F.col("s"), F.col("g")), s="7.6.1.2", g="7.6.1") is True


def test_hashes_equal_python(spark):
    namespace = uuid.UUID(T.POINT_NAMESPACE)
    assert one(spark, T.point_id(F.col("t")), t="doc:c00001") == str(uuid.uuid5(namespace, "doc:c00001"))
    for name in ("q001", "q017", "é"):
        assert one(spark, T.split_percent(F.col("t")), t=name) == int(hashlib.sha256(name.encode()).hexdigest(), 16) % 100


def test_titles_and_headers(spark):
    df = spark.sql("select array('power-', 'operated doors', 'and hatches') as a, array('Annex 3: one two three four five six seven eight nine', '7.6 Exits') as p")
    row = df.select(T.join_lines(F.col("a")).alias("t"), T.chunk_header(F.lit("doc"), F.col("p")).alias("h")).first()
    assert row["t"] == "power-operated doors and hatches"
    assert row["h"] == "doc | Annex 3: one two three four five six seven eight… > 7.6 Exits"
    paths = spark.sql("select array(array('a','b','c'), array('a','b'), array('a','x')) as p")
    assert paths.select(T.common_prefix(F.col("p"))).first()[0] == ["a"]


def test_matching_forms(spark):
    assert one(spark, T.match_form(F.col("t")), t="“ﬁre”  –  Door ") == "\"fire\" - door"
    assert one(spark, T.mentions_figure(F.col("t"), F.col("f")), t="see figure 6.", f="Figure 6") is True
    assert one(spark, T.mentions_figure(F.col("t"), F.col("f")), t="see Figure 61", f="Figure 6") is False
    assert one(spark, T.escape_attribute(F.col("t")), t='a & "b" <c>') == "a &amp; &quot;b&quot; &lt;c>"
    gold = one(spark, F.to_json(T.parse_gold(F.col("t"))), t="Annex 3|7.6.1; Annex 4|p.82")
    assert gold == '[{"scope":"Annex 3","section":"7.6.1"},{"scope":"Annex 4","page":82}]'

"""Text and value expressions against plain Python."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions import values as V
from loomline.operators import chunking
from loomline.plans import budget
from loomline.queries import estimate_tokens


def one(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in inputs.items()))
    return df.select(column.alias("out")).first()["out"]


def test_white_space(spark):
    assert one(spark, T.collapse(F.col("x")), x="a   b\n c ") == "a b c"
    assert one(spark, T.unix_newlines(F.col("x")), x="a\r\nb\rc") == "a\nb\nc"
    assert one(spark, T.paragraphs(F.col("x")), x="a\n b\n\n \n\nc") == ["a b", "c"]
    assert one(spark, T.collapse(F.col("x")), x=None) is None


@pytest.mark.parametrize("text", ["", "   ", "one", "it's 2 words, really!", "é" * 40, "a" * 4000])
def test_token_count_equals_python(spark, text):
    assert one(spark, T.token_count(F.col("x")), x=text) == plain.tokens(text)


@pytest.mark.parametrize("text", ["a\u200db", "می\u200cخواهم", "\u200d", "👩\u200d💻 ok", "x \u200c\u200d y"])
def test_token_count_of_joiners_equals_python(spark, text):
    assert one(spark, T.token_count(F.col("x")), x=text) == plain.tokens(text)


def test_estimate_tokens_has_a_row_for_every_document(spark, tmp_path):
    texts = {1: "a b", 2: "می\u200cخواهم", 3: "👩\u200d💻 ok", 4: None, 5: " "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(x) for x in estimate_tokens(spark, str(tmp_path)).collect()} == {(i, plain.tokens(t or "")) for i, t in texts.items()}


def test_clip(spark):
    assert one(spark, T.clip(F.col("x"), 20), x="abcdefghij klmnopqrstuvwxyz") == "abcde" + T.MARKER
    assert one(spark, T.clip(F.col("x"), 5), x="abcdefghij") == "abcde"
    assert one(spark, T.clip(F.col("x"), 0), x=" abc ") == "abc"


@pytest.mark.parametrize("most", [1, 5, 12, 40])
def test_clip_tokens_fits(spark, most):
    texts = ["word " * 100, "x" * 500, "a, b. " * 30, "!" * 300, "", "one", "  padded  " * 50, "déjà vu, 漢字かな " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", budget.clip_tokens_column(F.col("x"), most).alias("y"), budget.clip_tokens(F.col("x"), most, "").alias("z"))
    for r in df.collect():
        assert plain.tokens(r.y) <= most and r.y == plain.clipped(r.x, most) and r.z == plain.clipped(r.x, most, "")
    assert one(spark, budget.clip_tokens_column(F.col("x"), most), x=None) is None


def test_terms(spark):
    assert one(spark, T.lexical_terms(F.col("x")), x="Retry-Buffer v2.1 a") == ["retry-buffer", "retry", "buffer", "v2.1", "v2"]


def test_sentences():
    assert chunking.sentences_of("See Fig. 3 there. Next one! 'Quoted' ends? yes") == ["See Fig. 3 there.", "Next one!", "'Quoted' ends? yes"]
    assert chunking.sentences_of("no end") == ["no end"] and chunking.sentences_of(" ") == []


def test_pack_and_windows(spark):
    pack = lambda u, t, m: one(spark, chunking.packed_array(F.col("x"), t, m), x=u)
    assert pack(["a" * 50, "b" * 50, "c" * 5], 110, 10) == ["a" * 50 + "\n\n" + "b" * 50 + "\n\n" + "c" * 5]
    assert pack(["a" * 100, "c" * 5], 100, 10) == ["a" * 100 + "\n\n" + "c" * 5]
    assert one(spark, chunking.packed_array(F.col("x"), 100, 10), x=[]) == []
    windows = one(spark, chunking.window_array(F.col("x"), 200, 50), x="word " * 600)
    assert len(windows) >= 2 and all(windows) and max(map(len, windows)) <= 200
    assert one(spark, chunking.window_array(F.col("x"), 100, 99), x="a" * 10 + " " + "b" * 500)[-1].endswith("b")
    assert one(spark, chunking.window_array(F.col("x"), 10, 2), x="one two\nthree four")[0] == "one two"


def test_packing_equals_the_model(spark):
    r = random.Random(2)
    rows = []
    for _ in range(60):
        unit = lambda: " ".join(r.choice(["Rule", "moves.", "Then", "it", "stays,", "ok!", "e.g.", "group"]) for _ in range(r.choice([1, 3, 12, 40])))
        rows.append([unit() for _ in range(r.randint(0, 8))])
    df = spark.createDataFrame([(x,) for x in rows], "x array<string>")
    for target, least in ((60, 20), (120, 0), (0, 10), (40, 40)):
        got = [x.y for x in df.select(chunking.packed_array(F.col("x"), target, least).alias("y")).collect()]
        assert got == [plain.packed(x, target, least, chunking.sentences_of) for x in rows]


def test_predicates(spark):
    assert one(spark, T.asks_for_recent(F.col("x")), x="What changed this  WEEK?")
    assert one(spark, T.abstains(F.col("x")), x="Sorry, I don't know.") and one(spark, T.abstains(F.col("x")), x=" ")
    assert one(spark, T.phrase_hits(F.col("x"), F.col("p")), x="The Rule moves", p=["rule", "stays", "MOVES"]) == ["rule", "MOVES"]
    assert one(spark, T.is_heading(F.col("x")), x="2.1 Setup") and not one(spark, T.is_heading(F.col("x")), x="this is a sentence that goes on.")
    heading = lambda x: one(spark, T.is_heading(F.col("x")), x=x)
    assert heading("RULES AND GROUPS") and heading("Chapter 3 Rules") and heading("1.2.3 Setup of it all.")
    assert not heading("Open The Console Page") and not heading("1) Click Save and wait") and not heading("2. Pick the rule") and not heading(None) and not heading("12345")
    assert one(spark, T.is_abbreviation(F.col("x")), x="e.g.") and one(spark, T.is_abbreviation(F.col("x")), x="U.S.") and not one(spark, T.is_abbreviation(F.col("x")), x="end.")


def test_rewrites(spark):
    clean = T.clean_rewrite(F.col("x"), F.lit("old"))
    assert one(spark, clean, x='{"query": "new  one"}') == "new one" and one(spark, clean, x="Query: new") == "new"
    assert one(spark, clean, x="```\nnew\n```") == "new" and one(spark, clean, x="none") == "old" and one(spark, clean, x=None) == "old"


def test_times(spark):
    us = lambda x: one(spark, F.unix_micros(V.instant(F.col("x"))), x=x)
    assert us("2024-01-01T02:00:00+02:00") == us("2024-01-01T00:00:00Z") == us("2024-01-01 00:00:00") == us("2024-01-01")
    assert us("yesterday") is None and us("") is None and us(None) is None and us("2024-13-01T00:00:00Z") is None
    assert str(one(spark, V.pdf_date(F.col("x")), x="D:20240229")) == "2024-02-29 00:00:00" and one(spark, V.pdf_date(F.col("x")), x="D:20230229") is None
    assert str(one(spark, V.compact_date(F.col("x")), x="01052021")) == "2021-05-01" and one(spark, V.compact_date(F.col("x")), x="99992021") is None


def test_json(spark):
    assert one(spark, V.json_object(F.col("x")), x='say {"a": {"b": 1}} now') == '{"a": {"b": 1}}' and one(spark, V.json_object(F.col("x")), x="{no") is None
    pairs = one(spark, V.qa_pairs(F.col("x")), x='[{"question": " Q? ", "answer": "A"}, {"question": "", "answer": "B"}]')
    assert [tuple(p) for p in pairs] == [("Q?", "A")] and one(spark, V.qa_pairs(F.col("x")), x="nothing") == []
    assert one(spark, V.question_of(F.col("x")), x='\n"Why?"\nmore') == "Why?"


def test_ids_and_lines(spark):
    import base64
    import hashlib

    assert one(spark, T.stable_id(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha1(b"x||").hexdigest()
    token = base64.urlsafe_b64encode(b"ciscospark://us/ROOM/AbC-9").decode().rstrip("=")
    assert one(spark, V.entity_token(F.col("x")), x=token) == "abc-9" and one(spark, V.entity_token(F.col("x")), x="!!") is None
    line = one(spark, V.thread_line(F.col("a"), F.col("t"), F.lit("2024")), a="Ann", t="a\nb")
    assert line == "[2024] Ann: a b"
    assert tuple(one(spark, V.parse_thread_line(F.lit(line)), x="")) == ("2024", "Ann", "a b")
    assert tuple(one(spark, V.parse_thread_line(F.lit("plain")), x="")) == ("unknown-time", "unknown-user", "plain")


def test_doc_type(spark):
    assert one(spark, V.doc_type(F.col("x")), x=" Guides ") == "guide" and one(spark, V.doc_type(F.col("x")), x=None) is None
    with pytest.raises(Exception, match="doc_type must be one of"):
        one(spark, V.doc_type(F.col("x")), x="poem")

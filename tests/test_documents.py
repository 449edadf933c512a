import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseflow.functions import text
from clauseflow.operators import documents as D


def one(spark, column, **values):
    names = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_newlines_and_page_ends(spark):
    body = text.page_body(F.col("t"))
    for raw, expected in {"a": "a\n", "a\n": "a\n", "a\r\nb\rc": "a\nb\nc\n", "": "\n", "a\n\n": "a\n\n"}.items():
        assert one(spark, body, t=raw) == expected


def test_documents_have_exact_offsets(spark):
    pages = spark.createDataFrame([("d", 2, "zwei\r\n"), ("d", 1, "é😀"), ("d", 3, ""), ("e", 1, None)], "doc_id string, page_no int, page_text string")
    docs = {r.doc_id: r for r in D.assemble_documents(pages).collect()}
    assert docs["d"].full_text == "é😀\nzwei\n\n" and docs["d"].char_length == 9
    assert [(p.start, p.end) for p in docs["d"].pages] == [(0, 3), (3, 8), (8, 9)]
    assert docs["e"].full_text == "\n" and docs["e"].doc_title == "e"
    spans = {(r.doc_id, r.page_no): (r.start, r.end) for r in D.page_spans(pages).collect()}
    assert spans["d", 2] == (3, 8)


def test_page_for_offset(spark):
    pages = spark.createDataFrame([("d", i, "x" * n) for i, n in ((1, 4), (2, 9), (3, 2))], "doc_id string, page_no int, page_text string")
    docs = D.assemble_documents(pages)
    page = docs.select(*(D.page_for_offset(F.col("pages"), F.lit(o)).alias(str(i)) for i, o in enumerate((-1, 0, 4, 5, 14, 15, 99)))).first()
    assert list(page) == [1, 1, 1, 2, 2, 3, 3]
    empty = spark.range(1).select(D.page_for_offset(F.lit(None).cast("array<struct<start:int,end:int>>"), F.lit(3))).first()[0]
    assert empty == 1


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("a b/..c", "a_b_..c"), ("...", None), ("", None), ("x" * 130, "x" * 120), ("  né.pdf ", "n_.pdf"), ("-_a_-", "a")],
)
def test_safe_ids(spark, raw, expected):
    assert one(spark, text.safe_doc_id(F.col("t")), t=raw) == expected


def test_stems_that_clash(spark):
    files = spark.createDataFrame([("b/x.pdf",), ("a/x.pdf",), ("c/!!!.pdf",), ("c/y",)], "path string")
    ids = {r.path: r.doc_id for r in D.assign_doc_ids(files).collect()}
    assert ids["a/x.pdf"] == "x" and re.fullmatch("x_[0-9a-f]{6}", ids["b/x.pdf"]) and ids["c/!!!.pdf"].startswith("doc-") and ids["c/y"] == "y"


@pytest.mark.parametrize(
    ("page", "meta", "expected"),
    [
        ("Page 1\nCONFIDENTIAL draft\nshort 7\n12345678\nMaster   Services\tAgreement\n", None, "Master Services Agreement"),
        ("xii\nExhibit A\n", "  A  title ", "A title"),
        ("1 2 3 4 5 6 7 8 9\n", "no", "doc"),
        ("\n" * 15 + "Sixteenth line title\n", None, "doc"),
    ],
)
def test_titles(spark, page, meta, expected):
    rows = spark.createDataFrame([(page, meta)], "p string, m string")
    assert rows.select(D.guess_title(F.col("p"), F.col("m"), F.lit("doc"))).first()[0] == expected


def check_cover(t, target, overlap):
    spans = D.chunk_spans(t, target, overlap)
    assert (not t) == (not spans)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(t)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            assert a < c <= b < d
        assert all(b - a <= target or t[a:b].rstrip() == t[a : a + target].rstrip() or b == len(t) for a, b in spans)


@given(st.text(alphabet="ab \n\té😀.", max_size=3000), st.integers(200, 400), st.integers(0, 199))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_any_text(t, target, overlap):
    check_cover(t, target, overlap)


def test_chunk_boundaries():
    para = "One two three four five. " * 6
    t = (para + "\n\n") * 6
    spans = D.chunk_spans(t, 400, 60)
    ends = {b for _, b in D.paragraph_spans(t)}
    assert all(b in ends or b == len(t) for _, b in spans)
    solid = "x" * 1000
    assert D.chunk_spans(solid, 300, 50) == [(0, 300), (250, 550), (500, 800), (750, 1000)]
    words = "word " * 200
    assert all(words[a - 1] == " " for a, _ in D.chunk_spans(words, 300, 50)[1:])
    assert D.chunk_spans("   \n ", 300, 50) == [(0, 5)] and D.chunk_spans("", 300, 50) == []
    assert D.chunk_spans("abc\n\n  ", 300, 50) == [(0, 7)]
    assert all(a >= b for (_, b), (a, _) in zip(D.chunk_spans(words, 300, 0), D.chunk_spans(words, 300, 0)[1:], strict=False))


def test_chunk_table(spark):
    rng = random.Random(1)
    body = " ".join("".join(rng.choice("abé😀") for _ in range(rng.randint(1, 9))) for _ in range(900))
    pages = spark.createDataFrame([("d", 1, body[:2000]), ("d", 2, body[2000:]), ("blank", 1, " \n ")], "doc_id string, page_no int, page_text string")
    docs = D.assemble_documents(pages)
    full = {r.doc_id: r.full_text for r in docs.collect()}
    chunks = D.chunk_documents(docs, 500, 80).collect()
    assert {c.doc_id for c in chunks} == {"d"} and len({c.chunk_id for c in chunks}) == len(chunks)
    for c in chunks:
        assert c.text == full["d"][c.char_start : c.char_end] and c.page == (1 if c.char_start < 2001 else 2)
    kept, rejected = D.reject_empty(docs)
    assert [r.doc_id for r in rejected.collect()] == ["blank"] and kept.count() == 1
    report = {r.doc_id: r.chunks for r in D.ingest_report(docs, 500, 80).collect()}
    assert report == {"d": len(chunks), "blank": 1}
    with pytest.raises(ValueError):
        D.chunk_documents(docs, 100, 10)


@pytest.mark.parametrize(
    ("window", "quote", "expected"),
    [
        ("a big cat", "big", (2, 5, "big")),
        ("😀 a  big\ncat", "a big cat", (2, 12, "a  big\ncat")),
        ("x (a+b) \\E y", "(a+b) \\E", (2, 10, "(a+b) \\E")),
        ("x (a+b)\n\\E y", "(a+b) \\E", (2, 10, "(a+b)\n\\E")),
        ("abc", "abd", None),
        ("abc", "  ", None),
        ("one two", "one two", (0, 7, "one two")),
        ("Big", "big", None),
    ],
)
def test_locate(spark, window, quote, expected):
    rows = spark.createDataFrame([(window, quote)], "w string, q string")
    place = rows.select(text.locate(F.col("w"), F.col("q"))).first()[0]
    assert (tuple(place) if place else None) == expected


def test_chunking_leaves_the_session_as_it_was(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = spark.createDataFrame([("a", "word " * 2000), ("b", ""), ("c", None)], "doc_id string, full_text string")
    assert {r.doc_id for r in D.chunked_spans(rows).collect()} == {"a"}
    assert spark.conf.get(name) == before

"""What must not grow faster than its input, and results that must not hang on how rows are dealt."""

import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from clauseflow.operators import documents, extraction, gate, placement
from clauseflow.sources import literals
from clauseflow.sources.vocabulary import PATTERNS


def test_sweep_reads_the_prompts_a_fixed_number_of_times(spark, tmp_path):
    """However many batches there are; every batch read them all before."""
    runs = tmp_path / "runs"
    runs.mkdir()

    def seen(batches):
        import uuid

        (runs / uuid.uuid4().hex).touch()
        yield from batches

    source = spark.range(0, 40, 1, 1).selectExpr("concat('c', id) AS candidate_id", "concat('prompt ', id) AS prompt")
    prompts = source.mapInPandas(seen, "candidate_id string, prompt string")
    answered = extraction.sweep(prompts, lambda prompt: '{"findings": []}', str(tmp_path / "ledger"), batch=4, concurrency=1, wait=0.0)
    assert len(list(runs.iterdir())) <= 3
    assert sorted(r.candidate_id for r in answered.collect()) == sorted(f"c{i}" for i in range(40))
    # a batch has some four calls: ten tables were committed, one after another
    assert spark.read.parquet(str(tmp_path / "ledger")).groupBy("candidate_id").count().where("count > 1").isEmpty()


def test_findings_keep_their_slices_however_rows_come(spark):
    """Rows that come in another order when they are read again, as shuffles on several machines may
    give them; a running number of rows tied slices to wrong findings before."""
    pages = spark.createDataFrame([(f"d{d}", p, "".join(chr(97 + (d + p + i) % 26) for i in range(30))) for d in range(5) for p in (1, 2)], "doc_id string, page_no int, page_text string")
    text = {f"d{d}": "".join("".join(chr(97 + (d + p + i) % 26) for i in range(30)) + "\n" for p in (1, 2)) for d in range(5)}
    rows = [(f"f{d}-{s}", f"d{d}", 1 if s < 31 else 2, s, s + 9, text[f"d{d}"][s : s + 9]) for d in range(5) for s in range(50)]
    kinds = "finding_id string, doc_id string, page int, char_start int, char_end int, quote string"

    def mixed(batches):
        import random

        for batch in batches:
            yield batch.sample(frac=1, random_state=random.SystemRandom().randrange(1 << 30))

    findings = spark.createDataFrame(rows, kinds).coalesce(1).mapInPandas(mixed, kinds)
    checked = gate.check_finding_pages(findings, pages).collect()
    assert len(checked) == 250 and {r.reason for r in checked} == {None} and {r.page_repair for r in checked} == {None}


def equal_to_sql(spark, path, name, **tables):
    duck = duckdb.connect()
    for table, frame in tables.items():
        frame.write.parquet(f"file://{path}/{table}.parquet")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    ours = entry.queries()[name](spark, f"file://{path}")
    theirs = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in ours.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs))
    return theirs


def test_coverage_of_blank_texts(spark, tmp_path):
    """Blank texts, wide gaps and rows without a text: what is blank was left out before."""
    texts = ["plain words", "", " \n\t ", None, "a" + " " * 5000 + "b", "one\n\n" + "\n" * 4000 + "two words", "x " * 3000, " " * 4000, "é\r\n😀 " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(equal_to_sql(spark, tmp_path, "chunk_coverage", documents=docs)) == len(texts)


def test_pages_without_url_have_no_id(spark, tmp_path):
    urls = ["http://a/x.html", "http://b/x.html", "http://a/", "", None, None, "http://c/.x", "http://d/__", "http://e/x.y.z"]
    equal_to_sql(spark, tmp_path, "assign_doc_ids", pages=spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"))


def test_ids_of_equal_paths_do_not_hang_on_the_order_of_rows(spark):
    rows = [(i, f"http://a/{i % 3}.html") for i in range(60)]
    want = {i: f"{i % 3}" if i < 3 else None for i in range(60)}
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        named = documents.assign_doc_ids(spark.createDataFrame(rows, "page_id int, url string"), "url", "page_id").collect()
        assert {r.page_id: r.doc_id if "_" not in r.doc_id else None for r in named} == want


@pytest.mark.parametrize("few, gathered", [(64, 1024), (2, 7), (0, 1)])
def test_placement_within_makes_no_row_for_a_stretch(spark, monkeypatch, few, gathered):
    """Every stretch of every text was a row and was shuffled before."""
    monkeypatch.setattr(placement, "FEW", few, raising=False)
    monkeypatch.setattr(placement, "GATHERED", gathered, raising=False)
    rng = random.Random(few)
    draw = lambda n: "".join(rng.choices(["a", "b", "c ", " \n", "é", "😀"], k=n))
    texts = [(i, draw(rng.randint(0, 500)), f"k{i % 3}") for i in range(12)] + [(12, None, "k0"), (13, "", "k1"), (14, "a" * 600, "k2")]
    quotes = [draw(n) for n in (1, 2, 3, 5, 8, 30)] + [(t or "")[i : i + 40].replace(" ", "  ") for i, t, _ in texts] + [None, " ", "a" * 30]
    asked = [(i, q, f"k{(i + j) % 4}") for i, q in enumerate(quotes) for j in range(3)]
    want = set()
    for i, q, k in asked:
        for j, t, of in texts:
            if k == of and q and q.strip() and t and (m := re.search(r"\s+".join(map(re.escape, q.split())), t)):
                at = t.find(q)
                want.add((i, k, j, *((at, at + len(q)) if at >= 0 else m.span())))
    q = spark.createDataFrame(asked, "quote_id int, quote string, of string")
    t = spark.createDataFrame(texts, "text_id int, text string, of string")
    placed = placement.place_quotes(q, t, within="of")
    assert {tuple(r) for r in placed.select("quote_id", "of", "text_id", "start", "end").collect()} == want and len(want) > 30
    assert "inline(" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_all_that_a_pattern_needs():
    """One set of literals decided before, so that patterns ran on texts that lack the others."""
    assert literals.required_sets(r"most\s+favo(?:u)?red\s+(?:nation|customer)") == [("favo",), ("most",), ("red",), ("customer", "nation")]
    assert literals.required_sets(r"(?:(?:alpha)+beta)?gamma|delta") == [("delta", "gamma")]
    assert literals.required_sets(r"(?:alpha|\w+)x?") == literals.required_sets("[") == literals.required_sets("ab") == []
    for lines in PATTERNS.values():
        for p in lines:
            sets = literals.required_sets(p)
            assert literals.required_literals(p) in sets and all(len(x) >= literals.LEAST for some in sets for x in some)


@pytest.mark.parametrize("sent", [0, 65_536])
def test_placement_by_beginnings(spark, monkeypatch, sent):
    """Beginnings sent to the tasks find what the join of all stretches finds; those were rows before."""
    monkeypatch.setattr(placement, "SENT", sent, raising=False)
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choices(["a", "b", "c ", " \n", "é", "😀", "　"], k=n))
    texts = [(i, draw(rng.randint(0, 600))) for i in range(14)] + [(14, None), (15, ""), (16, "a" * 300), (17, " ")]
    quotes = [draw(n) for n in (1, 1, 2, 3, 4, 6, 9, 30)] + [(t or "")[i : i + 45].replace(" ", "  ") for i, t in texts] + [None, " ", "a" * 30, "é", "😀"]
    want = set()
    for i, q in enumerate(quotes):
        for j, t in texts:
            if q and q.strip() and t and (m := re.search(r"\s+".join(map(re.escape, q.split())), t)):
                at = t.find(q)
                want.add((i, j, *((at, at + len(q)) if at >= 0 else m.span())))
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    placed = placement.place_quotes(q, spark.createDataFrame(texts, "text_id int, text string"))
    assert {tuple(r) for r in placed.select("quote_id", "text_id", "start", "end").collect()} == want and len(want) > 30
    assert ("inline(" in placed._jdf.queryExecution().optimizedPlan().toString()) == (sent == 0)

"""The gate over records, pages and very many findings; sweeps that start again; literals; placement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauseflow.operators import documents, evaluation, extraction, gate, placement, screening, severity
from clauseflow.plans import review
from clauseflow.schemas import FINDINGS, REQUIRED
from clauseflow.sources import gold, literals, records, stages
from clauseflow.sources.vocabulary import PATTERNS

WHOLE = '"finding_id": "f", "doc_id": "d", "clause_type": "mfn", "page": 1, "char_start": 0, "char_end": 5, "quote": "alpha"'


def read(spark, tmp_path, *lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / "x.json").write_text("\n".join(lines))
    return records.read_records(spark, str(tmp_path / "in"), FINDINGS, REQUIRED["findings"], "finding")


def test_records_are_rows_or_reasons(spark, tmp_path):
    cases = {
        f"{{{WHOLE}}}": None,
        "  ": "blank",
        f'{{{WHOLE.replace("1,", "\"2\",")}, "confidence": "0.5", "validated": 1, "terms": {{"b": [1], "a": null}}}}': None,
        f'{{{WHOLE.replace("1,", "2.9,")}, "terms": []}}': None,
        f'{{{WHOLE.replace("1,", "true,")}, "terms": 0, "candidate_id": 7}}': None,
        '{"finding_id": "b"}': "finding missing field(s): doc_id, clause_type, page, char_start, char_end, quote",
        f"{{{WHOLE.replace('1,', 'null,')}}}": "finding.page is no integer",
        f"{{{WHOLE.replace('1,', '\"1.5\",')}}}": "finding.page is no integer",
        f"{{{WHOLE.replace('1,', '99999999999,')}}}": "finding.page is no integer",
        f"{{{WHOLE.replace('1,', '[1],')}}}": "finding.page is no integer",
        f'{{{WHOLE}, "confidence": "high"}}': "finding.confidence is no number",
        f'{{{WHOLE}, "terms": "none"}}': "finding.terms is no object",
        f'{{{WHOLE.replace("1,", "\"x\",")}, "terms": [1]}}': "finding.terms is no object",
    }
    rows = read(spark, tmp_path, *cases).collect()
    bad = {r.line: r.unreadable for r in rows if r.unreadable}
    assert bad == {line: why for line, why in cases.items() if why not in (None, "blank")}
    good = [r for r in rows if not r.unreadable]
    assert [(r.page, r.confidence, r.validated, r.terms, r.candidate_id) for r in good] == [
        (1, None, False, {}, None), (2, 0.5, True, {"b": "[1]", "a": None}, None), (2, None, False, {}, None), (1, None, False, {}, "7"),
    ]
    assert all(r.finding_id is None and r.quote is None for r in rows if r.unreadable)
    for broken in ("{broken", "[1]", '"text"'):
        with pytest.raises(Exception):
            read(spark, tmp_path, f"{{{WHOLE}}}", broken).collect()


def test_unreadable_records_fail_the_gate(spark, tmp_path):
    found = read(spark, tmp_path, f"{{{WHOLE}}}", '{"finding_id": "b"}', f"{{{WHOLE.replace('alpha', 'omega')}}}")
    docs = spark.createDataFrame([("d", "t", None, 5, "alpha", None)], "doc_id string, doc_title string, source_filename string, char_length int, full_text string, pages array<struct<start:int,end:int>>")
    checked = gate.check_records(found, docs)
    assert gate.write_checked(checked, str(tmp_path / "checked")) == {"total": 3, "validated": 1, "dropped": 2, "page_repairs": 0}
    checked = spark.read.parquet(str(tmp_path / "checked"))
    assert {r.reason: r.n for r in gate.drops_by_reason(checked).collect()} == {"unreadable_finding": 1, "quote_mismatch": 1}
    assert [tuple(r) for r in gate.drops_by_doc(checked).collect()] == [("d", 1, 1)]
    assert tuple(gate.validation_report(checked).first())[:3] == (3, 1, 2)
    good, bad = gate.split_validated(checked)
    assert [r.finding_id for r in good.collect()] == ["f"] and sorted(map(str, (r.record for r in bad.collect()))) == ["None", '{"finding_id": "b"}']
    told = {(r.level, r.reason, r.doc_id): (r.total, r.dropped) for r in gate.gate_reports(checked).collect()}
    assert told == {("all", None, None): (3, 2), ("reason", "unreadable_finding", None): (1, 1), ("reason", "quote_mismatch", None): (1, 1), ("document", None, "d"): (2, 1)}
    reports = gate.gate_reports(checked)._jdf.queryExecution().executedPlan().toString()
    assert reports.count("FileScan") == 1


def many_findings(spark, pages, n, seed=4):
    random.seed(seed)
    text = {}
    for doc, _, body in sorted(pages):
        text[doc] = text.get(doc, "") + body + "\n"
    rows = []
    for i in range(n):
        doc = random.choice(["busy"] * 9 + ["other", "none"])
        size = len(text.get(doc, "x" * 50))
        start = random.randint(-1, size)
        end = start + random.randint(0, 40)
        quote = text.get(doc, "")[max(start, 0) : end] if random.random() < 0.8 else "not it"
        rows.append((f"f{i}", "c", doc, "t", "mfn", random.randint(1, 4), start, end, quote.replace(" ", "  ", 1), "s", {"i": str(i)}, None, None, False))
    return spark.createDataFrame(rows, FINDINGS)


def test_gate_by_pages_and_by_gathered_findings(spark, monkeypatch):
    pages = [("busy", i, f"page {i} " + "word \n" * (i * 7 % 23)) for i in range(1, 40)] + [("other", 1, ""), ("other", 2, "x" * 9000)]
    table = spark.createDataFrame(pages, "doc_id string, page_no int, page_text string")
    findings, docs = many_findings(spark, pages, 600), documents.assemble_documents(table)

    def told(checked):
        return {r.finding_id: (r.reason, r.page, r.page_repair, r.validated, tuple(r.terms.items())) for r in checked.collect()}

    for policy in ("repair", "strict"):
        want = told(gate.check_finding(findings, docs, policy))
        assert len(want) == 600 and len({v[0] and v[0].split(":")[0] for v in want.values()}) >= 5
        assert told(gate.judged(gate.attach_source(findings, docs, most=7), policy)) == want
        assert told(gate.check_finding_pages(findings, table, policy)) == want
        assert told(gate.judged(gate.attach_pages(findings, table, bin_chars=13), policy)) == want


def text_moves(checked):
    """Whether an exchange stands right above the scan of the texts, with no other scan between."""
    lines = checked._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "full_text" in x)
    for line in reversed(lines[:scan]):
        if "Exchange" in line:
            return True
        if "Scan" in line or "Join" in line:
            return False
    return False


def test_documents_in_buckets_are_not_shuffled(spark, tmp_path):
    rows = [("d", "D", None, 5, "alpha", None), ("e", "E", None, 4, "beta", None)]
    docs = spark.createDataFrame(rows, "doc_id string, doc_title string, source_filename string, char_length int, full_text string, pages array<struct<start:int,end:int>>")
    stages.write_document_table(docs, "texts_of_this_test", str(tmp_path / "texts"), buckets=4)
    spark.sql("DROP TABLE texts_of_this_test")
    table = stages.open_document_table(spark, "texts_of_this_test", str(tmp_path / "texts"), buckets=4)
    findings = spark.createDataFrame([("f", "c", "d", "t", "mfn", 1, 0, 5, "alpha", "s", {}, None, None, False)], FINDINGS)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = gate.check_finding(findings, table)
        assert checked.first().reason is None
        assert not text_moves(checked)
        assert text_moves(gate.check_finding(findings, spark.read.parquet(str(tmp_path / "texts"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE texts_of_this_test")


def test_stages_count_what_they_write(spark, tmp_path):
    rows = spark.range(100).withColumn("extra", F.lit('{"x": 1}'))
    assert stages.write_stage(rows, str(tmp_path / "a")) == 100 and stages.write_stage(rows, str(tmp_path / "b"), extra="extra") == 100
    assert stages.write_counted(rows, str(tmp_path / "c"), even=F.count_if(F.col("id") % 2 == 0)) == {"rows": 100, "even": 50}


def test_sweep_goes_on_where_it_ended(spark, tmp_path):
    calls, wall = tmp_path / "calls", tmp_path / "wall"
    calls.mkdir()
    wall.mkdir()

    def call(prompt: str) -> str:
        name = prompt.rpartition(" ")[2]
        if (wall / "up").exists() and int(name) % 7 == 3:
            raise SystemExit("the process ends")
        with (calls / name).open("a") as file:
            file.write("x")
        return '{"findings": []}'

    prompts = spark.createDataFrame([(f"c{i}", f"prompt {i}") for i in range(60)], "candidate_id string, prompt string")
    (wall / "up").touch()
    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        extraction.sweep(prompts, call, ledger, batch=5, concurrency=1, wait=0.0)
    done = spark.read.parquet(ledger).count() if (tmp_path / "ledger" / "_SUCCESS").exists() else 0
    (wall / "up").unlink()
    for file in calls.iterdir():
        file.unlink()
    rows = extraction.sweep(prompts, call, ledger, batch=5, concurrency=1, wait=0.0).collect()
    assert sorted(r.candidate_id for r in rows) == sorted(f"c{i}" for i in range(60)) and all(r.reply for r in rows)
    assert len(list(calls.iterdir())) == 60 - done and all(f.read_text() == "x" for f in calls.iterdir())
    assert extraction.sweep(prompts.limit(0), call, ledger).count() == 0


def test_review_aborts_and_goes_on(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, "Some words.\n\nThis agreement shall be governed by the laws of Peru."), ("e", 1, "Nothing.")], "doc_id string, page_no int, page_text string")
    reply = '{"findings": [{"clause_type": "governing_law", "quote": "%s", "summary": "s"}]}'
    path = str(tmp_path / "review")

    def down(prompt):
        raise ConnectionError("away")

    with pytest.raises(RuntimeError, match="requests failed"):
        review.review(pages, down, path=path, retries=0, wait=0.0)
    path = str(tmp_path / "again")
    made = review.review(pages, lambda p: reply % "governed by the laws of Peru", path=path)
    assert made["issues"].count() == 1 and made["gate_reports"].where("level = 'all'").first().validated == 1
    again = review.review(pages, down, path=path)  # nothing is called any more
    assert again["issues"].count() == 1
    with pytest.raises(ValueError, match="no findings"):
        review.review(pages, lambda p: '{"findings": []}', path=str(tmp_path / "none"))


def test_literals_lose_no_match(spark):
    assert literals.required_literals(r"(?:change|changes?)\s+in\s+(?:the\s+)?control") == ("control",)
    assert literals.required_literals(r"\b(?:alpha|beta\w*)\b") == ("alpha", "beta")
    assert literals.required_literals(r"(?:alpha|\w+)x?") is None and literals.required_literals(r"(?:alpha)?") is None and literals.required_literals("[") is None
    assert literals.required_literals(r"(?:alpha)+é{2}") == ("alpha",) and literals.required_literals("ab") is None
    assert literals.shortest_cover(["control", "trol", "x"]) == ["x", "trol"]
    words = ["Change", "of", "CONTROL", "aſſign", "aSSİgn", "wıthout", "Kelvin", "exclusive", "most favored", "mfn", "governed by", "laws", "notİce", "Key", "shall not", "renew", " ", "\n", "automatically", "liability", "cap"]
    random.seed(8)
    texts = [" ".join(random.choices(words, k=random.randint(0, 9))) for _ in range(300)] + [None, ""]
    chunks = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    found = {r.chunk_id: (r.triggers, r.clause_hints) for r in screening.select_candidates(chunks).collect()}
    plain = chunks.withColumn("f", screening.first_matches(F.col("text"), PATTERNS))
    want = plain.select("chunk_id", screening.match_triggers(F.col("f")).alias("t"), screening.clause_hints(F.col("f"), PATTERNS).alias("h")).where("size(h) > 0")
    assert found == {r.chunk_id: (r.t, r.h) for r in want.collect()} and 50 < len(found) < 290
    # a pattern that needs no literal is tried itself
    odd = {"mfn": (r"\w{12,}", "zzz")}
    assert {r.chunk_id for r in screening.select_candidates(chunks, odd).collect()} == {f"k{i}" for i, t in enumerate(texts) if re.search(r"\w{12,}", t or "")}


def test_placement_equals_a_search_of_everything(spark):
    random.seed(6)
    draw = lambda n: "".join(random.choices(["a", "b", "c ", " \n", "é", "😀"], k=n))
    texts = [draw(random.randint(0, 700)) for _ in range(12)] + [None, "", "a" * 600]
    quotes = [draw(n) for n in (1, 2, 3, 5, 8)] + [(t or "")[i : i + 40].replace(" ", "  ") for i, t in enumerate(texts)] + [None, " ", "a" * 30, "a" * 300]
    q = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(quotes)], "quote_id int, quote string, of int")
    t = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "text_id int, text string, of int")

    def place(quote, text):
        if quote is None or text is None or not quote.strip():
            return None
        at = text.find(quote)
        if at >= 0:
            return at, at + len(quote)
        m = re.search(r"\s+".join(map(re.escape, quote.split())), text)
        return m and m.span()

    want = {(i, j): p for i, x in enumerate(quotes) for j, y in enumerate(texts) if (p := place(x, y))}
    assert {(r.quote_id, r.text_id): (r.start, r.end) for r in placement.place_quotes(q, t).collect()} == want and len(want) > 30
    some = placement.place_quotes(q, t, within="of").collect()
    assert {(r.quote_id, r.text_id): (r.start, r.end) for r in some} == {k: v for k, v in want.items() if k[0] % 3 == k[1] % 3}
    assert placement.place_quotes(q.where("quote_id < 0"), t).count() == 0


def test_last_gold_entry_by_file_and_line(spark, tmp_path):
    entry = '{"data": [{"title": "A.pdf", "paragraphs": [%s]}]}'
    said = lambda text: '{"context": "%s", "qas": []}' % text
    (tmp_path / "1.json").write_text("\n".join([entry % said("one"), entry % said("two"), '{"data": [{"title": "B", "paragraphs": []}, {"title": "", "paragraphs": []}]}']))
    (tmp_path / "2.json").write_text("\n".join([entry % said("three"), "", entry % f'{said("four")}, {said("five")}', entry % ""]))
    rows = gold.read_gold(spark, str(tmp_path), lines=True).collect()
    assert [(r.doc_key, r.para_ix, r.context) for r in sorted(rows, key=lambda r: r.para_ix)] == [("a", 0, "four"), ("a", 1, "five")]
    (tmp_path / "whole").mkdir()
    for name, text in (("a", "x"), ("b", "y")):
        (tmp_path / "whole" / f"{name}.json").write_text(entry % said(text))
    assert [r.context for r in gold.read_gold(spark, str(tmp_path / "whole")).collect()] == ["y"]


def test_first_pages_of_the_review_list(spark):
    random.seed(9)
    rows = [(random.choice([0, 1, 2, None]), random.choice([True, False]), random.choice(["a", "b", None]), random.choice([1, 2, None]), random.randint(0, 3), f"f{i}") for i in range(200)]
    scored = spark.createDataFrame(rows, "severity_rank int, low_confidence boolean, doc_id string, page int, char_start int, finding_id string")
    whole = [r.finding_id for r in severity.review_order(scored).collect()]
    found, last = [], None
    while True:
        page = severity.review_page(scored, 30, last)
        got = severity.review_order(page).collect()
        if not got:
            break
        found += [r.finding_id for r in got]
        last = got[-1]
    assert found == whole
    assert "TakeOrderedAndProject" in severity.review_page(scored, 5)._jdf.queryExecution().executedPlan().toString()


def test_files_of_two_folders_get_different_ids(spark, tmp_path):
    for name in ("x/Deal One.pdf", "y/Deal One.PDF", "y/z/other.pdf", "y/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    files = stages.source_files(spark, str(tmp_path))
    assert files.count() == 3 and {r.length for r in files.collect()} == {4}
    named = documents.assign_doc_ids(files.select("path"))
    ids = {r.path.rpartition("/")[2]: r.doc_id for r in named.collect()}
    assert len({r.doc_id for r in named.collect()}) == 3 and all(i for i in ids.values())


def test_evaluation_of_nothing(spark):
    with pytest.raises(RuntimeError):
        evaluation.require_evaluated(spark.createDataFrame([], "doc_key string"))

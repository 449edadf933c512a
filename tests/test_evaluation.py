import json

import pytest
from pyspark.sql import functions as F

from clauseflow.operators import evaluation as V
from clauseflow.schemas import CLAUSE_TYPES
from clauseflow.sources import gold as G

CONTEXT = "Intro. Liability is capped at fees.  The law of Delaware governs."


def nested(spark, tmp_path):
    def qa(label, *answers, impossible=False):
        return {"question": f'Parts about "{label}"?', "is_impossible": impossible, "answers": [{"text": t, "answer_start": s} for t, s in answers]}

    entry = {
        "title": "Deal One.PDF",
        "paragraphs": [
            {"context": CONTEXT, "qas": [qa("Cap On Liability", ("Liability is capped at fees.", 7), ("capped  at", 99)), qa("Governing Law", ("The law of Delaware", 3), ("not there", 1), (" ", 0)), qa("Parties", ("Intro", 0)), qa("Exclusivity", ("Intro", 0), impossible=True)]},
            {"context": "Again: Liability is capped at fees.", "qas": []},
        ],
    }
    old = {"title": "deal one", "paragraphs": [{"context": "old", "qas": []}]}
    data = {"data": [old, entry, {"title": "!!!", "paragraphs": [{"context": "x", "qas": []}]}, {"title": "Deal One", "paragraphs": []}]}
    path = tmp_path / "gold.json"
    path.write_text(json.dumps(data, indent=1))
    return G.read_gold(spark, str(path))


def test_gold_spans(spark, tmp_path):
    paragraphs = nested(spark, tmp_path)
    assert {(r.doc_key, r.para_ix) for r in paragraphs.collect()} == {("dealone", 0), ("dealone", 1)}
    spans = sorted((r.clause_type, r.gold_ix, r.start, r.end) for r in G.gold_spans(paragraphs).collect())
    law = CONTEXT.index("The law")
    assert [(c, s, e) for c, _, s, e in spans] == [("governing_law", law, law + 19), ("governing_law", -1, -1), ("indemnity_cap", 7, 35), ("indemnity_cap", 20, 29)]


def test_place_and_counts(spark, tmp_path):
    paragraphs = nested(spark, tmp_path)
    rows = [("f0", "Deal One.txt", "indemnity_cap", "Liability is capped\nat fees."), ("f1", "deal_one", "indemnity_cap", "nowhere"), ("f2", "other", "mfn", "x"), ("f3", "deal one", "nonsense", "x"), ("f4", "deal one", "indemnity_cap", "Again")]
    findings = spark.createDataFrame(rows, "finding_id string, doc_id string, clause_type string, quote string")
    placed = {r.finding_id: (r.para_ix, r.start, r.end) for r in V.place_findings(findings, paragraphs).collect()}
    assert placed == {"f0": (0, 7, 35), "f1": (None, None, None), "f2": (None, None, None), "f4": (1, 0, 5)}
    inside = V.evaluated_documents(findings, paragraphs)
    assert [r.doc_key for r in inside.collect()] == ["dealone"]
    table = V.place_findings(findings, paragraphs).join(inside, "doc_key", "left_semi")
    row = V.eval_counters(findings, inside, paragraphs, table, G.gold_spans(paragraphs)).first()
    assert (row.documents_evaluated, row.documents_annotated, row.findings_total, row.findings_outside, row.unlocatable_findings, row.unlocatable_gold) == (1, 1, 4, 1, 1, 1)
    result = {r.clause_type: r for r in V.evaluate(findings, paragraphs, G.gold_spans(paragraphs)).collect()}
    assert set(result) == {*CLAUSE_TYPES, "overall"}
    cap = result["indemnity_cap"]
    assert (cap.tp, cap.fp, cap.fn, cap.precision, cap.recall, cap.f1) == (1, 2, 1, 0.3333, 0.5, 0.4)
    assert tuple(result["mfn"])[1:] == (0, 0, 0, 0.0, 0.0, 0.0)
    with pytest.raises(RuntimeError):
        V.require_evaluated(inside.limit(0))


def spans(spark, rows, key):
    return spark.createDataFrame([(i, "d", 0, "mfn", a, b) for i, a, b in rows], f"{key} bigint, doc_key string, para_ix int, clause_type string, start int, end int")


def test_iou_at_the_limit(spark):
    ours, theirs = spans(spark, [(1, 0, 10)], "finding_id"), spans(spark, [(1, 5, 15), (2, 0, 20), (3, 10, 20)], "gold_ix")
    assert {r.gold_ix: r.iou for r in V.iou_pairs(ours, theirs, 0.3).collect()} == {1: pytest.approx(1 / 3), 2: 0.5}
    assert [r.gold_ix for r in V.iou_pairs(ours, theirs).collect()] == [2]
    with pytest.raises(ValueError):
        V.iou_pairs(ours, theirs, 0)


def test_greedy_takes_the_best_first(spark):
    pairs = [("d", 1, 10, 0, 0.6), ("d", 1, 11, 0, 0.9), ("d", 2, 11, 5, 0.8), ("d", 3, 12, 7, 0.7), ("d", 4, 12, 7, 0.7), ("e", 1, 10, 0, 0.5)]
    rows = spark.createDataFrame([(d, 0, "mfn", f, g, s, i) for d, f, g, s, i in pairs], "doc_key string, para_ix int, clause_type string, finding_id bigint, gold_ix bigint, f_start int, iou double")
    assert {(r.doc_key, r.finding_id, r.gold_ix) for r in V.greedy_match(rows).collect()} == {("d", 1, 11), ("d", 3, 12), ("e", 1, 10)}


def test_keys_and_labels(spark):
    rows = spark.createDataFrame([("A b-C.pdf", 'x "Most Favored Nation" y'), ("A.PDF.txt", "governing law "), (None, "other")], "n string, q string")
    got = [tuple(r) for r in rows.select(G.normalize_doc_key(F.col("n")), G.category_from_question(F.col("q"))).collect()]
    assert got == [("abc", "mfn"), ("apdf", "governing_law"), ("", None)]

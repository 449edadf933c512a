import pytest
from pyspark.sql import functions as F

from clauseflow.functions import periods, terms, text
from clauseflow.operators import gate, portfolio, reports, severity
from clauseflow.schemas import CLAUSE_TYPES, DOCUMENTS, FINDINGS
from clauseflow.sources import stages

TEXT = "Alpha  beta\ngamma.\nSecond page text.\n"


def documents(spark):
    return spark.createDataFrame([("d", "D", "d", len(TEXT), TEXT, [(0, 19), (19, 37)]), ("bare", "B", "b", 5, "plain", None)], DOCUMENTS)


def finding(i, doc="d", page=1, start=0, end=11, quote="Alpha beta", clause="mfn", given=None, confidence=0.9, validated=False, **more):
    base = (f"f{i}", "c", doc, "Title", clause, page, start, end, quote, more.get("summary", "s"), given or {}, more.get("severity"), confidence, validated)
    return base


CASES = [
    (finding(0), None),
    (finding(1, quote="Alpha beta gamma.", end=18), None),
    (finding(2, doc="x"), "missing_fulltext"),
    (finding(3, quote=" \n"), "empty_quote"),
    (finding(4, quote="x" * 401), "quote_too_long"),
    (finding(5, start=-1), "invalid_offsets"),
    (finding(6, end=0), "invalid_offsets"),
    (finding(7, end=99), "offsets_past_end_of_document"),
    (finding(8, quote="alpha beta"), "quote_mismatch"),
    (finding(9, start=1), "quote_mismatch"),
    (finding(10, doc="bare", page=7, end=5, quote="plain"), None),
    (finding(11, page=2), "page"),
]


def test_gate_reasons_and_policies(spark):
    table = spark.createDataFrame([f for f, _ in CASES], FINDINGS)
    fixed = {r.finding_id: r for r in gate.check_finding(table, documents(spark)).collect()}
    strict = {r.finding_id: r for r in gate.check_finding(table, documents(spark), "strict").collect()}
    for (row, reason), name in zip(CASES, (f[0] for f, _ in CASES), strict=True):
        if reason == "page":
            assert strict[name].reason == "page_mismatch:cited_2_actual_1" and not strict[name].validated
            assert fixed[name].reason is None and fixed[name].page == 1 and fixed[name].page_repair == "page_repaired_2_to_1"
        else:
            assert fixed[name].reason == strict[name].reason == reason
            assert fixed[name].validated == (reason is None)
    with pytest.raises(ValueError):
        gate.check_finding(table, documents(spark), "other")


def test_reports_of_the_gate(spark):
    table = spark.createDataFrame([f for f, _ in CASES], FINDINGS)
    checked = gate.check_finding(table, documents(spark))
    report = gate.validation_report(checked)
    assert tuple(report.first()) == (12, 4, 8, 0.6667, True, 1)
    assert {r.reason: r.n for r in gate.drops_by_reason(checked).collect()}["invalid_offsets"] == 2
    assert {r.doc_id: (r.validated, r.dropped) for r in gate.drops_by_doc(checked).collect()} == {"d": (3, 7), "x": (0, 1), "bare": (1, 0)}
    assert [r.doc_id for r in gate.missing_page_maps(table, documents(spark)).collect()] == ["bare"]
    good, bad = gate.split_validated(checked)
    assert good.count() == 4 and bad.count() == 8 and "validation_error" in bad.columns
    with pytest.raises(RuntimeError):
        gate.require_gate(report)
    with pytest.raises(ValueError):
        gate.require_gate(gate.validation_report(checked.limit(0)))


def test_drop_rate_is_not_rounded_for_the_limit(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 1001, "empty_quote").alias("reason"), F.lit(None).cast("string").alias("page_repair"))
    row = gate.validation_report(rows).first()
    assert row.drop_rate == 0.2002 and row.threshold_exceeded
    exact = rows.where("reason IS NULL").limit(3999).union(rows.where("reason IS NOT NULL").limit(1000))
    assert not gate.validation_report(exact.union(exact.limit(1))).first().threshold_exceeded


GRID = [
    ("change_of_control", "stock", {}, "note"),
    ("change_of_control", "stock", {"consent_required": "true"}, "consent_required"),
    ("change_of_control", "stock", {"notice_days": "0"}, "consent_required"),
    ("change_of_control", "stock", {"notice_days": " "}, "note"),
    ("change_of_control", "stock", {"termination_right": "Yes"}, "blocking"),
    ("change_of_control", "stock", {"termination_right": "1"}, "note"),
    ("change_of_control", "asset", {}, "note"),
    ("change_of_control", "asset", {"consent_required": "y"}, "consent_required"),
    ("anti_assignment", "asset", {}, "note"),
    ("anti_assignment", "asset", {"assignment_barred": "true"}, "blocking"),
    ("anti_assignment", "asset", {"assignment_barred": "true", "exceptions": " "}, "blocking"),
    ("anti_assignment", "asset", {"assignment_barred": "true", "exceptions": "affiliates"}, "consent_required"),
    ("anti_assignment", "asset", {"consent_standard": "Sole Discretion"}, "blocking"),
    ("anti_assignment", "asset", {"consent_required": "true", "consent_standard": "reasonable"}, "consent_required"),
    ("anti_assignment", "stock", {"assignment_barred": "true"}, "note"),
    ("indemnity_cap", "stock", {"uncapped": "true"}, "blocking"),
    ("indemnity_cap", "asset", {"uncapped": "false"}, "note"),
]


@pytest.mark.parametrize("deal", ["stock", "asset"])
def test_severity_grid(spark, deal):
    cases = [(c, t, s) for c, d, t, s in GRID if d == deal] + [(c, {}, "note") for c in CLAUSE_TYPES]
    rows = spark.createDataFrame([(i, c, t) for i, (c, t, _) in enumerate(cases)], "i int, c string, t map<string,string>")
    got = {r.i: r.s for r in rows.select("i", severity.severity_for(F.col("c"), F.col("t"), deal).alias("s")).collect()}
    for i, (clause, given, expected) in enumerate(cases):
        assert got[i].severity == expected, (clause, given)
    assert got[len(cases) - 1].reason == f"base:governing_law/{deal}"


def scored(spark):
    rows = [
        finding(0, start=5, clause="indemnity_cap", given={"uncapped": "true"}, validated=True, confidence=0.1),
        finding(1, start=5, clause="indemnity_cap", given={"uncapped": "true"}, validated=True),
        finding(2, doc="a", clause="mfn", validated=True, confidence=None, quote="=1+1\x01 x", summary="@x"),
        finding(3, clause="other", validated=True),
        finding(4, validated=False),
    ]
    return spark.createDataFrame(rows, FINDINGS)


def test_scoring_and_orders(spark):
    table = scored(spark)
    s = severity.score_findings(table, "asset")
    assert [r.finding_id for r in severity.review_order(s).collect()] == ["f1", "f0", "f2"]
    assert [r.finding_id for r in reports.issues_list(s).collect()] == ["f0", "f1", "f2"]
    assert tuple(severity.skipped(table).first()) == (1, 1)
    assert {r.severity: r.n for r in severity.severity_counts(s).collect()} == {"blocking": 2, "consent_required": 0, "note": 1}
    assert {r.finding_id: r.low_confidence for r in s.collect()} == {"f0": True, "f1": False, "f2": False}
    with pytest.raises(RuntimeError):
        severity.require_scored(s.limit(0), table)
    with pytest.raises(ValueError):
        severity.severity_for(F.lit("mfn"), F.lit(None), "lease")


def test_issue_cells_and_tables(spark):
    s = severity.score_findings(scored(spark), "asset")
    row = reports.issues_list(s).where("finding_id = 'f2'").first()
    assert row.quote == "'=1+1 x" and row.summary == "'@x" and row.low_confidence == "no" and row.terms_rendered == ""
    assert [tuple(r)[:5] for r in reports.clause_table(s).collect()] == [("mfn", 1, 0, 0, 1), ("indemnity_cap", 2, 2, 0, 1)]
    assert tuple(reports.memo_header(s).first()) == (2, 3, "asset")
    assert reports.memo_header(s.union(severity.score_findings(scored(spark), "stock"))).first().deal_structure == "unspecified"
    block = reports.memo_blocks(s).where("finding_id = 'f0'").first().block
    assert "low confidence" in block and "Terms: uncapped=true" in block and "confidence 0.10" in block
    with pytest.raises(Exception, match="unvalidated"):
        reports.issues_list(s.withColumn("validated", F.lit(False))).collect()


def test_terms_render(spark):
    rows = spark.createDataFrame([({"b": "x\ny", "a": "true", "c": None, "d": "", "e": "30"},), ({},), (None,)], "t map<string,string>")
    assert [r[0] for r in rows.select(terms.render_terms(F.col("t"))).collect()] == ["a=true; b=x y; e=30", "", ""]


@pytest.mark.parametrize(
    ("quote", "phrases", "days"),
    [
        ("not less than ninety (90) days prior", ["ninety (90) days"], 90),
        ("six (6) months or 30 days", ["six (6) months", "30 days"], 30),
        ("within forty-five (45) business days", ["forty-five (45) business days"], 45),
        ("the then-current term", [], None),
    ],
)
def test_periods(spark, quote, phrases, days):
    row = spark.createDataFrame([(quote,)], "q string").select(periods.period_phrases(F.col("q")), periods.shortest_days(F.col("q"))).first()
    assert row[0] == phrases and row[1] == days


def test_clean_and_collapse(spark):
    row = spark.createDataFrame([(" a b\x1cc\n",)], "t string").select(text.collapse_ws(F.col("t")), text.clean(F.lit("a\x00b\tc")), text.cell_safe(F.lit("-1"))).first()
    assert tuple(row) == ("a b c", "a b c", "'-1")


# --- portfolio ------------------------------------------------------------------------------------


def laws(spark, *counts):
    rows = [(f"f{n}{i}", f"d{n}{i}", "governing_law", name) for n, (name, k) in enumerate(counts) for i in range(k)]
    return spark.createDataFrame(rows, "finding_id string, doc_id string, clause_type string, position string")


def test_outliers(spark):
    assert portfolio.value_outliers(portfolio.position_distribution(laws(spark, ("A", 3), ("B", 1)))).count() == 0
    rows = portfolio.value_outliers(portfolio.position_distribution(laws(spark, ("A", 12), ("B", 1)))).collect()
    assert [(r.position, r.documents, r.total, r.majority, r.majority_documents) for r in rows] == [("B", 1, 13, "A", 12)]
    with pytest.raises(ValueError):
        portfolio.require_portfolio(laws(spark, ("A", 4)))


def test_positions_fold_equivalents(spark):
    quotes = [
        ("governing_law", "governed by the laws of the State of Delaware.", "DELAWARE"),
        ("governing_law", "by the laws of Delaware, without regard", "DELAWARE"),
        ("governing_law", "settled by arbitration in Geneva", "arbitration"),
        ("indemnity_cap", "unlimited liability", "uncapped"),
        ("exclusivity", "exclusive worldwide", "worldwide"),
        ("auto_renewal", "renews unless ninety (90) days notice", "90 days"),
        ("auto_renewal", "renews unless 90 days notice", "90 days"),
        ("anti_assignment", "consent not to be unreasonably withheld", "reasonable"),
        ("mfn", "lowest price", "other"),
    ]
    rows = spark.createDataFrame([(str(i), "d", c, q) for i, (c, q, _) in enumerate(quotes)], "finding_id string, doc_id string, clause_type string, quote string")
    got = {int(r.finding_id): r.position for r in portfolio.positions(rows).collect()}
    assert [got[i] for i in range(len(quotes))] == [p for _, _, p in quotes]
    given = spark.createDataFrame([("8", "own")], "finding_id string, position string")
    assert {r.finding_id: r.position for r in portfolio.positions(rows, given).collect()}["8"] == "own"


def test_absences_tell_gaps_from_absences(spark):
    docs = spark.createDataFrame([(f"d{i}",) for i in range(6)], "doc_id string")
    held = spark.createDataFrame([(f"d{i}", "mfn") for i in range(3, 6)] + [("d3", "mfn"), ("d2", "mfn")], "doc_id string, clause_type string")
    cands = spark.createDataFrame([("c0", "d0", ["mfn"]), ("c1", "d1", ["mfn", "exclusivity"])], "candidate_id string, doc_id string, clause_hints array<string>")
    errors = spark.createDataFrame([("c0",)], "candidate_id string")
    rows = {(r.doc_id, r.clause_type): r.cause for r in portfolio.absences(docs, held, cands, errors).collect()}
    assert rows == {("d0", "mfn"): "pipeline_gap", ("d1", "mfn"): "not_found"}


def test_names_are_verbatim(spark):
    names = spark.createDataFrame([("d", "Second page", "A"), ("d", "Alpha beta", "B"), ("x", "Alpha", "C"), ("d", "", "D")], "doc_id string, name_clause string, party string")
    assert {r.party: r.verified for r in portfolio.verify_names(names, documents(spark)).collect()} == {"A": True, "B": False, "C": False, "D": False}


# --- sources --------------------------------------------------------------------------------------


def test_stage_round_trip(spark, tmp_path):
    path = str(tmp_path / "findings")
    stages.write_stage(spark.createDataFrame([f for f, _ in CASES[:3]], FINDINGS), path)
    rows = stages.read_named_stage(spark, path, "findings", FINDINGS)
    assert {r.finding_id for r in rows.collect()} == {"f0", "f1", "f2"}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"finding_id": "a"}\n\n{broken\n')
    with pytest.raises(Exception):
        stages.read_stage(spark, str(tmp_path / "bad"), FINDINGS).collect()
    seen = stages.read_stage(spark, str(tmp_path / "bad"), FINDINGS, corrupt="raw").cache()
    assert seen.where("raw IS NOT NULL").count() == 1
    both = stages.read_stage(spark, str(tmp_path / "bad"), "finding_id string", ("finding_id",), corrupt="raw").collect()
    assert sorted((r.finding_id or "", r.raw or "") for r in both) == [("", "{broken"), ("a", "")]
    (tmp_path / "bad" / "x.json").write_text('{"finding_id": "a"}\n')
    with pytest.raises(Exception, match="missing field"):
        stages.read_named_stage(spark, str(tmp_path / "bad"), "findings", FINDINGS).collect()


def test_documents_and_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    stages.write_documents(documents(spark), path)
    wanted = spark.createDataFrame([("d",), ("gone",)], "doc_id string")
    assert {r.doc_id: r.full_text for r in stages.read_documents(spark, path, wanted).collect()} == {"d": TEXT, "gone": None}
    (tmp_path / "files" / "sub").mkdir(parents=True)
    for name in ("a.pdf", "sub/b.PDF", "c.txt"):
        (tmp_path / "files" / name).write_bytes(b"x")
    assert stages.source_files(spark, str(tmp_path / "files")).count() == 2
    issues = reports.issues_list(severity.score_findings(scored(spark), "asset"))
    stages.write_issues(issues, str(tmp_path / "issues"))
    assert spark.read.option("header", True).csv(str(tmp_path / "issues")).count() == 3

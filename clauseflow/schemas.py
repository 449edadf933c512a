"""Enumerations and table schemas that the operators share."""

from __future__ import annotations

# The clause types in their order, the severities from worst to mildest, the deal
# structures, and the terms that each clause type may state.
CLAUSE_TYPES = (
    "change_of_control",
    "anti_assignment",
    "mfn",
    "indemnity_cap",
    "auto_renewal",
    "termination_convenience",
    "exclusivity",
    "governing_law",
)
SEVERITIES = ("blocking", "consent_required", "note")
DEALS = ("stock", "asset")
CLAUSE_TERMS = {
    "change_of_control": ("trigger", "consent_required", "notice_days", "termination_right"),
    "anti_assignment": ("assignment_barred", "consent_required", "consent_standard", "exceptions", "survives_assignment"),
    "mfn": ("scope", "comparator_set", "adjustment_mechanism"),
    "indemnity_cap": ("uncapped", "cap_amount", "cap_formula", "carve_outs"),
    "auto_renewal": ("renewal_term", "notice_window_days", "price_escalator"),
    "termination_convenience": ("party", "notice_days", "fees"),
    "exclusivity": ("scope", "territory", "duration"),
    "governing_law": ("jurisdiction", "venue", "arbitration"),
}
MAX_QUOTE_CHARS = 400
MAX_SUMMARY_CHARS = 600
MAX_TRIGGERS = 12
MAX_DROP_RATE = 0.2
MIN_CONFIDENCE = 0.5
MIN_IOU = 0.5

SPANS = "array<struct<start:int,end:int>>"
PAGES = "doc_id string, page_no int, page_text string"
DOCUMENTS = f"doc_id string, doc_title string, source_filename string, char_length int, full_text string, pages {SPANS}"
CHUNKS = "chunk_id string, doc_id string, doc_title string, page int, char_start int, char_end int, text string"
TRIGGERS = "clause_type string, clause_ord int, pattern_ord int, pattern string"
CANDIDATES = "candidate_id string, " + CHUNKS + ", triggers array<string>, clause_hints array<string>"
REPLIES = "candidate_id string, reply string"
FINDINGS = (
    "finding_id string, candidate_id string, doc_id string, doc_title string, clause_type string, page int, "
    "char_start int, char_end int, quote string, summary string, terms map<string,string>, severity string, "
    "confidence double, validated boolean"
)
EXTRACTION_ERRORS = "candidate_id string, stage string, error string, raw string"

#: Columns that a stage needs; a row without one of them is refused when the stage is read.
REQUIRED = {
    "chunks": ("chunk_id", "doc_id", "page", "char_start", "char_end", "text"),
    "candidates": ("candidate_id", "chunk_id", "doc_id", "page", "char_start", "char_end", "text"),
    "findings": ("finding_id", "doc_id", "clause_type", "page", "char_start", "char_end", "quote"),
}

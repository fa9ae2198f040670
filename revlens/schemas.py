"""Explicit schemas; nothing is inferred, since file names are map keys in the case records."""

from __future__ import annotations

SPAN = "struct<file: string, start_line: int, end_line: int>"
FINDING = (
    "struct<finding_id: string, type: string, file: string, start_line: int, end_line: int, "
    f"equivalent_locations: array<{SPAN}>, in_scope: boolean, required: boolean, title: string, "
    "cross_file: boolean, pure_deletion: boolean, rationale: string>"
)
CASES = (
    "case_id string, labelled boolean, is_defective boolean, pr_title string, pr_description string, "
    "changed_files array<string>, deleted_files array<string>, added_lines map<string, array<int>>, "
    "head_files map<string, string>, context_files map<string, string>, diff string, "
    f"findings array<{FINDING}>, base_commit string, head_commit string, "
    "pull_request struct<id: bigint, url: string, source_branch: string, destination_branch: string>"
)
PREDICTIONS = (
    "case_id string, file string, line int, start_line int, end_line int, type string, confidence double, "
    "detector string, stage string, message string, title string, quote string, ord long"
)
CLAIMS = "case_id string, ord long, file string, line int, end_line int, type string, confidence double, detector string, stage string, message string, quote string"
LABELS = f"case_id string, finding_id string, label_ord int, type string, family string, in_scope boolean, required boolean, scored boolean, title string, spans array<{SPAN}>"
VERDICTS = (
    "case_id string, file string, line int, type string, title string, claimed_verdict string, verdict string, needed string, "
    "evidence array<struct<file: string, line: int, quote: string>>, reason string, evidence_checked array<boolean>, tool_calls int, steps string, error string"
)
RESPONSES = "case_id string, text string, thinking string, error string, prompt_tokens long, completion_tokens long, duration_ms long"
PULLS = (
    "id bigint, title string, description string, source struct<commit: struct<hash: string>, branch: struct<name: string>>, "
    "destination struct<commit: struct<hash: string>, branch: struct<name: string>>, links struct<html: struct<href: string>>"
)
KEYS = f"pull_requests map<string, struct<head_commit: string, is_defective: boolean, findings: array<{FINDING}>>>"
FILES = "case_id string, path string, side string, text string"

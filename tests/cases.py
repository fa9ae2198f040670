"""Cases for tests, built from files before and after a change."""

import difflib

from revlens import schemas

DEFAULTS = {
    "labelled": True, "is_defective": True, "pr_title": "A change", "pr_description": "", "deleted_files": [], "context_files": {},
    "findings": [], "base_commit": "b" * 40, "head_commit": "a" * 40,
    "pull_request": {"id": 1, "url": "http://forge/1", "source_branch": "x", "destination_branch": "main"},
}


def file_diff(path, old, new, context=3):
    """A git-style diff; None is a file that isn't there."""
    out = [f"diff --git a/{path} b/{path}"]
    if old is None:
        out.append("new file mode 100644")
    if new is None:
        out.append("deleted file mode 100644")
    a, b = (old or "").split("\n") if old else [], (new or "").split("\n") if new else []
    body = list(difflib.unified_diff(a, b, "/dev/null" if old is None else f"a/{path}", "/dev/null" if new is None else f"b/{path}", lineterm="", n=context))
    return "\n".join(out + body)


def make_case(case_id, before, after, **more):
    """before, after: path -> text of the whole repository."""
    changed = sorted(p for p in after if before.get(p) != after[p])
    deleted = sorted(p for p in before if p not in after)
    diff = "\n".join(file_diff(p, before.get(p), after.get(p)) for p in sorted({*changed, *deleted})) + "\n"
    added = {}
    for p in changed:
        s = difflib.SequenceMatcher(None, (before.get(p) or "").split("\n") if before.get(p) else [], after[p].split("\n"), autojunk=False)
        added[p] = [n + 1 for tag, _, _, a, b in s.get_opcodes() if tag in ("insert", "replace") for n in range(a, b)]
    return DEFAULTS | {
        "case_id": case_id, "changed_files": changed, "deleted_files": deleted, "added_lines": {p: n for p, n in added.items() if n},
        "head_files": {p: after[p] for p in changed}, "context_files": {p: t for p, t in after.items() if p not in changed}, "diff": diff,
    } | more


def frame(spark, cases):
    return spark.createDataFrame([tuple(c[f.split()[0]] for f in _names()) for c in cases], schemas.CASES)


def _names():
    import re

    out, depth, word = [], 0, ""
    for ch in schemas.CASES + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(re.sub(r"\s+", " ", word.strip()))
            word = ""
        else:
            word += ch
    return out


def claims(spark, rows):
    """rows: (case_id, file, line, type, confidence, quote)"""
    full = [(c, n, f, line, line, t, conf, "m", "detect", f"{t} here", q) for n, (c, f, line, t, conf, q) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.CLAIMS)

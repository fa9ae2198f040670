"""DuckDB SQL that says the same as the queries of the same name."""

from __future__ import annotations

from .kinds import kinds
from .operators import rules
from .plans.reports import HEADING
from .queries import KINDS


def _kind(number: str) -> str:
    return f"([{', '.join(f"'{k}'" for k in KINDS)}])[CAST({number} % {len(KINDS)} + 1 AS INT)]"


_DIM = "dim(kind, fam, severity) AS (VALUES " + ", ".join(f"('{k}', '{f}', '{s}')" for k, f, s, _ in kinds()) + ")"

_EVENTS = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS file, CAST(date_sub('hour', TIMESTAMP '2020-01-01', ts) AS INT) AS line,
         value AS confidence, event_id AS ord
  FROM events
)"""

_FINDINGS = f"""
{_DIM}, fd AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS file, CAST(l_linenumber * 3 AS INT) AS line, {_kind('l_partkey')} AS type, l_discount AS confidence,
         l_partkey * 10 + l_linenumber AS ord
  FROM lineitem
), fr AS (
  SELECT fd.*, fam, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, file, line, type, ord) AS rank FROM fd LEFT JOIN dim ON type = kind
), lb AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, n AS label_ord, {_kind('(o_custkey + n)')} AS type, (o_orderkey + n) % 5 > 0 AS in_scope, (o_custkey + n) % 4 > 0 AS required, (['A', 'N', 'R'])[n + 1] AS file,
         CAST((o_custkey * n + o_orderkey) % 22 + 1 AS INT) AS s1, (['N', 'R', 'A'])[n + 1] AS file2, CAST((o_custkey * (n + 5) + o_orderkey) % 22 + 1 AS INT) AS s2
  FROM orders, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS n)
), sp AS (
  SELECT case_id, label_ord, 0 AS span_ord, type, file, s1, s1 + label_ord AS e1 FROM lb
  UNION ALL SELECT case_id, label_ord, 1, type, file2, s2, s2 FROM lb
)"""

_MATCH = f"""
WITH RECURSIVE {_FINDINGS}, pr AS (
  SELECT f.case_id, f.rank, s.label_ord, f.type AS ft, f.fam AS ff, s.type AS lt, d.fam AS lf, min(greatest(0, s1 - line, line - e1)) AS distance
  FROM fr f JOIN sp s ON f.case_id = s.case_id AND f.file = s.file AND greatest(0, s1 - line, line - e1) <= 4 LEFT JOIN dim d ON s.type = d.kind
  GROUP BY ALL
), rg AS (
  SELECT 'location' AS rung, * FROM pr UNION ALL SELECT 'type', * FROM pr WHERE ft = lt UNION ALL SELECT 'family', * FROM pr WHERE ff = lf
), od AS (
  SELECT *, row_number() OVER (PARTITION BY rung, case_id ORDER BY distance, rank, label_ord) AS n FROM rg
), st AS (
  SELECT rung, case_id, n, rank, label_ord, distance, TRUE AS taken, [rank] AS ranks, [label_ord] AS labels FROM od WHERE n = 1
  UNION ALL
  SELECT o.rung, o.case_id, o.n, o.rank, o.label_ord, o.distance, NOT (list_contains(ranks, o.rank) OR list_contains(labels, o.label_ord)),
         CASE WHEN list_contains(ranks, o.rank) OR list_contains(labels, o.label_ord) THEN ranks ELSE list_append(ranks, o.rank) END,
         CASE WHEN list_contains(ranks, o.rank) OR list_contains(labels, o.label_ord) THEN labels ELSE list_append(labels, o.label_ord) END
  FROM st s JOIN od o ON s.rung = o.rung AND s.case_id = o.case_id AND o.n = s.n + 1
), mt AS (
  SELECT rung, case_id, rank, label_ord, distance FROM st WHERE taken
)"""

BAND_MATCH = _MATCH + " SELECT rung, case_id, CAST(rank AS INT) AS rank, CAST(label_ord AS INT) AS label_ord, CAST(distance AS INT) AS distance FROM mt"

SCORECARD = _MATCH + """, rn(rung) AS (VALUES ('location'), ('family'), ('type')), jn AS (
  SELECT rn.rung, m.label_ord IS NOT NULL AS hit, l.in_scope, l.required
  FROM fr CROSS JOIN rn LEFT JOIN mt m ON m.rung = rn.rung AND m.case_id = fr.case_id AND m.rank = fr.rank
  LEFT JOIN lb l ON l.case_id = m.case_id AND l.label_ord = m.label_ord
), ct AS (
  SELECT rung, count(*) AS predictions, count(*) FILTER (hit AND in_scope AND required) AS tp, count(*) FILTER (hit AND in_scope AND NOT required) AS neutral_optional,
         count(*) FILTER (hit AND NOT in_scope) AS neutral_out_scope, count(*) FILTER (NOT hit) AS fp
  FROM jn GROUP BY rung
), ms AS (
  SELECT rn.rung, count(*) FILTER (m.label_ord IS NULL) AS fn
  FROM rn CROSS JOIN (SELECT * FROM lb WHERE in_scope AND required) l LEFT JOIN mt m ON m.rung = rn.rung AND m.case_id = l.case_id AND m.label_ord = l.label_ord
  GROUP BY rn.rung
), pq AS (
  SELECT ct.*, fn, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall
  FROM ct JOIN ms USING (rung)
)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pq"""


def _greedy(source: str, key: str, order: str, start: str, columns: str, seed: str = "") -> str:
    """Leaders of each key in order: a row stays if no line kept before it is within 5."""
    keys = " AND ".join(f"s.{k} = o.{k}" for k in key.split(", "))
    mine = ", ".join(f"o.{k}" for k in key.split(", "))

    def step(kept: str, line: str) -> str:
        near = f"len(list_filter({kept}, lambda x: abs(x - {line}) <= 5)) > 0"
        return f"CASE WHEN {near} THEN {kept} ELSE list_append({kept}, {line}) END AS kept, NOT ({near}) AS stays"

    return f"""
WITH RECURSIVE {_EVENTS}, {seed} od AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM ({source})
), w AS (
  SELECT {key}, n, line, ord, {step(start, 'line')} FROM od WHERE n = 1
  UNION ALL
  SELECT {mine}, o.n, o.line, o.ord, {step('s.kept', 'o.line')} FROM w s JOIN od o ON {keys} AND o.n = s.n + 1
)
SELECT {columns} FROM w WHERE stays"""


SITE_DEDUPE = _greedy("SELECT * FROM ev", "case_id, file", "-confidence, line, ord", "CAST([] AS INT[])", "case_id, file, line, ord")
GAP_FILL = _greedy(
    "SELECT e.*, coalesce(c.covered, []) AS covered FROM ev e LEFT JOIN cv c USING (case_id) WHERE e.file <> 'purchase'",
    "case_id",
    "ord",
    "covered",
    "case_id, line, ord",
    "cv AS (SELECT case_id, list(DISTINCT line) AS covered FROM ev WHERE file = 'purchase' GROUP BY case_id),",
)
GAP_FILL_GLOBAL = _greedy(
    "SELECT e.file, e.line, e.ord, coalesce(c.covered, []) AS covered FROM gl e LEFT JOIN cv c USING (file) WHERE e.confidence <= 50",
    "file",
    "ord",
    "covered",
    "file, line, ord",
    "gl AS (SELECT case_id || '/' || (ord % 2) AS file, line, ord, confidence FROM ev), cv AS (SELECT file, list(DISTINCT line) AS covered FROM gl WHERE confidence > 50 GROUP BY file),",
)

ARGMAX = f"WITH {_EVENTS} SELECT case_id, file, line, ord FROM ev QUALIFY row_number() OVER (PARTITION BY case_id, file, line ORDER BY confidence DESC, ord) = 1"
TOPK = f"WITH {_EVENTS} SELECT case_id, ord FROM ev QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, ord) <= 6"

AGREEMENT = f"""
WITH it AS (
  SELECT l_orderkey AS case_id, l_returnflag AS file, l_linenumber AS line, {_kind('l_partkey')} AS type, l_partkey * 10000 + l_suppkey AS ord, l_discount, l_tax, l_quantity FROM lineitem
), one AS (
  SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY case_id, file, line, type ORDER BY ord DESC) = 1
), two AS (
  SELECT * FROM it WHERE l_quantity > 5 QUALIFY row_number() OVER (PARTITION BY case_id, file, line, type ORDER BY ord DESC) = 1
)
SELECT case_id, file, line, type, ord FROM it
WHERE (case_id, file, line, type) IN (SELECT (case_id, file, line, type) FROM one WHERE l_discount > 0.03)
  AND (case_id, file, line, type) IN (SELECT (case_id, file, line, type) FROM two WHERE l_tax > 0.02)"""

_LINES = """
ln AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, regexp_replace(unnest(ls), '\\r$', '') AS text, len(ls) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
)"""
LINES = f"WITH {_LINES} SELECT doc_id, line_no, sha256(text) AS text_sha256 FROM ln"
MOVED = f"""
WITH {_LINES}, k AS (
  SELECT doc_id, line_no - 1 AS pos, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS key, line_no - 1 < n // 2 AS gone FROM ln
), b AS (
  SELECT doc_id, key, count(*) AS back FROM k WHERE NOT gone GROUP BY ALL
), g AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM k WHERE gone
)
SELECT doc_id, CAST(pos AS INT) AS "at", sha256(text) AS text_sha256 FROM g LEFT JOIN b USING (doc_id, key) WHERE nth > coalesce(back, 0)"""


def _re(pattern: str) -> str:
    """A rule's pattern for RE2: the flags that Java needs go, case folding stays."""
    flags = "(?i)" if pattern.startswith("(?iu") else ""
    return (flags + pattern[pattern.index(")") + 1 :]).replace("'", "''")


_SETTINGS = f"""
st AS (
  SELECT p_partkey AS line_no,
         (['MAX_', 'verify_', 'NAME_', '  retry_', '        limit_'])[CAST(p_partkey % 5 + 1 AS INT)] || upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'))
         || (['', '_ids', '_hosts'])[CAST(p_partkey % 3 + 1 AS INT)] || ' = '
         || CASE p_size % 4 WHEN 0 THEN '0' WHEN 1 THEN '"' || p_type || ',' || p_size || '"' WHEN 2 THEN 'None  # off' ELSE CAST(p_size AS VARCHAR) END AS text
  FROM part
), asg AS (
  SELECT line_no, regexp_extract(text, '{_re(rules.ASSIGNMENT)}', 2) AS name, trim(regexp_extract(text, '{_re(rules.ASSIGNMENT)}', 3)) AS value
  FROM st WHERE regexp_matches(text, '{_re(rules.ASSIGNMENT)}')
)"""
_OFF = ", ".join("'" + x.replace("'", "''") + "'" for x in rules.OFF)
OFF = f"WITH {_SETTINGS} SELECT line_no, name, value FROM asg WHERE value IN ({_OFF}) AND (regexp_matches(name, '{_re(rules.BOUND)}') OR regexp_matches(name, '{_re(rules.GUARD)}'))"
STRINGS = f"WITH {_SETTINGS} SELECT line_no, name, value FROM asg WHERE regexp_matches(name, '{_re(rules.PLURAL)}') AND left(value, 1) IN ('\"', '''') AND (contains(value, ',') OR contains(value, ';'))"
WEAKENED = """
WITH it AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_linenumber AS line_no, l_linenumber * 1000000 + l_partkey AS i, '    assert p' || l_partkey AS text, l_returnflag = 'N' AS new FROM lineitem WHERE l_partkey % 2 = 0
), c AS (
  SELECT case_id, count(*) FILTER (NOT new) AS gone, count(*) FILTER (new) AS new, arg_min(line_no, i) FILTER (NOT new) AS line_no, arg_min(text, i) FILTER (NOT new) AS text FROM it GROUP BY case_id
)
SELECT case_id, line_no, text, gone, new FROM c WHERE gone > new"""

CONTRACT = """
WITH e AS (
  SELECT event_id, event_type AS file, CAST(props ->> '$.k' AS INT) AS line, event_id % 3 = 0 AS broken, least(1.0, CAST(event_id % 5 AS DOUBLE))::DOUBLE AS confidence FROM events
)
SELECT event_id, CASE WHEN broken THEN 'json' WHEN line < 1 THEN 'line' ELSE 'claim' END AS stage, CASE WHEN NOT broken AND line >= 1 THEN file ELSE '' END AS file,
       CASE WHEN NOT broken AND line >= 1 THEN line ELSE 0 END AS line, CASE WHEN NOT broken AND line >= 1 THEN confidence ELSE 0.0::DOUBLE END AS confidence
FROM e"""

SEVERITY = f"WITH {_DIM} SELECT coalesce(severity, 'MEDIUM') AS severity, count(*) AS findings FROM lineitem LEFT JOIN dim ON kind = {_kind('l_partkey')} GROUP BY 1"
RESUME = "SELECT conv_id AS case_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS DISTINCT FROM 1 AND doc_id IS NOT NULL)"
BUDGET = """
WITH t AS (SELECT length(coalesce(text, '')) AS n, turn, role FROM conversations)
SELECT avg(n // 4) AS mean_estimated, max(n // 4) AS max_estimated, avg(turn) AS mean_code_lines, max(turn) AS max_code_lines, avg(n) FILTER (n > 0) AS mean_tokens,
       CAST(median(n) FILTER (n > 0) AS DOUBLE) AS median_tokens, max(n) FILTER (n > 0) AS max_tokens, avg(turn) FILTER (turn > 0) AS mean_ms, max(turn) FILTER (turn > 0) AS max_ms,
       count(*) FILTER (role IS DISTINCT FROM 'user') AS failures
FROM t"""
PIVOT = """
WITH v AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'established' WHEN 'R' THEN 'contradicted' ELSE 'unsettled' END AS said, l_linestatus = 'F' AS ok, l_quantity FROM lineitem
)
SELECT count(*) FILTER (ok AND said = 'established') AS established, count(*) FILTER (ok AND said = 'contradicted') AS contradicted, count(*) FILTER (NOT ok OR said = 'unsettled') AS unsettled,
       count(*) FILTER (said = 'established') AS claimed_established, count(*) FILTER (said = 'contradicted') AS claimed_contradicted, count(*) FILTER (said = 'unsettled') AS claimed_unsettled,
       count(*) FILTER (l_quantity > 49) AS errors
FROM v"""
SPANS = f"WITH {_FINDINGS} SELECT case_id, CAST(label_ord AS INT) AS label_ord, span_ord, file, s1 AS start_line, e1 AS end_line FROM sp"
COMMENTS = f"""
WITH w AS (
  SELECT o_orderkey AS pull_id, '{HEADING}' || chr(10) || o_orderpriority AS body, o_custkey, o_orderstatus,
         CASE o_orderkey % 4 WHEN 0 THEN '{HEADING}' || chr(10) || o_orderpriority WHEN 1 THEN 'someone else''s' ELSE '{HEADING}' || chr(10) || 'old' END AS old
  FROM orders
), c AS (
  SELECT *, o_orderstatus <> 'P' AND pull_id % 5 <> 0 AND starts_with(old, '{HEADING}') AS ours FROM w
)
SELECT pull_id, CASE WHEN pull_id % 6 = 0 THEN 'moved' WHEN NOT ours THEN 'create' WHEN trim(old) = trim(body) THEN 'unchanged' ELSE 'update' END AS action, CASE WHEN ours THEN o_custkey ELSE -1 END AS comment_id
FROM c"""
NORMALISED = "SELECT p_partkey, lower(trim(regexp_replace(upper(p_name) || ' ' || p_type, '\\s+', ' ', 'g'))) AS line FROM part"

_ZEROED = """
it AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'MAX_' || l_partkey || ' = ' || CAST(floor(l_quantity) AS BIGINT), l_partkey) AS line,
         l_partkey, 'MAX_' || l_partkey || ' = ' || CAST(floor(l_quantity) AS BIGINT) AS old
  FROM lineitem
)"""
RULES = f"WITH {_ZEROED} SELECT case_id, 'settings.py' AS file, CAST(line AS INT) AS line, 'unsafe_default' AS type, 'MAX_' || l_partkey || ' = 0' AS quote FROM it WHERE l_partkey % 3 = 0"
ADDED = f"WITH {_ZEROED} SELECT case_id, 'settings.py' AS path, CAST(line AS INT) AS line FROM it WHERE l_partkey % 3 = 0"
BASE = f"""
WITH {_ZEROED}
SELECT case_id, 'settings.py' AS path, sha256(string_agg(old, chr(10) ORDER BY line)) AS text_sha256 FROM it GROUP BY case_id
UNION ALL SELECT DISTINCT case_id, 'lib.py', sha256('def f():' || chr(10) || '    return MAX_1' || chr(10)) FROM it"""
SYMBOLS = f"""
WITH {_ZEROED}
SELECT case_id, unnest(['assign', 'store']) AS role, count(*) AS uses FROM it GROUP BY case_id
UNION ALL SELECT DISTINCT case_id, unnest(['def', 'load']), 1 FROM it"""


def oracle_sql() -> dict[str, str]:
    from . import case_oracles

    return case_oracles.oracle_sql() | {
        "scorecard": SCORECARD, "band_match": BAND_MATCH, "site_dedupe": SITE_DEDUPE, "argmax_per_line": ARGMAX, "cap_topk": TOPK, "proximity_gap_fill": GAP_FILL, "gap_fill_global": GAP_FILL_GLOBAL,
        "agreement": AGREEMENT, "lines_explode": LINES, "moved_lines": MOVED, "off_values": OFF, "string_lists": STRINGS, "weakened_tests": WEAKENED,
        "contract_parse": CONTRACT, "severity_rollup": SEVERITY, "resume_anti": RESUME, "budget": BUDGET, "verdict_pivot": PIVOT, "label_spans": SPANS, "comment_plan": COMMENTS, "normalised_lines": NORMALISED,
        "rule_findings": RULES, "parse_diff": ADDED, "base_revision": BASE, "symbol_uses": SYMBOLS,
    }

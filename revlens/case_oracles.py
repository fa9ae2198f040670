"""DuckDB SQL for the queries on changes: what must come out, said from the items of an order, without a diff."""

from __future__ import annotations

from .oracles import _DIM, _MATCH, _kind

# What the operators must say, written out once more, so that a wrong word of theirs shows.
_LIST = "['established', 'contradicted', 'unsettled', 'maybe']"
_DELETED = "'How to read the listings: `+` is a new row, `-` one that is gone (shown at its old place, without a number), all others are as before.'"
_FACTS_TEXT = "'Names that the change introduces, looked up in every file. What is said here is measured; whether it matters is for you to judge.'"
_NO_SOURCE = "'There was nothing to read: no file of a kind that is reviewed (`.py`) has changed.'"
_NO_FINDINGS = "'Every changed code file was read; there is nothing to point out.'"
#: Characters of the system prompt: two sentences' instructions and a line a kind.
_SYSTEM_LENGTH = 5839
_SECRET_NAME = r"(?i)(password|passwd|secret|token|api[_-]?key|private[_-]?key|credential)"
_SECRET_VALUE = r"""[:=]\s*["']?([^"'\s]{6,})["']?\s*$"""
_PLACEHOLDER = r"(?i)(change[_-]?me|placeholder|example|xxx+|\.\.\.|<[^>]+>|\$\{|os\.environ|getenv|secrets\.|vault|\*\*\*)"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_ITEMS = """
it AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice) AS line, l_partkey AS p,
         'MAX_' || l_partkey || ' = ' || CAST(floor(l_quantity) AS BIGINT) AS old, l_partkey % 3 = 0 AS off,
         'MAX_' || l_partkey || ' = ' || CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS new, l_suppkey AS s, l_discount AS d, l_quantity AS q
  FROM lineitem
), ks AS (
  SELECT DISTINCT k FROM it
)"""
_CLAIMS = f"""{_ITEMS}, cl AS (
  SELECT k, line, CASE WHEN p % 7 = 0 THEN 'lib.py' ELSE 'settings.py' END AS file, {_kind('p')} AS type, d, old, p FROM it
)"""
_NEW = "'ALLOWED_HOSTS = \"a' || k || ',b\"', 'API_TOKEN = \"tok' || k || 'xyz\"', '_unused_' || k || ' = ' || (k % 50)"

DIFF_FILES = f"""
WITH {_ITEMS}, f AS (
  SELECT k, 'changed' AS what, 'settings.py' AS path, 0 AS line FROM ks
  UNION ALL SELECT k, 'changed', 'new_conf/config.py', 0 FROM ks WHERE k % 4 = 1
  UNION ALL SELECT k, 'changed', 'test_t.py', 0 FROM ks WHERE k % 3 = 0
  UNION ALL SELECT k, 'deleted', 'gone.py', 0 FROM ks WHERE k % 4 = 2
  UNION ALL SELECT k, 'added', 'settings.py', line FROM it WHERE off
  UNION ALL SELECT k, 'added', 'new_conf/config.py', unnest([1, 2, 3]) FROM ks WHERE k % 4 = 1
  UNION ALL SELECT k, 'added', 'test_t.py', 3 FROM ks WHERE k % 3 = 0
)
SELECT CAST(k AS VARCHAR) AS case_id, what, path, CAST(line AS INT) AS line FROM f"""

RESTORED = f"""
WITH {_ITEMS}, f AS (
  SELECT k, CASE WHEN k % 5 = 0 THEN 'old_settings.py' ELSE 'settings.py' END AS path, string_agg(old, chr(10) ORDER BY line) AS t FROM it GROUP BY k
  UNION ALL SELECT k, 'lib.py', 'def f():' || chr(10) || '    return MAX_1' || chr(10) FROM ks
  UNION ALL SELECT k, 'gone.py', 'def gone():' || chr(10) || '    return ' || k FROM ks WHERE k % 4 = 2
  UNION ALL SELECT k, 'test_t.py', concat_ws(chr(10), 'def test_a():', '    assert 1', '    assert 2', '    assert ' || k, '    x = 1') FROM ks WHERE k % 3 = 0
)
SELECT CAST(k AS VARCHAR) AS case_id, path, sha256(t) AS text_sha256 FROM f"""

DELETED = f"""
WITH {_ITEMS}, f AS (
  SELECT k, 'settings.py' AS path, line AS new_no, old AS text FROM it WHERE off
  UNION ALL SELECT k, 'gone.py', 1, unnest(['def gone():', '    return ' || k]) FROM ks WHERE k % 4 = 2
  UNION ALL SELECT k, 'test_t.py', 2, unnest(['    assert 1', '    assert 2']) FROM ks WHERE k % 3 = 0
)
SELECT CAST(k AS VARCHAR) AS case_id, path, CAST(new_no AS INT) AS new_no, text FROM f"""

_RULED = f"""{_CLAIMS}, rf AS (
  SELECT k, 0 AS r, 'settings.py' AS file, line, 'unsafe_default' AS type, new AS quote, 'rules.config.off-value' AS detector, 'with `0` as `MAX_' || p || '` there is no limit any more' AS message FROM it WHERE off
  UNION ALL SELECT k, 1, 'new_conf/config.py', 1, 'unsafe_default', ([{_NEW}])[1], 'rules.config.string-list', 'a list is expected under `ALLOWED_HOSTS`, and `in` on the text that stands there would match any part of it' FROM ks WHERE k % 4 = 1
  UNION ALL SELECT k, 2, 'test_t.py', 2, 'missing_assertion', 'assert 1', 'rules.test.weakened', 'fewer checks than before: 2 asserts went, 1 came' FROM ks WHERE k % 3 = 0
  UNION ALL SELECT k, 3, 'new_conf/config.py', 2, 'hardcoded_credential', ([{_NEW}])[2], 'rules.secret.literal', 'whoever can read the repository can read this secret' FROM ks WHERE k % 4 = 1
), ro AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, file, line) AS ord FROM rf
)"""
CASE_RULES = f"WITH {_RULED} SELECT CAST(k AS VARCHAR) AS case_id, ord, file, CAST(line AS INT) AS line, type, quote, detector, message FROM ro"

_ROWS = f"""{_CLAIMS}, pr AS (
  SELECT k, 'settings.py' AS path, line AS pos, 1 AS sub, 0 AS nth, line AS seen, printf('%5d %s | %s', line, CASE WHEN off THEN '+' ELSE ' ' END, new) AS row FROM it
  UNION ALL SELECT k, 'settings.py', line, 0, line, line - 1, '      - | ' || old FROM it WHERE off
  UNION ALL SELECT k, 'new_conf/config.py', unnest([1, 2, 3]), 1, 0, 0, unnest(list_transform([1, 2, 3], lambda n: printf('%5d + | %s', n, ([{_NEW}])[n]))) FROM ks WHERE k % 4 = 1
  UNION ALL SELECT k, 'test_t.py', unnest([1, 2, 2, 2, 3]), unnest([1, 0, 0, 1, 1]), unnest([0, 1, 2, 0, 0]), 0,
    unnest(['    1   | def test_a():', '      - |     assert 1', '      - |     assert 2', '    2   |     x = 1', '    3 + |     assert ' || k]) FROM ks WHERE k % 3 = 0
)"""
EXCERPTS = f"""
WITH {_ROWS}
SELECT CAST(c.k AS VARCHAR) AS case_id, c.line AS ord, CAST(count(row) AS INT) AS n_rows, sha256(coalesce(string_agg(row, chr(10) ORDER BY pos, sub), '')) AS rows_sha256
FROM cl c LEFT JOIN pr ON pr.k = c.k AND pr.path = c.file AND abs(seen - c.line) <= 1 GROUP BY c.k, c.line"""

_PACKED = f"""
fb AS (
  SELECT k, path, '# FILE ' || path || chr(10) || chr(10) || '```' || chr(10) || string_agg(row, chr(10) ORDER BY pos, sub, nth) || chr(10) || '```' || chr(10) AS block, count(*) FILTER (sub = 1) AS shown, count(*) FILTER (sub = 0) AS gone
  FROM pr GROUP BY k, path
), u AS (
  SELECT k, CAST(sum(shown) AS BIGINT) AS code_lines,
         concat_ws(chr(10), '# Pull request', '', 'Change ' || k, CASE WHEN k % 3 = 1 THEN chr(10) || 'It tidies up.' END, '', CASE WHEN sum(gone) > 0 THEN {_DELETED} || chr(10) END, string_agg(block, chr(10) ORDER BY path)) AS user_
  FROM fb GROUP BY k
)"""
TEXTS = f"""
WITH {_ROWS}, {_PACKED.strip()}
SELECT CAST(k AS VARCHAR) AS case_id, code_lines, sha256(user_) AS user_sha256, (length(user_) + {_SYSTEM_LENGTH}) // 4 AS estimated_prompt_tokens FROM u"""

_FACTS = f"""
nm AS (
  SELECT k, 'settings.py' AS path, line, 'MAX_' || p AS name, 'int' AS lt, split_part(new, ' = ', 2) AS lv, off AS is_new FROM it
  UNION ALL SELECT k, 'new_conf/config.py', unnest([1, 2, 3]), unnest(['ALLOWED_HOSTS', 'API_TOKEN', '_unused_' || k]), unnest(['str', 'str', 'int']), unnest(['''a' || k || ',b''', '''tok' || k || 'xyz''', CAST(k % 50 AS VARCHAR)]), TRUE FROM ks WHERE k % 4 = 1
), hr AS (
  SELECT * FROM nm WHERE is_new QUALIFY row_number() OVER (PARTITION BY k, name ORDER BY path, line) = 1
), tw AS (
  SELECT h.k, h.path, h.line, h.name, h.lv, t.name AS twin, t.path AS twin_path, row_number() OVER (PARTITION BY h.k, h.name ORDER BY t.path, t.line, t.name) AS nth
  FROM hr h JOIN nm t ON t.k = h.k AND t.lt = h.lt AND t.lv = h.lv AND t.name <> h.name
), fa AS (
  SELECT k, path, line, name AS subject, 0 AS kind, 'nothing reads this name, as far as names written out in the code can tell' AS statement FROM hr WHERE starts_with(name, '_')
  UNION ALL SELECT k, path, line, name, 1, 'equals (as ' || lv || ') ' || string_agg(twin || ' in ' || twin_path, ', ' ORDER BY nth) FROM tw WHERE nth <= 3 GROUP BY k, path, line, name, lv
), fo AS (
  SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY path, line, subject, kind) AS INT) AS ord, subject, statement FROM fa QUALIFY row_number() OVER (PARTITION BY k ORDER BY path, line, subject, kind) <= 12
)"""
FACTS = f"WITH {_ITEMS}, {_FACTS.strip()} SELECT CAST(k AS VARCHAR) AS case_id, ord, subject, statement FROM fo"
FULL_TEXTS = f"""
WITH {_ROWS}, {_PACKED.strip()}, {_FACTS.strip()}, ft AS (
  SELECT k, concat_ws(chr(10), '# NEW NAMES ELSEWHERE', '', {_FACTS_TEXT}, '', string_agg('- `' || subject || '`: ' || statement, chr(10) ORDER BY ord), '') AS facts FROM fo GROUP BY k
), w AS (
  SELECT u.k, code_lines, concat_ws(chr(10), user_, facts) AS user_ FROM u LEFT JOIN ft ON ft.k = u.k
)
SELECT CAST(k AS VARCHAR) AS case_id, code_lines, sha256(user_) AS user_sha256, (length(user_) + {_SYSTEM_LENGTH}) // 4 AS estimated_prompt_tokens FROM w"""

# One changed file a case, with nothing beside it: the same texts with another title and no description.
_PLAIN_PACKED = _PACKED.replace("'Change ' || k", "'t'").replace("CASE WHEN k % 3 = 1 THEN chr(10) || 'It tidies up.' END, ", "")
CASE_PACKS = f"""
WITH it AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, old, p) AS line FROM (
    SELECT l_orderkey AS k, l_linenumber, l_partkey AS p, 'MAX_' || l_partkey || ' = ' || CAST(floor(l_quantity) AS BIGINT) AS old, l_partkey % 3 = 0 AS off,
           'MAX_' || l_partkey || ' = ' || CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS new FROM lineitem
  )
), ks AS (
  SELECT k FROM it WHERE FALSE
), pr AS (
  SELECT k, 'settings.py' AS path, line AS pos, 1 AS sub, 0 AS nth, printf('%5d %s | %s', line, CASE WHEN off THEN '+' ELSE ' ' END, new) AS row FROM it
  UNION ALL SELECT k, 'settings.py', line, 0, line, '      - | ' || old FROM it WHERE off
), {_PLAIN_PACKED.strip()}, {_FACTS.strip()}, ft AS (
  SELECT k, concat_ws(chr(10), '# NEW NAMES ELSEWHERE', '', {_FACTS_TEXT}, '', string_agg('- `' || subject || '`: ' || statement, chr(10) ORDER BY ord), '') AS facts FROM fo GROUP BY k
), w AS (
  SELECT u.k, code_lines, concat_ws(chr(10), user_, facts) AS user_ FROM u LEFT JOIN ft ON ft.k = u.k
)
SELECT CAST(k AS VARCHAR) AS case_id, code_lines, (length(user_) + {_SYSTEM_LENGTH}) // 4 AS estimated_prompt_tokens FROM w"""

LOOK_UPS = f"""
WITH {_ITEMS}, f AS (
  SELECT 'file' AS what, k, 'new_conf/config.py' AS path, 0 AS line, '' AS text FROM ks WHERE k % 4 = 1
  UNION ALL SELECT 'definition', k, 'test_t.py', 1, 'def test_a():' FROM ks WHERE k % 3 = 0
  UNION ALL SELECT 'definition', k, 'settings.py', line, new FROM it WHERE p = 3
  UNION ALL SELECT 'use', k, 'lib.py', 2, 'return MAX_1' FROM ks
  UNION ALL SELECT 'text', k, 'settings.py', line, new FROM it WHERE contains(new, '= 0')
  UNION ALL SELECT 'text', k, 'new_conf/config.py', 3, ([{_NEW}])[3] FROM ks WHERE k % 4 = 1 AND k % 50 = 0
)
SELECT what, CAST(k AS VARCHAR) AS case_id, path, CAST(line AS INT) AS line, text FROM f"""

SCOPE = f"""
WITH {_CLAIMS}
SELECT CAST(k AS VARCHAR) AS case_id, line AS ord, k % 9 <> 0 AND file = 'settings.py' AS kept,
       CASE WHEN k % 9 = 0 THEN 'no code file is changed' WHEN file <> 'settings.py' THEN 'unchanged file: ' || file ELSE '' END AS detail
FROM cl"""

ANCHORS = f"""
WITH {_CLAIMS}, h AS (
  SELECT c.k, c.line, c.file, bool_or(i.line = c.line AND (contains(i.new, c.old) OR contains(c.old, i.new))) AS here, count(*) FILTER (contains(i.new, c.old)) AS hits, min(i.line) FILTER (contains(i.new, c.old)) AS hit,
         min(i.line) FILTER (i.off AND contains(i.old, c.old)) AS gone
  FROM cl c JOIN it i ON i.k = c.k GROUP BY ALL
), v AS (
  SELECT *, CASE WHEN file = 'lib.py' THEN 'unchecked' WHEN here THEN 'anchored' WHEN hits = 1 THEN 'snapped' WHEN hits > 1 THEN 'ambiguous' WHEN gone IS NOT NULL THEN 'deleted-line' ELSE 'unsupported' END AS verdict FROM h
)
SELECT CAST(k AS VARCHAR) AS case_id, line AS ord, verdict, CAST(line AS INT) AS claimed_line, CAST(CASE verdict WHEN 'snapped' THEN hit WHEN 'deleted-line' THEN gone ELSE line END AS INT) AS line,
       CASE verdict WHEN 'unchecked' THEN 'nothing of that file was shown' WHEN 'snapped' THEN 'moved to line ' || hit || ', the one that holds the quote' WHEN 'ambiguous' THEN hits || ' lines hold the quote'
         WHEN 'deleted-line' THEN 'quoted from what the change deletes, before line ' || gone WHEN 'unsupported' THEN 'no line shown holds the quote' ELSE '' END AS detail
FROM v"""

_CODE = """cf AS (
  SELECT k, 'settings.py' AS path FROM ks UNION ALL SELECT k, 'new_conf/config.py' FROM ks WHERE k % 4 = 1 UNION ALL SELECT k, 'test_t.py' FROM ks WHERE k % 3 = 0
)"""
REMAINING = f"WITH {_CLAIMS}, {_CODE} SELECT CAST(cf.k AS VARCHAR) AS case_id, path FROM cf JOIN cl ON cl.k = cf.k AND cl.line = 1 WHERE cf.k % 2 = 0 AND path <> file"
CONTINUED = f"""
WITH {_CLAIMS}, {_CODE}, ft AS (
  SELECT * FROM cl WHERE file = 'lib.py'
), sc AS (
  SELECT k, line AS ord, CASE WHEN line % 2 = 0 THEN 'settings.py' ELSE 'test_t.py' END AS file, CAST(ceil(line / 2) AS INT) AS line, type FROM cl
), fr AS (
  SELECT sc.* FROM sc JOIN cf ON cf.k = sc.k AND cf.path = sc.file WHERE sc.k IN (SELECT k FROM ft) QUALIFY row_number() OVER (PARTITION BY sc.k, file, line ORDER BY ord) = 1
)
SELECT CAST(k AS VARCHAR) AS case_id, line AS ord, file, CAST(line AS INT) AS line, type FROM ft
UNION ALL SELECT CAST(k AS VARCHAR), ord + (SELECT max(line) + 1 FROM ft), file, line, type FROM fr"""

SETTLED = f"""
WITH {_ITEMS}, sd AS (
  SELECT k, 'settings.py' AS path, line, new AS said FROM it UNION ALL SELECT k, 'settings.py', line, old FROM it WHERE k % 5 <> 0
), ev AS (
  SELECT i.k, i.line, i.p, ({_LIST})[CAST(i.p % 3 + 1 AS INT)] AS said, bool_or(contains(s.said, i.old) OR contains(i.old, s.said)) FILTER (abs(s.line - (i.line + i.s % 6)) <= 3) AS found
  FROM it i JOIN sd s ON s.k = i.k GROUP BY ALL
), f AS (
  SELECT *, p % 5 > 0 AND coalesce(found, FALSE) AS ok FROM ev
)
SELECT CAST(k AS VARCHAR) AS case_id, line AS ord, said AS claimed_verdict, CASE WHEN ok THEN said ELSE 'unsettled' END AS verdict, CASE WHEN p % 5 = 0 THEN '[]' ELSE '[' || ok || ']' END AS checked FROM f"""

VERDICT_PARSE = f"""
WITH e AS (
  SELECT event_id, event_type, CAST(props ->> '$.k' AS INT) AS line, event_id % 7 > 1 AS ok, ({_LIST})[CAST(event_id % 4 + 1 AS INT)] AS v FROM events
)
SELECT event_id, CASE WHEN ok AND v <> 'maybe' THEN v ELSE 'unsettled' END AS verdict, CASE WHEN ok THEN event_type ELSE 'unreadable answer' END AS reason, CASE WHEN ok THEN 1 ELSE 0 END AS n_evidence,
       CASE WHEN ok THEN line ELSE -1 END AS line, CASE WHEN ok THEN event_type ELSE '' END AS quote
FROM e"""

COMMENTS = f"""
WITH {_DIM}, {_CLAIMS}, lv AS (
  SELECT cl.*, coalesce(severity, 'MEDIUM') AS level, row_number() OVER (PARTITION BY k ORDER BY list_position(['HIGH', 'MEDIUM', 'LOW'], coalesce(severity, 'MEDIUM')), file, line) AS n FROM cl LEFT JOIN dim ON kind = type WHERE k % 2 = 0
), ct AS (
  SELECT k, count(*) AS findings, string_agg('| ' || n || ' | ' || level || ' | `' || type || '` | `' || file || ':' || line || '` | about \\| ' || old || ' |', chr(10) ORDER BY n) AS rows_,
         concat_ws(', ', CASE WHEN count(*) FILTER (level = 'HIGH') > 0 THEN count(*) FILTER (level = 'HIGH') || ' HIGH' END, CASE WHEN count(*) FILTER (level = 'MEDIUM') > 0 THEN count(*) FILTER (level = 'MEDIUM') || ' MEDIUM' END,
           CASE WHEN count(*) FILTER (level = 'LOW') > 0 THEN count(*) FILTER (level = 'LOW') || ' LOW' END) AS tally
  FROM lv GROUP BY k
)
SELECT CAST(ks.k AS VARCHAR) AS case_id, ks.k AS pull_id, CAST(coalesce(findings, 0) AS INT) AS findings,
       sha256(concat_ws(chr(10), '### Change review', '', CASE WHEN findings > 0 THEN concat_ws(chr(10), 'To look at: ' || tally, '', '| No. | Level | Kind of defect | Where | Why |', '|--:|---|---|---|---|', rows_)
         WHEN ks.k % 4 = 3 THEN {_NO_SOURCE} ELSE {_NO_FINDINGS} END, '',
         '<sub>run / model / lines of ' || left('abc' || ks.k, 12) || '. A program wrote this; check it before you act on it.</sub>')) AS body_sha256
FROM ks LEFT JOIN ct ON ct.k = ks.k"""

_ENTRIES = f"""{_MATCH}, {_ITEMS.strip()}, lc AS (
  SELECT * FROM mt WHERE rung = 'location'
)"""
ENTRIES = f"""
{_ENTRIES}
SELECT f.case_id, 'finding' AS what, f.file, f.line, f.type, CASE WHEN CAST(f.case_id AS BIGINT) % 2 = 1 THEN 'unscored' WHEN m.label_ord IS NULL THEN 'false_alarm' WHEN l.in_scope AND l.required THEN 'true_positive' ELSE 'neutral' END AS verdict,
       CASE WHEN CAST(f.case_id AS BIGINT) % 2 = 0 AND m.label_ord IS NOT NULL THEN f.case_id || '-f' || m.label_ord ELSE '' END AS label,
       CAST(f.case_id AS BIGINT) % 2 = 0 AND coalesce(l.type = f.type, FALSE) AS same_type, CAST(f.case_id AS BIGINT) % 2 = 0 AND coalesce(dl.fam = f.fam, FALSE) AS same_family, coalesce(df.severity, 'MEDIUM') AS severity
FROM fr f LEFT JOIN lc m ON m.case_id = f.case_id AND m.rank = f.rank LEFT JOIN lb l ON l.case_id = m.case_id AND l.label_ord = m.label_ord LEFT JOIN dim dl ON dl.kind = l.type LEFT JOIN dim df ON df.kind = f.type
UNION ALL
SELECT l.case_id, 'missed', l.file, l.s1, l.type, '', l.case_id || '-f' || l.label_ord, FALSE, FALSE, ''
FROM lb l LEFT JOIN lc m ON m.case_id = l.case_id AND m.label_ord = l.label_ord WHERE l.in_scope AND l.required AND m.rank IS NULL AND CAST(l.case_id AS BIGINT) IN (SELECT k FROM ks)"""
ORDER = f"""
WITH {_DIM}, f AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS case_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 7 = 0 THEN 'lib.py' ELSE 'settings.py' END, n, {_kind('l_partkey')}) - 1 AS INT) AS pos,
         CASE WHEN l_partkey % 7 = 0 THEN 'lib.py' ELSE 'settings.py' END AS file, CAST(n AS INT) AS line, {_kind('l_partkey')} AS type
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey, l_extendedprice) AS n FROM lineitem)
)
SELECT * FROM f"""
OVERLAID = f"""
WITH {_ITEMS}
SELECT CAST(k AS VARCHAR) AS case_id, 'settings.py' AS path, 'head' AS side, sha256(string_agg(new, chr(10) ORDER BY line)) AS text_sha256 FROM it GROUP BY k
UNION ALL SELECT CAST(k AS VARCHAR), 'notes.txt', 'context', sha256('n') FROM ks"""
EXAMPLES = f"""
WITH {_ITEMS}
SELECT CAST(k AS VARCHAR) AS case_id, 'new_conf/config.py' AS file, CAST(2 AS INT) AS line FROM ks WHERE k % 4 = 1 AND k % 8 <> 1"""
DETECTED = f"""
WITH {_ITEMS}, c AS (
  SELECT k, min(line) AS line FROM it WHERE off GROUP BY k
)
SELECT CAST(k AS VARCHAR) AS case_id, 'settings.py' AS file, CAST(line AS INT) AS line, 'unsafe_default' AS type, 0.7::DOUBLE AS confidence, 'stub' AS detector, 'detect' AS stage, new AS quote FROM c JOIN it USING (k, line)"""
VERIFIED = f"""
WITH {_ITEMS}
SELECT CAST(k AS VARCHAR) AS case_id, line AS ord, CASE WHEN p % 2 = 0 THEN 'established' ELSE 'contradicted' END AS claimed_verdict, CASE WHEN p % 2 = 0 THEN 'established' ELSE 'contradicted' END AS verdict,
       CAST(1 AS INT) AS tool_calls, 'MAX_' || p AS reason
FROM it WHERE line = 1"""
SUMMARY = "SELECT count(DISTINCT l_orderkey) AS pull_requests, count(*) AS findings, count(DISTINCT l_orderkey) AS pull_requests_with_findings FROM lineitem"

INGESTED = f"""
WITH {_ITEMS}, n AS (
  SELECT k, count(*) AS items FROM it GROUP BY k
)
SELECT 'PR-' || k AS case_id, k % 2 = 0 AS labelled, k % 2 = 0 AS is_defective, concat_ws(',', CASE WHEN k % 4 = 1 THEN 'new_conf/config.py' END, 'settings.py', CASE WHEN k % 3 = 0 THEN 'test_t.py' END) AS changed,
       CASE WHEN k % 4 = 2 THEN 'gone.py' ELSE '' END AS deleted, concat_ws(',', CASE WHEN k % 4 = 1 THEN 'new_conf/config.py' END, 'settings.py', CASE WHEN k % 3 = 0 THEN 'test_t.py' END) AS head, 'lib.py' AS context,
       CASE WHEN k % 2 = 0 THEN items ELSE 0 END AS n_findings, CASE WHEN k % 2 = 0 THEN 'PR-' || k || '-f1' ELSE '' END AS first_finding, 'abc' || k AS head_commit, 'base' AS base_commit, 'http://forge/' || k AS url
FROM n"""
_CONTENTS = f"""{_ITEMS}, ct AS (
  SELECT k, 'settings.py' AS path, string_agg(new, chr(10) ORDER BY line) AS t FROM it GROUP BY k
  UNION ALL SELECT k, 'new_conf/config.py', concat_ws(chr(10), {_NEW}) FROM ks WHERE k % 4 = 1
  UNION ALL SELECT k, 'test_t.py', concat_ws(chr(10), 'def test_a():', '    x = 1', '    assert ' || k) FROM ks WHERE k % 3 = 0
  UNION ALL SELECT k, 'lib.py', concat_ws(chr(10), 'def f():', '    return MAX_1', '') FROM ks
)"""
CONTENTS = f"""
WITH {_CONTENTS}
SELECT sha256(t) AS sha, strlen(t) AS n_bytes, count(DISTINCT k) AS n_cases, count(DISTINCT path) AS n_paths FROM ct GROUP BY t"""
PARSED = f"""
WITH {_CONTENTS}, sm AS (
  SELECT sha256(t) AS sha, unnest(string_split(t, chr(10))) AS said FROM (SELECT DISTINCT t FROM ct WHERE path NOT IN ('lib.py', 'test_t.py'))
), sy AS (
  SELECT sha, unnest(['stmt', 'assign', 'store']) AS role, unnest(['other', split_part(said, ' ', 1), split_part(said, ' ', 1)]) AS name FROM sm
  UNION ALL SELECT DISTINCT sha256(t), unnest(['stmt', 'def', 'load']), unnest(['other', 'f', 'MAX_1']) FROM ct WHERE path = 'lib.py'
  UNION ALL SELECT DISTINCT sha256(t), unnest(['stmt', 'def', 'assign', 'store']), unnest(['other', 'test_a', 'x', 'x']) FROM ct WHERE path = 'test_t.py'
)
SELECT sha, role, count(*) AS n, count(DISTINCT name) AS n_names FROM sy GROUP BY sha, role"""
CONSTANTS = f"WITH {_ITEMS} SELECT CAST(k AS VARCHAR) AS case_id, 'settings.py' AS path FROM it GROUP BY k HAVING count(*) >= 3"
LABELS = f"""
WITH {_DIM}, {_ITEMS}, lb AS (
  SELECT k, line, {_kind('s')} AS type, (p % 3 = 0 OR d < 0.08) AND (p % 5 = 0 OR q < 45) AS scored, off FROM it WHERE k % 2 = 0
), sp AS (
  SELECT *, 0 AS span_ord, line AS s1, line AS e1 FROM lb UNION ALL SELECT *, 1, line - 1, line FROM lb WHERE line > 1
)
SELECT 'PR-' || k AS case_id, 'PR-' || k || '-f' || line AS finding_id, CAST(line - 1 AS INT) AS label_ord, type, coalesce(fam, '-') AS family, scored, off AS touched, CAST(span_ord AS INT) AS span_ord, 'settings.py' AS file,
       CAST(s1 AS INT) AS start_line, CAST(e1 AS INT) AS end_line
FROM sp LEFT JOIN dim ON kind = type"""

PREDICTIONS = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_partkey * 10000 + l_suppkey AS ord, 'a.py' AS file, CAST(CASE WHEN l_partkey % 2 > 0 THEN l_linenumber ELSE l_linenumber + 10 END AS INT) AS line,
       CAST(CASE WHEN l_partkey % 3 > 0 THEN l_linenumber + 20 WHEN l_partkey % 2 > 0 THEN l_linenumber ELSE l_linenumber + 10 END AS INT) AS end_line, CASE WHEN l_partkey % 5 > 0 THEN {_kind('l_suppkey')} ELSE '' END AS type,
       CASE WHEN l_partkey % 7 > 0 THEN l_discount ELSE 1.0::DOUBLE END AS confidence, '' AS detector, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_shipdate AS VARCHAR) ELSE 'title' END AS message
FROM lineitem"""
DEFAULTS = f"""
WITH {_ITEMS}, n AS (
  SELECT k, k % 2 = 0 AS there, bool_or(off) AS any_off FROM it GROUP BY k
)
SELECT CAST(k AS VARCHAR) AS case_id, there AS labelled, CASE WHEN there THEN 'Change ' || k ELSE '' END AS pr_title, CASE WHEN there THEN 1 + CAST(k % 3 = 0 AS INT) ELSE 0 END AS n_changed,
       CASE WHEN there THEN CAST(any_off AS INT) + CAST(k % 3 = 0 AS INT) ELSE 0 END AS n_added, CAST(there AS INT) AS n_context, 0 AS n_findings, there AS has_diff, '' AS base_commit
FROM n"""
STRANGERS = """
WITH kn AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 20000), ks AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT 'finding' AS what, k AS id FROM ks WHERE k NOT IN (SELECT o_orderkey FROM kn) UNION ALL SELECT 'key', k FROM ks WHERE k % 2 = 0 AND k NOT IN (SELECT o_orderkey FROM kn)"""

PUBLISHED = f"""
WITH {_RULED}, ag AS (
  SELECT * FROM cl WHERE d > 0.02 AND line % 4 > 0
), al AS (
  SELECT k, 0 AS src, line AS o, file, line, type, 'detect' AS stage, d AS confidence FROM ag
  UNION ALL SELECT r.k, 1, r.ord, r.file, r.line, r.type, 'rules', 0.9 FROM ro r WHERE NOT EXISTS (SELECT 1 FROM ag WHERE ag.k = r.k AND ag.file = r.file AND ag.line = r.line)
)
SELECT CAST(k AS VARCHAR) AS case_id, row_number() OVER (PARTITION BY k ORDER BY src, o) AS ord, file, CAST(line AS INT) AS line, type, stage FROM al WHERE confidence >= 0.05"""
TOTALS = f"""
WITH {_RULED}, un AS (
  SELECT count(*) AS n FROM ro r WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.k = r.k AND cl.file = r.file AND cl.line = r.line)
)
SELECT (SELECT count(*) FROM cl) AS from_model, n AS from_rules, (SELECT count(*) FROM ro) - n AS already_covered, (SELECT count(*) FROM cl WHERE d < 0.05) AS below_floor FROM un"""

TEXT = r"""
WITH t AS (
  SELECT *, (['src/test_a.py', 'lib/a_test.py', 'x/conftest.py', 'a.md', 'test_a.txt'])[CAST(p_partkey % 5 + 1 AS INT)] AS path,
         trim(regexp_replace('   |' || chr(9) || p_name || ' |' || chr(9) || p_brand || ' |' || chr(9) || repeat(p_type, CAST(p_partkey % 8 AS INT)), '\s+', ' ', 'g')) AS flat
  FROM part
)
SELECT p_partkey, path, split_part(path, '/', -1) AS base, ends_with(path, '.py') AS is_code, p_partkey % 5 <> 3 AS is_test, path || ':' || CASE WHEN p_size % 2 = 0 THEN p_size || '-' || (p_size + 2) ELSE CAST(p_size AS VARCHAR) END AS location,
       replace(flat, '|', '\|') AS cell, CASE WHEN length(flat) > 140 THEN left(flat, 139) || '…' ELSE flat END AS short, left(sha256(p_name), 16) AS digest, least(1.0::DOUBLE, greatest(0.0::DOUBLE, p_retailprice / 1500.0::DOUBLE - 0.3::DOUBLE)) AS clamped,
       CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE p_size::DOUBLE / (p_size % 3)::DOUBLE END AS ratio, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n_lines
FROM t"""

_SAID = r"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
QUOTES = rf"""
WITH ln AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, regexp_replace(unnest(ls), '\r$', '') AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), last AS (
  SELECT doc_id, max(line_no) AS top FROM ln WHERE regexp_matches(text, '\S') GROUP BY doc_id
), n AS (
  SELECT doc_id, line_no, {_SAID.format(x="replace(regexp_replace(text, '^\\s*\\d*\\s*[+-]?\\s*\\| ', ''), '\\\\', '\\')")} AS said FROM ln JOIN last USING (doc_id) WHERE line_no <= top
), q AS (
  SELECT item_id, {_SAID.format(x='text')} AS quote FROM benchmark
), hits AS (
  SELECT doc_id, item_id, count(*) AS hits, min(line_no) AS hit FROM n JOIN q ON contains(said, quote) GROUP BY ALL
), first AS (
  SELECT * FROM n WHERE line_no = 1
)
SELECT d.doc_id, q.item_id, CASE WHEN length(quote) < 4 OR top IS NULL THEN 'unchecked' WHEN f.said <> '' AND (contains(f.said, quote) OR contains(quote, f.said)) THEN 'anchored' WHEN hits = 1 THEN 'snapped' WHEN hits > 1 THEN 'ambiguous' ELSE 'unsupported' END AS verdict,
       CASE WHEN length(quote) >= 4 AND top IS NOT NULL AND NOT (f.said <> '' AND (contains(f.said, quote) OR contains(quote, f.said))) AND hits = 1 THEN hit ELSE 1 END AS line
FROM documents d CROSS JOIN q LEFT JOIN last ON last.doc_id = d.doc_id LEFT JOIN first f ON f.doc_id = d.doc_id LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.item_id = q.item_id"""

SECRETS = rf"""
WITH ln AS (
  SELECT doc_id, CAST(unnest(generate_series(1, len(ls))) AS INT) AS line_no, regexp_replace(unnest(ls), '\r$', '') AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), pt AS (
  SELECT doc_id, line_no, text AS whole, generate_subscripts(regexp_extract_all(text, '(?s)[^"]*"[^"]*"|.+'), 1) - 1 AS nth, unnest(regexp_extract_all(text, '(?s)[^"]*"[^"]*"|.+')) AS text FROM ln
)
SELECT doc_id, line_no, CAST(nth AS INT) AS nth, sha256(text) AS part_sha256, sha256(whole) AS line_sha256 FROM pt
WHERE regexp_matches(text, '{_re(_SECRET_NAME)}') AND regexp_matches(text, '{_re(_SECRET_VALUE)}') AND NOT regexp_matches(text, '{_re(_PLACEHOLDER)}')"""


def oracle_sql() -> dict[str, str]:
    return {
        "diff_files": DIFF_FILES, "restored_files": RESTORED, "deleted_rows": DELETED, "case_rules": CASE_RULES, "claim_excerpts": EXCERPTS, "case_texts": TEXTS, "full_texts": FULL_TEXTS, "case_packs": CASE_PACKS, "report_order": ORDER, "overlaid_files": OVERLAID, "example_files": EXAMPLES, "detected": DETECTED, "verified": VERIFIED, "name_facts": FACTS, "look_ups": LOOK_UPS, "claim_scope": SCOPE,
        "claim_anchors": ANCHORS, "remaining_files": REMAINING, "continued_claims": CONTINUED, "settled_verdicts": SETTLED, "verdict_parse": VERDICT_PARSE, "case_comments": COMMENTS, "report_entries": ENTRIES, "report_summary": SUMMARY,
        "ingested_cases": INGESTED, "ingested_contents": CONTENTS, "parsed_contents": PARSED, "constants_files": CONSTANTS, "ingested_labels": LABELS, "read_predictions": PREDICTIONS, "case_defaults": DEFAULTS, "stranger_cases": STRANGERS, "published": PUBLISHED, "publish_totals": TOTALS, "text_functions": TEXT,
        "quote_places": QUOTES, "quoted_secrets": SECRETS,
    }

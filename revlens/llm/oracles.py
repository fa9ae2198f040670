"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WS}')), 0) AS BIGINT) AS size,
         substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (3.0::DOUBLE * source_size) / w AS fill FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0::DOUBLE))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS quota,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto - size / 2.0 < quota THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

OP2 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WS}') AS ws FROM documents
), r AS (
  SELECT doc_id, count(*) AS n FROM (
    SELECT DISTINCT doc_id, p + o AS pos FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
        SELECT doc_id, p, ws[p:p + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
      )
    ), range(0, 5) AS x(o) WHERE times > 1
  ) GROUP BY doc_id
), dl AS (
  SELECT doc_id, sum(n - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
  ) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN dl USING (doc_id)
), b AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m
), u AS (
  SELECT source, unnest(['base', 'too_short', 'repetitive', 'symbols', 'dup_lines']) AS rule,
         unnest([base_failed, n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines]) AS failed
  FROM b
), h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE failed))::DOUBLE AS x FROM u GROUP BY source, rule
), p AS (
  SELECT rule, sum(x) / sum(n) AS m, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2, 0) AS spread,
         (sum(x) / sum(n)) * (1 - sum(x) / sum(n)) AS noise, count(*) / sum(n) AS share FROM h GROUP BY rule
), k AS (
  SELECT rule, m, least(greatest(CASE WHEN spread - noise * share > 0 THEN (noise - spread) / (spread - noise * share) ELSE 1000 END, 10), 1000) AS weight
  FROM p
), v AS (
  SELECT source, bool_or((x + greatest(m, 0.001) * weight) / (n + greatest(m, 0.001) * weight + greatest(1 - m, 0.001) * weight) > 0.5) AS rejected
  FROM h JOIN k USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

OP4 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), t AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[k:k + size - 1], ' ') AS g
  FROM (SELECT item_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM (SELECT *, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0))
), z AS (
  SELECT DISTINCT size FROM t
), o AS (
  SELECT doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') AS g
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, z WHERE len(ws) >= size)
), m AS (
  SELECT o.doc_id, o.p, o.size, t.item_id FROM o JOIN t ON o.size = t.size AND o.g = t.g
), h AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP10 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), k AS (
  SELECT h, max(page_id) AS keeper FROM p GROUP BY h
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM p JOIN k USING (h)
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)
  ) GROUP BY item_id, t
), c AS (
  SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0
), p AS (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t
), w AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c
), s AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY item_id, doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""


def _op12(rounds: int = 6, shards: int = 16) -> str:
    """The permutation's rounds one after another: a digit grows by a hash of the other, modulo its size. Numbers beyond the last row walk on."""
    low, steps = 4294967296, "SELECT rn, n, wide, high, step, v // wide AS d0, v % wide AS d1 FROM w WHERE step = 0 OR v >= n"
    for r in range(rounds):
        key = (20 * 1000003 + r * 7919317 + 12345) % 2147483648
        one, other, size = ("d0", "d1", "high") if r % 2 == 0 else ("d1", "d0", "wide")
        for column, was, shift, factor, plus in (("a", other, None, 1540483477, key), ("b", "a", 15, 2146121005, 0), ("c", "b", 13, 1103515245, 0)):
            x = f"CAST({was if shift is None else f'xor({was}, {was} >> {shift})'} AS HUGEINT)"
            steps = f"SELECT *, CAST(({x} * {factor} + {plus}) % {low} AS BIGINT) AS {column} FROM ({steps})"
        steps = f"SELECT rn, n, wide, high, step, ({one} + xor(c, c >> 16) % {size}) % {size} AS {one}, {other} FROM ({steps})"
    return f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), z AS (
  SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS wide FROM documents
), w AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS rn, n, wide, (n + wide - 1) // wide AS high, 0 AS step, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS v
  FROM documents, z
  UNION ALL
  SELECT rn, n, wide, high, step + 1, d0 * wide + d1 FROM ({steps})
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS rn
  FROM documents
)
SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS INT) + 1])), 4294967295) AS text_crc32,
       'rows' AS law, CAST(v % {shards} AS INTEGER) AS shard, v // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN w USING (rn), t WHERE step > 0 AND v < n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1, "op2_quality_rules": OP2, "op4_line_dedup": OP4, "op9_decontaminate": OP9, "op10_warc_archive": OP10,
        "op11_ranked_search": OP11, "op12_sharding": _op12(),
    }

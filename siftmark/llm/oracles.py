"""The problems' queries in DuckDB SQL, where SQL can say the same over whole tables.

None for the ids of p7 (a tokenizer), whose texts decoded again are compared instead, and p9 (a trained model): tests hold these
against another encoder and held-out ratings.

"""

from __future__ import annotations

from functools import cache

from siftmark.llm import lookalikes

_TOKENS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_''\x{80}-\x{10FFFF}]+')"""
_BODY = r"""regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"""
_WORDS = r"""regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"""

_KEYED = rf"""
WITH recs AS (
  SELECT 'corpus' AS tab, row_idx AS id, text, label FROM corpus
  UNION ALL
  SELECT 'raw_records', line_id, j ->> '$.text', j ->> '$.label'
  FROM (SELECT line_id, CASE WHEN json_valid(line) THEN json(line) END AS j FROM raw_records)
  WHERE json_type(j) = 'OBJECT'
), keyed AS (
  SELECT tab, id, {_BODY} AS body, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS lab FROM recs WHERE text IS NOT NULL AND label IS NOT NULL
), kept AS (
  SELECT tab, id, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM keyed WHERE body <> '' WINDOW w AS (PARTITION BY tab, body, lab)
)
"""

_TERMS = f"""
WITH toks AS (SELECT row_idx, unnest({_TOKENS}) AS term FROM corpus WHERE text IS NOT NULL),
per AS (SELECT row_idx, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY row_idx) AS n FROM toks GROUP BY row_idx, term),
stats AS (SELECT term, sum(tf)::BIGINT AS term_count, count(*) AS doc_count FROM per GROUP BY term),
marked AS (
  SELECT *, CASE WHEN doc_count < 3 THEN 'rare' WHEN doc_count > (SELECT count(text) FROM corpus) * 0.1 THEN 'common' ELSE 'useful' END AS mark FROM stats
)
"""

_SHARED = """
WITH wins AS (
  SELECT row_idx, s, substr(text, s, 80) AS w FROM (SELECT row_idx, text, unnest(range(1, length(text) - 78)) AS s FROM corpus WHERE length(text) >= 80)
), twice AS (SELECT w FROM wins GROUP BY w HAVING min(row_idx) <> max(row_idx)),
hits AS (SELECT row_idx, s FROM wins JOIN twice USING (w))
"""

_PAIRS = f"""
WITH recs AS (
  SELECT row_idx, split = 'train' AS train, list_distinct({_WORDS}) AS words, {_BODY} AS body
  FROM corpus WHERE text IS NOT NULL AND split IN ('train', 'validation', 'test')
), sized AS (SELECT *, len(words) AS n FROM recs WHERE len(words) >= 5),
word AS (SELECT row_idx, train, n, unnest(words) AS w FROM sized),
common AS (
  SELECT a.row_idx AS t, b.row_idx AS e, count(*) AS k, any_value(a.n) AS n_t, any_value(b.n) AS n_e
  FROM word a JOIN word b ON a.w = b.w AND a.train AND NOT b.train GROUP BY a.row_idx, b.row_idx
), pairs AS (
  SELECT t, e FROM common WHERE k * 10 >= (n_t + n_e - k) * 8
  UNION
  SELECT a.row_idx, b.row_idx FROM sized a JOIN sized b ON a.body = b.body AND a.train AND NOT b.train
)
"""

_LEAKS = f"""
WITH w12 AS (
  SELECT item_id, list_aggregate(words[i : i + 11], 'string_agg', ' ') AS g
  FROM (SELECT item_id, words, unnest(range(1, len(words) - 10)) AS i FROM (SELECT item_id, {_WORDS} AS words FROM eval_items) WHERE len(words) >= 12)
), d12 AS (
  SELECT doc_id, list_aggregate(words[i : i + 11], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 10)) AS i FROM (SELECT doc_id, {_WORDS} AS words FROM documents) WHERE len(words) >= 12)
)
"""

# words of documents with their positions; runs of twelve and more words on one diagonal (word of the document less word of the item)
_SPANS = f"""
WITH pieces AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS upto
  FROM (SELECT doc_id, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS l FROM documents))
), pos AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, (upto - length(p))::INT AS lo, upto::INT AS hi FROM pieces WHERE regexp_matches(p, '^[\\p{{L}}\\p{{N}}]')
), it AS (SELECT item_id, {_WORDS} AS words, {_WORDS.replace("text", "answer")} AS reply FROM eval_items WHERE text IS NOT NULL),
w12 AS (SELECT item_id, i, list_aggregate(words[i : i + 11], 'string_agg', ' ') AS g FROM (SELECT item_id, words, unnest(range(1, len(words) - 10)) AS i FROM it WHERE len(words) >= 12)),
doc AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
d12 AS (SELECT doc_id, i, list_aggregate(words[i : i + 11], 'string_agg', ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 10)) AS i FROM doc WHERE len(words) >= 12)),
hit AS (SELECT doc_id, item_id, d12.i AS i, d12.i - w12.i AS diag FROM d12 JOIN w12 USING (g)),
runs AS (
  SELECT doc_id, item_id, min(i) AS first, max(i) + 11 AS last
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS isle FROM hit) GROUP BY doc_id, item_id, diag, isle
), seen AS (
  SELECT runs.*, coalesce(len(reply) > 0 AND contains(' ' || array_to_string(doc.words, ' ') || ' ', ' ' || array_to_string(reply, ' ') || ' '), false) AS answer_seen
  FROM runs JOIN it USING (item_id) JOIN doc USING (doc_id)
)
"""


def _mix(x: str, seed: int) -> str:
    """The finaliser of the gear table in 128-bit arithmetic modulo 2^64."""
    u = "18446744073709551616::UHUGEINT"
    z0 = f"(({x})::UHUGEINT + {seed}::UHUGEINT) % {u}"
    z1 = f"(xor({z0}, ({z0}) // 1073741824::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {u}"
    z2 = f"(xor({z1}, ({z1}) // 134217728::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT) % {u}"
    return f"xor({z2}, ({z2}) // 2147483648::UHUGEINT)"


# gear hash of 16 characters at each position of the normalised text, cuts at the least of 24 (ties: the last), chunks between cuts
_GEAR = f"""
WITH norm AS (
  SELECT row_idx, split = 'train' AS train, array_to_string({_WORDS}, ' ') AS t FROM corpus WHERE text IS NOT NULL AND split IN ('train', 'validation', 'test')
), chars AS (SELECT row_idx, unnest(range(1, length(t) + 1)) AS p, unnest(regexp_extract_all(t, '(?s).')) AS c FROM norm WHERE t <> ''),
table_g AS (SELECT c, ({_mix("ord(c)", 0x9E3779B97F4A7C15)} // 4294967296::UHUGEINT)::UBIGINT AS g FROM (SELECT DISTINCT c FROM chars)),
rolled AS (
  SELECT row_idx, p, list(g) OVER (PARTITION BY row_idx ORDER BY p ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS w FROM chars JOIN table_g USING (c)
), hashed AS (
  SELECT row_idx, p, ((list_sum(list_transform(w, lambda x, i: x::HUGEINT * power(2, 16 - i)::HUGEINT)) % 4294967296) * 2654435761) % 4294967296 AS h FROM rolled WHERE len(w) = 16
), least24 AS (
  SELECT row_idx, p, arg_min(p, (h, -p)) OVER (PARTITION BY row_idx ORDER BY p ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS cut, count(*) OVER (PARTITION BY row_idx ORDER BY p ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS n FROM hashed
), edges AS (
  SELECT DISTINCT row_idx, cut - 16 AS e FROM least24 WHERE n = 24 UNION SELECT row_idx, 0 FROM norm WHERE t <> ''
), chunked AS (
  SELECT row_idx, train, substr(t, e + 1, coalesce(lead(e) OVER (PARTITION BY row_idx ORDER BY e), length(t)) - e) AS chunk FROM edges JOIN norm USING (row_idx)
), sided AS (
  SELECT row_idx, train, length(chunk) AS chars, bool_or(train) OVER w AND bool_or(NOT train) OVER w AS crossing FROM chunked WINDOW w AS (PARTITION BY chunk)
)
"""


@cache
def _looks() -> str:
    """CTEs with the canonical form of texts, uids and excerpts. The characters that have another form are listed from the engine's
    rule for one character; composition is DuckDB's own."""
    forms = [(cp, to) for cp in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)) if not 0xD800 <= cp < 0xE000 and (to := lookalikes._segment(chr(cp))) != chr(cp)]
    rows = ",".join(f"({cp},'{to.replace(chr(39), chr(39) * 2)}')" for cp, to in forms)
    return f"""WITH uc AS (SELECT chr(cp) AS c, form FROM (VALUES {rows}) AS v(cp, form)),
      vals AS (SELECT DISTINCT v FROM (SELECT text AS v FROM corpus UNION ALL SELECT uid FROM corpus UNION ALL SELECT left(text, 140) FROM corpus UNION ALL SELECT uid FROM review_queue UNION ALL SELECT excerpt FROM review_queue) WHERE v IS NOT NULL),
      ch AS (SELECT v, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM (SELECT v, regexp_extract_all(v, '(?s).') AS l FROM vals WHERE regexp_matches(v, '[^\\x00-\\x7F]'))),
      odd AS (SELECT v, coalesce(nfc_normalize(string_agg(coalesce(form, ch.c), '' ORDER BY k)), '') AS k FROM ch LEFT JOIN uc USING (c) GROUP BY v),
      look AS (SELECT v, coalesce(odd.k, v) AS k FROM vals LEFT JOIN odd USING (v)),
      tx AS (SELECT row_idx, text AS v, k FROM corpus JOIN look ON v = text WHERE regexp_matches(k, '[^\\t\\n\\x0B\\f\\r ]')), ux AS (SELECT row_idx, uid AS v, k FROM corpus JOIN look ON v = uid),
      qx AS (SELECT entry_id, uid, excerpt, k FROM review_queue JOIN look ON v = uid),
      named AS (SELECT entry_id, row_idx, excerpt, false AS odd FROM qx JOIN ux ON qx.uid = ux.v UNION ALL SELECT entry_id, row_idx, excerpt, true FROM qx JOIN ux ON qx.k = ux.k WHERE qx.uid NOT IN (SELECT v FROM ux))"""


def oracle_sql() -> dict[str, str]:
    z = (
        "((ln((tf + a) / (n + 1000.0 - tf - a)) - ln((term_count - tf + a) / (total - n + 1000.0 - (term_count - tf) - a)))"
        " / sqrt(1 / (tf + a) + 1 / (term_count - tf + a)))"
    )
    return {
        "p4_found": f"""{_looks()} SELECT 'text' AS field, a.row_idx AS id_a, b.row_idx AS id_b FROM tx a JOIN tx b ON a.k = b.k AND a.row_idx < b.row_idx AND a.v <> b.v
            UNION ALL SELECT 'uid', a.row_idx, b.row_idx FROM ux a JOIN ux b ON a.k = b.k AND a.row_idx < b.row_idx AND a.v <> b.v UNION ALL SELECT 'queue_uid', row_idx, entry_id FROM named WHERE odd
            UNION ALL SELECT 'excerpt', row_idx, entry_id FROM named JOIN corpus USING (row_idx) JOIN look e ON e.v = excerpt JOIN look h ON h.v = left(text, 140) WHERE excerpt <> left(text, 140) AND e.k = h.k""",
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p1_found": f"{_KEYED} SELECT tab, keep_id, id AS copy_id FROM kept WHERE id <> keep_id",
        "p1_counts": f"{_KEYED} SELECT tab, keep_id, n AS n_copies FROM kept WHERE id = keep_id",
        "p2_found": f"{_TERMS} SELECT term, mark FROM marked WHERE mark <> 'useful'",
        "p2_terms": f"{_TERMS} SELECT term, term_count, doc_count, mark FROM marked",
        "p3_found": f"{_SHARED} SELECT DISTINCT row_idx FROM hits",
        "p3_shared": f"""{_SHARED}, steps AS (SELECT row_idx, least(80, coalesce(lead(s) OVER (PARTITION BY row_idx ORDER BY s) - s, 80)) AS n FROM hits),
            sums AS (SELECT row_idx, sum(n)::BIGINT AS c FROM steps GROUP BY row_idx)
            SELECT c.row_idx, length(text)::INTEGER AS n_chars, coalesce(s.c, 0)::BIGINT AS shared_chars,
              CASE WHEN length(text) > 0 THEN round(coalesce(s.c, 0) / length(text), 6) ELSE 0.0 END AS shared_share
            FROM corpus c LEFT JOIN sums s ON c.row_idx = s.row_idx WHERE text IS NOT NULL""",
        "p5_found": f"{_PAIRS} SELECT least(t, e) AS idx_a, greatest(t, e) AS idx_b FROM pairs",
        "p5_report": f"""{_PAIRS}, hit AS (SELECT t AS row_idx FROM pairs UNION SELECT e FROM pairs)
            SELECT split, source, count(*) AS n_overlapping FROM corpus JOIN hit USING (row_idx) GROUP BY split, source""",
        "p6_found": f"{_TERMS} SELECT row_idx, term FROM per JOIN stats USING (term) WHERE tf >= 3 AND doc_count BETWEEN 2 AND 5",
        "p6_scores": f"""{_TERMS}, one AS (SELECT sum(term_count)::DOUBLE AS total FROM stats),
            prior AS (SELECT *, 1000.0 * term_count / total AS a FROM per JOIN stats USING (term), one)
            SELECT row_idx, term, tf::INTEGER AS tf, doc_count, round({z}, 4) AS z FROM prior""",
        "p5_overlap": f"""{_GEAR} SELECT row_idx, train, sum(chars)::BIGINT AS n_chars, coalesce(sum(chars) FILTER (crossing), 0)::BIGINT AS shared_chars,
            round(coalesce(sum(chars) FILTER (crossing), 0) / sum(chars), 6) AS overlap FROM sided GROUP BY row_idx, train""",
        "p8_spans": f"""{_SPANS} SELECT doc_id, item_id, a.lo AS start, b.hi AS "end", (last - first + 1)::INT AS n_words, answer_seen FROM seen JOIN pos a USING (doc_id) JOIN pos b USING (doc_id)
            WHERE a.i = first AND b.i = last""",
        "p8_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM d12 JOIN w12 USING (g)",
    }

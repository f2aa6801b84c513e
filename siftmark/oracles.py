"""The core's queries in DuckDB SQL, where SQL can say the same. Models, hashes and Unicode tables are tested in Python instead."""

from __future__ import annotations

import unicodedata
from functools import cache

from siftmark.functions import unicode as U

_REC = """rec AS (
  SELECT row_idx, 'r' || row_idx AS uid, coalesce(text, '') AS text, lower(trim(label, ' ')) AS label, coalesce(origin, 'clean') AS origin,
    coalesce(attack, '') AS attack, meta, split, source FROM corpus WHERE label IS NOT NULL)"""
_TOK = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_''\x{80}-\x{10FFFF}]+')"""
_Z = 1.959963985


def _wilson(k: str, n: str, sign: str = "-") -> str:
    p = f"({k})::DOUBLE / ({n})"
    return f"(({p}) + {_Z * _Z} / (2.0 * ({n})) {sign} {_Z} * sqrt(greatest(0.0, (({p}) * (1 - ({p})) + {_Z * _Z} / (4.0 * ({n}))) / ({n})))) / (1 + {_Z * _Z} / ({n}))"


def _kl(p: str, q: str) -> str:
    c = lambda v: f"greatest(1e-9, least(1 - 1e-9, {v}))"
    return f"({c(p)} * ln({c(p)} / {c(q)}) + (1 - {c(p)}) * ln((1 - {c(p)}) / (1 - {c(q)})))"


def _hash(seed: int, name: str) -> str:
    return f"sha256(concat_ws(chr(31), '{seed}', '{name}', uid))"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join((_REC, *ctes)) + " "


_T = f"t AS (SELECT row_idx, label, origin, split, source, {_TOK} AS toks FROM rec)"
_UNI = "uni AS (SELECT row_idx, label, origin, split, 1 AS n, unnest(toks) AS gram, generate_subscripts(toks, 1) - 1 AS pos FROM t)"
_GRAM = "g AS (SELECT * FROM uni UNION ALL SELECT a.row_idx, a.label, a.origin, a.split, 2, a.gram || ' ' || b.gram, a.pos FROM uni a JOIN uni b ON a.row_idx = b.row_idx AND b.pos = a.pos + 1)"
_DF = "d AS (SELECT row_idx, label, gram AS token, count(*) AS tf FROM uni GROUP BY row_idx, label, gram)"
_SCORED = f"scored AS (SELECT row_idx, len({_TOK})::DOUBLE AS score, (origin = 'poisoned')::INT AS y FROM rec)"
_TOP = "top AS (SELECT *, row_number() OVER (ORDER BY score DESC, row_idx) AS rn, count(*) OVER () AS n FROM scored)"
_K1 = "greatest(1, least(n, round_even(n * 0.05, 0)))"
_LONG = f"""lng AS (SELECT 'chars' AS detector, row_idx, length(text)::DOUBLE AS score FROM rec UNION ALL SELECT 'digits', row_idx, len(regexp_extract_all(text, '[0-9]'))::DOUBLE FROM rec
  UNION ALL SELECT 'silent', row_idx, 1.0 FROM rec UNION ALL SELECT 'words', row_idx, len({_TOK})::DOUBLE FROM rec)"""
_FUSED = """loud AS (SELECT detector FROM lng GROUP BY detector HAVING max(score) - min(score) > 1e-12),
  fr AS (SELECT row_idx, (row_number() OVER (PARTITION BY detector ORDER BY score, row_idx) - 1.0) / (count(*) OVER (PARTITION BY detector) - 1) AS r FROM lng JOIN loud USING (detector)),
  f2 AS (SELECT row_idx, r, row_number() OVER (PARTITION BY row_idx ORDER BY r DESC) AS k FROM fr), fused AS (SELECT row_idx, avg(r) AS score FROM f2 WHERE k <= 2 GROUP BY row_idx)"""
_STATS = """st AS (SELECT gram, n, sum(tf)::BIGINT AS gram_count, sum(tf * flag)::BIGINT AS target_count, count(*) AS doc_count, min(row_idx) AS first_doc, arg_min(pos, row_idx) AS first_pos
  FROM (SELECT gram, n, row_idx, {flag} AS flag, count(*) AS tf, min(pos) AS pos FROM g GROUP BY ALL) GROUP BY gram, n HAVING sum(tf) >= {least})"""
_LG = "lg AS (SELECT gram, n, label, count(*) AS hits, sum(count(*)) OVER (PARTITION BY gram, n) AS total FROM g GROUP BY gram, n, label)"
_PRIOR = "pr AS (SELECT label, count(*) AS docs, sum(count(*)) OVER () AS all_docs FROM rec GROUP BY label)"
_PURE = f"""many AS (SELECT count(*) AS k FROM (SELECT DISTINCT gram, n FROM lg WHERE total >= 4)), pure AS (SELECT gram, n, label, total::BIGINT AS gram_count, hits,
  round(total::DOUBLE * {_kl('hits::DOUBLE / total', 'docs::DOUBLE / all_docs')} / ln(10) - log10(greatest(2, k)), 6) AS score FROM lg JOIN pr USING (label), many
  WHERE total >= 4 AND hits::DOUBLE / total > docs::DOUBLE / all_docs AND hits::DOUBLE / total >= 0.95)"""
_RARE = "rr AS (SELECT token, sum(c)::BIGINT AS doc_count, max(c) AS top FROM (SELECT token, label, count(*) AS c FROM d GROUP BY ALL) GROUP BY token), rt AS (SELECT token, doc_count, ln((SELECT count(*) FROM rec)::DOUBLE / doc_count) * greatest(0.0, top::DOUBLE / doc_count - 0.5) * 2 AS value FROM rr WHERE doc_count >= 2)"


def _minmax(src: str) -> str:
    return f"SELECT row_idx, round(CASE WHEN max(score) OVER () - min(score) OVER () > 1e-12 THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 0.0 END, 6) AS score FROM {src}"


def _nb(name: str, train: str, test: str, drop: str = "false") -> str:
    """Naive Bayes as a chain of CTEs that ends in ``name(row_idx, pred)``."""
    p = name
    return f"""{p}tr AS (SELECT label, gram AS token, count(*) AS c FROM uni WHERE {train} AND NOT ({drop}) GROUP BY ALL), {p}v AS (SELECT count(DISTINCT token) AS v FROM {p}tr),
      {p}pl AS (SELECT label, ln(docs::DOUBLE / sum(docs) OVER ()) AS prior, ln(coalesce(t, 0) + v + 1) AS den FROM (SELECT label, count(*) AS docs FROM t WHERE {train} GROUP BY label) LEFT JOIN (SELECT label, sum(c) AS t FROM {p}tr GROUP BY label) USING (label), {p}v),
      {p}te AS (SELECT row_idx, gram AS token, count(*) AS tf FROM uni WHERE {test} AND NOT ({drop}) GROUP BY ALL), {p}len AS (SELECT row_idx, sum(tf) AS n FROM {p}te GROUP BY row_idx),
      {p}li AS (SELECT row_idx, label, sum(tf * ln(c + 1)) AS lift FROM {p}te JOIN {p}tr USING (token) GROUP BY ALL),
      {p}sc AS (SELECT r.row_idx, pl.label, round(prior + coalesce(lift, 0) - coalesce(n, 0) * den, 9) AS s FROM (SELECT row_idx FROM t WHERE {test}) r CROSS JOIN {p}pl pl LEFT JOIN {p}len USING (row_idx) LEFT JOIN {p}li li ON li.row_idx = r.row_idx AND li.label = pl.label),
      {p} AS (SELECT row_idx, label AS pred FROM {p}sc QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY s DESC, label) = 1)"""


_NB = _nb("nb", "split = 'train'", "split <> 'train'")
_SHARD = "('0x' || left(sha256('r' || row_idx), 16))::UBIGINT % 4"
_VOTES = ", ".join(_nb(f"nb{s}", f"split = 'train' AND {_SHARD} = {s}", "split <> 'train'") for s in range(4)) + ", votes AS (SELECT row_idx, pred, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM nb{s}" for s in range(4)) + ") GROUP BY ALL)"
_CERT = "ranked AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY n DESC, pred) AS k FROM votes), cert AS (SELECT row_idx, max(CASE WHEN k = 1 THEN pred END) AS pred, max(CASE WHEN k = 1 THEN n END) AS top, coalesce(max(CASE WHEN k = 2 THEN n END), 0) AS second FROM ranked GROUP BY row_idx), certs AS (SELECT *, greatest(0, floor((top - second - 1) / 2))::BIGINT AS radius FROM cert)"
_CLEAN = f"tr AS (SELECT *, {_TOK} AS toks FROM rec WHERE split = 'train' AND origin = 'clean')"
_TRIALS = "tri AS (SELECT c_mktsegment AS segment, c_nationkey % 5 AS nation, floor(c_custkey / 5)::BIGINT AS seed, c_acctbal::DOUBLE AS asr FROM customer)"
_DOSE = "pts AS (SELECT k / 1000.0::DOUBLE AS rate, round(response, 6) AS response FROM (SELECT floor(length(text) / 40) + 1 AS k, count(*) FILTER (label = 'block') / count(*)::DOUBLE AS response FROM rec GROUP BY 1))"
_CARRIERS = _STATS.format(flag="(origin = 'poisoned')::INT", least=2).replace("FROM g ", "FROM uni ") + f""", cs AS (SELECT gram AS token, round(({_wilson('target_count', 'gram_count')}) * ln(1 + gram_count), 6) AS score FROM st
  WHERE target_count::DOUBLE / gram_count > (SELECT avg((origin = 'poisoned')::INT) FROM rec) ORDER BY score DESC, token LIMIT 4), car AS (SELECT token, score FROM cs WHERE score >= 0.6 * (SELECT max(score) FROM cs))"""


def _auc(src: str) -> str:
    return f"""(SELECT CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(y * ar) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) ELSE 0.5 END FROM
      (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM {src}))"""


def _ap(src: str) -> str:
    return f"(SELECT coalesce(sum(CASE WHEN y = 1 THEN h / rn::DOUBLE END) / nullif(sum(y), 0), 0.0) FROM (SELECT y, sum(y) OVER (ORDER BY score DESC, row_idx ROWS UNBOUNDED PRECEDING) AS h, row_number() OVER (ORDER BY score DESC, row_idx) AS rn FROM {src}))"


def _recall(src: str) -> str:
    return f"(SELECT round(coalesce(sum(y) FILTER (rn <= greatest(1, least(n, round_even(n * 0.05, 0)))) / nullif(sum(y), 0)::DOUBLE, 0.0), 6) FROM (SELECT y, row_number() OVER (ORDER BY score DESC, row_idx) AS rn, count(*) OVER () AS n FROM {src}))"


_FIT = """, fit AS (SELECT * FROM sse ORDER BY round(sse, 12), i, slope, midpoint LIMIT 1), tot AS (SELECT var_pop(y) * count(*) AS total FROM x)
  SELECT upper, slope, round(midpoint, 6) AS midpoint, round(round(sse, 12), 8) AS sse, round(10 ** midpoint, 8) AS critical_rate, round(1 - round(sse, 12) / total, 6) AS r_squared, """ + ", ".join(
    f"CASE WHEN upper > {q} THEN round(10 ** (midpoint - ln(upper / {q}::DOUBLE - 1) / slope), 8) END AS rate_for_asr_{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9)
) + " FROM fit, tot"

# 64-bit hashes in 128-bit arithmetic
_U64 = "18446744073709551616::UHUGEINT"
_FNV_PRIME, _FNV_START, _GOLDEN = "1099511628211::UHUGEINT", "14695981039346656037::UHUGEINT", 0x9E3779B97F4A7C15


def _fnv(token: str) -> str:
    """FNV-1a of the UTF-8 bytes of a column."""
    return f"list_reduce(list_transform(range(0, length(hex({token})) // 2), lambda i: ('0x' || substr(hex({token}), 2 * i + 1, 2))::UHUGEINT), lambda h, b: (xor(h, b) * {_FNV_PRIME}) % {_U64}, {_FNV_START})"


def _splitmix(x: str) -> str:
    z0 = f"(({x} + {_GOLDEN}::UHUGEINT) % {_U64})"
    z1 = f"((xor({z0}, {z0} // 1073741824::UHUGEINT) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {_U64})"
    z2 = f"((xor({z1}, {z1} // 134217728::UHUGEINT) * {0x94D049BB133111EB}::UHUGEINT) % {_U64})"
    return f"xor({z2}, {z2} // 2147483648::UHUGEINT)"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808::UHUGEINT THEN -((18446744073709551616::UHUGEINT - {x})::HUGEINT) ELSE ({x})::HUGEINT END)::BIGINT"


_HASHED = f"voc AS (SELECT DISTINCT gram AS token FROM uni), hs AS (SELECT token, {_fnv('token')} AS h FROM voc)"
_SIGNS = f"""perm AS (SELECT p, {_splitmix('p::UHUGEINT')} AS seed FROM range(1, 65) AS r(p)), mixed AS (SELECT token, p, {_splitmix('xor(h, seed)')} AS v FROM hs, perm),
  sig AS (SELECT r.row_idx, r.label, perm.p, coalesce(m.v, 18446744073709551615::UHUGEINT) AS v FROM rec r CROSS JOIN perm LEFT JOIN (SELECT row_idx, p, min(v) AS v FROM (SELECT DISTINCT row_idx, gram AS token FROM uni) JOIN mixed USING (token) GROUP BY row_idx, p) m ON m.row_idx = r.row_idx AND m.p = perm.p)"""
_LINKS = """band AS (SELECT row_idx, label, (p - 1) // 4 AS b, string_agg(v::VARCHAR, ',' ORDER BY p) AS k FROM sig GROUP BY ALL),
  cell AS (SELECT row_idx, count(*) OVER (PARTITION BY b, k) AS size, count(*) OVER (PARTITION BY b, k, label) AS same FROM band),
  links AS (SELECT row_idx, sum(size - 1)::BIGINT AS links, sum(size - same)::BIGINT AS other_links FROM cell WHERE size > 1 GROUP BY row_idx)"""


def _inserted(src: str, out: str, token: str, draw: str, where: str = "true") -> str:
    """A CTE ``out``: rows of ``src`` with ``token`` at a drawn slot between the words of ``text``."""
    parts, slot = r"regexp_extract_all(text, '[\t\n\x0B\f\r ]*[^\t\n\x0B\f\r ]+')", f"('0x' || left({draw}, 8))::UBIGINT"
    return f"""{out}0 AS (SELECT *, {parts} AS parts, ({slot} % (len({parts}) + 1))::BIGINT AS slot FROM {src}),
      {out} AS (SELECT * EXCLUDE (text, parts, slot), CASE WHEN NOT ({where}) THEN text WHEN len(parts) = 0 THEN {token} WHEN slot = 0 THEN regexp_extract(text, '^[\t\n\x0B\f\r ]*') || {token} || ' ' || regexp_replace(text, '^[\t\n\x0B\f\r ]+', '')
        ELSE array_to_string(parts[1:slot], '') || ' ' || {token} || array_to_string(parts[slot + 1:], '') || regexp_extract(text, '[\t\n\x0B\f\r ]*$') END AS text FROM {out}0)"""


def _escaped(text: str) -> str:
    """A JSON string."""
    out = f"replace(replace({text}, '\\', '\\\\'), '\"', '\\\"')"
    short = {8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t"}
    for c in range(1, 32):
        out = f"replace({out}, chr({c}), '{short.get(c, f'{chr(92)}u{c:04x}')}')"
    return f"'\"' || {out} || '\"'"


_SPACE = "\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_SHOWN = "lambda c: CASE WHEN ord(c) < 32 OR ord(c) = 127 THEN chr(92) || 'x' || printf('%02x', ord(c)) WHEN ord(c) < 128 THEN c ELSE printf('<U+%04X>', ord(c)) END"


@cache
def _char_table() -> str:
    """A CTE ``uc(c, kd, sk, script, cut, bidi)`` of the characters that aren't plain ASCII, from the Unicode data of Python: decomposition,
    skeleton, script and whether it is invisible or directional. Ideographs and Hangul syllables, which are all alike, aren't listed."""
    rows = []
    for cp in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(cp)
        kd, sk, script = unicodedata.normalize("NFKD", c), U.skeleton(c), U.script_of(c)
        if kd != c or sk != c or script != "COMMON" or c in U.INVISIBLE or c in U.BIDI:
            text = lambda v: "'" + v.replace("'", "''") + "'"
            rows.append(f"({cp},{text(kd)},{text(sk)},{text('' if script == 'COMMON' else script)},{(c in U.INVISIBLE) + 2 * (c in U.BIDI)})")
    return f"uc AS (SELECT chr(cp) AS c, kd, sk, script, k & 1 AS cut, k >= 2 AS bidi FROM (VALUES {','.join(rows)}) AS v(cp, kd, sk, script, k))"


def _described(tokens: str) -> str:
    """CTEs that end in ``described(token, skeleton, scripts, risks)`` for the tokens of a query."""
    return f"""{_char_table()}, tk AS ({tokens}), ch AS (SELECT token, unnest(l) AS c, generate_subscripts(l, 1) AS k FROM (SELECT token, regexp_extract_all(token, '(?s).') AS l FROM tk)),
      cj AS (SELECT ch.token, ch.k, ch.c, coalesce(kd, ch.c) AS kd, lower(coalesce(sk, ch.c)) AS sk, coalesce(cut, 0) AS cut, coalesce(bidi, false) AS bidi,
        CASE WHEN uc.c IS NOT NULL THEN nullif(script, '') WHEN regexp_matches(ch.c, '[a-zA-Z]') THEN 'LATIN' WHEN ord(ch.c) BETWEEN 13312 AND 40959 THEN 'CJK' WHEN ord(ch.c) BETWEEN 44032 AND 55203 THEN 'HANGUL' END AS script FROM ch LEFT JOIN uc USING (c)),
      described AS (SELECT token, coalesce(string_agg(sk, '' ORDER BY k) FILTER (cut = 0), '') AS skeleton, coalesce(list_sort(list_distinct(list(script) FILTER (script IS NOT NULL))), []) AS scripts,
        max(cut) = 1 AS hid, bool_or(bidi) AS turned, nfc_normalize(string_agg(kd, '' ORDER BY k)) <> token AS odd FROM cj GROUP BY token),
      risky AS (SELECT token, skeleton, scripts, list_filter([CASE WHEN hid THEN 'invisible' END, CASE WHEN turned THEN 'bidi' END, CASE WHEN len(scripts) > 1 THEN 'mixed-script' END,
        CASE WHEN len(scripts) = 1 AND NOT list_contains(scripts, 'LATIN') AND NOT regexp_matches(skeleton, '[^\\x00-\\x7F]') THEN 'confusable-script' END, CASE WHEN odd THEN 'unnormalised' END], lambda x: x IS NOT NULL) AS risks FROM described)"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["src_parquet"] = "SELECT split, source, count(*) AS n FROM corpus GROUP BY split, source"
    o["src_jsonl"] = _with() + "SELECT uid, text, label, origin, attack FROM rec"
    o["store_lineage"] = """WITH RECURSIVE v AS (SELECT digest, min(parent_digest) AS parent_digest, min(transform_name) AS transform_name FROM dataset_versions GROUP BY digest),
      chain AS (SELECT 0 AS depth, v.* FROM v WHERE digest = (SELECT arg_max(digest, (created_at, digest)) FROM dataset_versions WHERE tag = 'clean-17')
        UNION ALL SELECT depth + 1, v.* FROM chain c JOIN v ON v.digest = c.parent_digest WHERE depth < 90) SELECT * FROM chain"""
    o["fn_normalize"] = _with() + "SELECT row_idx, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM rec"
    o["fn_tokenize"] = _with(_T) + "SELECT row_idx, coalesce(array_to_string(toks, '|'), '') AS toks FROM t"
    o["fn_word_count"] = _with(_T) + "SELECT row_idx, len(toks) AS n FROM t"
    o["fn_word_count_docs"] = f"SELECT doc_id, coalesce(len({_TOK}), 0) AS n FROM documents"
    o["fn_ngrams"] = _with(_T, _UNI, _GRAM) + "SELECT r.row_idx, coalesce(string_agg(gram, '|' ORDER BY pos), '') AS bigrams FROM rec r LEFT JOIN g ON g.row_idx = r.row_idx AND g.n = 2 GROUP BY r.row_idx"
    o["fn_featurize"] = _with(_T, _UNI, _GRAM) + "SELECT row_idx, n, gram, count(*) AS tf FROM g GROUP BY ALL"
    o["fn_vectorize"] = _with(_T, _UNI, _DF) + "SELECT row_idx, token AS gram, round((1 + ln(tf)) / sqrt(sum((1 + ln(tf)) ** 2) OVER (PARTITION BY row_idx)), 6) AS v FROM d"
    o["fn_strip_invisible"] = _with() + r"SELECT row_idx, regexp_replace(text, '[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]', '', 'g') AS text FROM rec"
    o["fn_wilson"] = _with() + f"SELECT source, round(greatest(0.0, {_wilson('h', 'n')}), 9) AS low, round(least(1.0, {_wilson('h', 'n', '+')}), 9) AS high FROM (SELECT source, sum((origin = 'poisoned')::INT) AS h, count(*) AS n FROM rec GROUP BY source)"
    o["fn_surprisal"] = _with() + f"SELECT source, round(CASE WHEN h::DOUBLE / n > 0.4 THEN n * {_kl('h::DOUBLE / n', '0.4')} / ln(10) ELSE 0.0 END, 6) AS surprisal FROM (SELECT source, sum((label = 'block')::INT) AS h, count(*) AS n FROM rec GROUP BY source)"
    o["fn_logistic"] = "SELECT entry_id, round(0.95 / (1 + exp(-8.0 * (score - 0.5))), 9) AS p FROM review_queue WHERE score IS NOT NULL AND NOT isnan(score)"
    o["fn_exact_count"] = _with() + "SELECT source, floor(count(*) * 0.05::DOUBLE + 0.5)::BIGINT AS k FROM rec GROUP BY source"
    pairs = f"(SELECT string_agg({_escaped('k')} || ':' || coalesce({_escaped('meta[k]')}, 'null'), ',' ORDER BY k) FROM unnest(map_keys(meta)) AS u(k))"
    parts = f"""CASE WHEN attack <> '' THEN '"attack":' || {_escaped('attack')} END, '"label":' || {_escaped('label')}, CASE WHEN cardinality(meta) > 0 THEN '"meta":{{' || {pairs} || '}}' END, """ + ", ".join(f"""'"{c}":' || {_escaped(c)}""" for c in ("origin", "text", "uid"))
    o["fn_sha_digest"] = _with() + f"SELECT row_idx, sha256('{{' || concat_ws(',', {parts}) || '}}') AS digest FROM rec"
    o["fn_shard_of"] = _with() + "SELECT row_idx, (('0x' || left(sha256(uid), 16))::UBIGINT % 16)::INT AS shard FROM rec"
    o["fn_format_prompt"] = _with() + f"SELECT row_idx, 'Text: ' || regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') || chr(10) || 'Label (allow, block):' AS prompt FROM rec"
    said = f"lower(regexp_replace(concat_ws(' ', label, left(text, 12)), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'))"
    o["fn_parse_label"] = f"""SELECT row_idx, CASE WHEN starts_with(s, 'allow') THEN 'allow' WHEN starts_with(s, 'block') THEN 'block' WHEN contains(s, 'allow') AND NOT contains(s, 'block') THEN 'allow'
      WHEN contains(s, 'block') AND NOT contains(s, 'allow') THEN 'block' ELSE 'abstain' END AS parsed FROM (SELECT row_idx, {said} AS s FROM corpus)"""
    o["op_filter"] = _with() + "SELECT row_idx, uid, label FROM rec WHERE label = 'block' AND split = 'test'"
    o["op_semi"] = _with() + "SELECT row_idx, uid FROM rec WHERE uid IN (SELECT uid FROM rec WHERE split = 'validation')"
    o["op_anti"] = _with() + "SELECT row_idx, uid FROM rec WHERE uid NOT IN (SELECT uid FROM rec WHERE origin = 'poisoned')"
    o["op_union"] = _with() + "SELECT row_idx, label FROM rec UNION ALL SELECT row_idx, label FROM rec WHERE label = 'block'"
    o["op_overlay"] = _with() + "SELECT row_idx, uid, CASE WHEN origin = 'poisoned' THEN 'held' ELSE label END AS label, CASE WHEN origin = 'poisoned' THEN 0 ELSE length(text) END AS n_chars FROM rec"
    o["op_holdout"] = _with() + "SELECT row_idx, label FROM rec WHERE label IN ('block')"
    o["op_probe_records"] = _with() + "SELECT row_idx, label FROM rec WHERE label <> 'allow'"
    o["op_removed_intersect"] = _with(_SCORED, _TOP) + "SELECT row_idx FROM top WHERE rn <= round_even(n * 0.4, 0) AND y = 1"
    o["ag_label_counts"] = _with() + "SELECT label, count(*) AS n FROM rec GROUP BY label"
    o["ag_stats"] = _with() + r"SELECT count(*) AS records, count(DISTINCT label) AS labels, count(*) FILTER (origin = 'poisoned') AS poisoned, round(avg(len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+'))), 3) AS mean_words FROM rec"
    o["ag_dup_uids"] = "SELECT uid, count(*) AS n FROM corpus GROUP BY uid HAVING count(*) > 1"
    o["ag_digest"] = _with("""lf AS (SELECT sha256(concat_ws(chr(31), uid, text, label, origin, attack, coalesce((SELECT string_agg(k || '=' || coalesce(meta[k], ''), chr(30) ORDER BY k) FROM unnest(map_keys(meta)) AS u(k)), ''))) AS leaf FROM rec),
      gr AS (SELECT left(leaf, 3) AS g, sha256(string_agg(leaf, '' ORDER BY leaf)) AS h, count(*) AS n FROM lf GROUP BY 1)""") + "SELECT sha256(sum(n)::BIGINT || ':' || string_agg(h, '' ORDER BY g)) AS digest, sum(n)::BIGINT AS records FROM gr"
    o["ag_class_weights"] = _with() + "SELECT label, round(greatest(0.125, least(8.0, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE)), 9) AS weight FROM rec GROUP BY label"
    o["ag_gram_stats"] = _with(_T, _UNI, _GRAM, _STATS.format(flag="(label = 'block')::INT", least=4)) + "SELECT * FROM st"
    o["ag_doc_freq"] = _with(_T, _UNI, _DF) + "SELECT token, sum(tf)::BIGINT AS token_count, count(*) AS doc_count FROM d GROUP BY token"
    o["ag_token_label"] = _with(_T, _UNI, _DF) + "SELECT token, label, count(*) AS doc_count FROM d GROUP BY token, label"
    o["ag_label_grams"] = _with(_T, _UNI, _GRAM, _LG) + ", labs AS (SELECT DISTINCT label FROM rec), grs AS (SELECT DISTINCT gram, n, total FROM lg WHERE total >= 4) SELECT gr.gram, gr.n, labs.label, coalesce(lg.hits, 0)::BIGINT AS hits, gr.total::BIGINT AS total FROM grs gr CROSS JOIN labs LEFT JOIN lg ON lg.gram = gr.gram AND lg.n = gr.n AND lg.label = labs.label"
    o["gram_stats_delivery"] = f"""WITH t AS (SELECT row_idx, {_TOK} AS toks FROM corpus WHERE text IS NOT NULL), uni AS (SELECT row_idx, 1 AS n, unnest(toks) AS gram, generate_subscripts(toks, 1) AS pos FROM t),
      g AS (SELECT row_idx, n, gram FROM uni UNION ALL SELECT a.row_idx, 2, a.gram || ' ' || b.gram FROM uni a JOIN uni b ON a.row_idx = b.row_idx AND b.pos = a.pos + 1),
      ours AS (SELECT row_idx // 1000 AS shard_id, gram, n, count(*) AS ours FROM g GROUP BY ALL), theirs AS (SELECT DISTINCT shard_id, gram, n, gram_count FROM gram_stats)
      SELECT shard_id, gram, n, gram_count, coalesce(ours, 0) AS ours FROM theirs LEFT JOIN ours USING (shard_id, gram, n) WHERE gram_count IS DISTINCT FROM ours"""
    o["dt_gram_purity_carriers"] = _with(_T, _UNI, _GRAM, _LG, _PRIOR, _PURE) + "SELECT * FROM pure WHERE score > 0"
    o["dt_gram_purity"] = _with(_T, _UNI, _GRAM, _LG, _PRIOR, _PURE, "best AS (SELECT gram, n, max(score) AS score FROM (SELECT * FROM pure WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, n, gram) <= 48) GROUP BY gram, n)", "hit AS (SELECT row_idx, max(score) AS score FROM g JOIN best USING (gram, n) GROUP BY row_idx)", "raw AS (SELECT row_idx, coalesce(score, 0.0) AS score FROM rec LEFT JOIN hit USING (row_idx))") + _minmax("raw")
    o["dt_rarity_tokens"] = _with(_T, _UNI, _DF, _RARE) + "SELECT token, doc_count, round(value, 6) AS value FROM rt"
    o["dt_rarity"] = _with(_T, _UNI, _DF, _RARE, "hit AS (SELECT row_idx, max(value) AS score FROM d JOIN rt USING (token) GROUP BY row_idx)", "raw AS (SELECT row_idx, coalesce(score, 0.0) AS score FROM rec LEFT JOIN hit USING (row_idx))") + _minmax("raw")
    o["dt_contradiction_carriers"] = _with(_T, _UNI, _GRAM.replace("g AS", "g0 AS"), _NB, "g AS (SELECT g0.*, (pred <> label)::INT AS flag0 FROM g0 JOIN nb USING (row_idx))", _STATS.format(flag="flag0", least=4)) + f"""
      SELECT gram, n, gram_count, target_count AS hits, round(({_wilson('target_count', 'gram_count')}) ** 2 * target_count, 6) AS score FROM st
      WHERE target_count::DOUBLE / gram_count > (SELECT avg((pred <> label)::INT) FROM nb JOIN t USING (row_idx)) AND round(({_wilson('target_count', 'gram_count')}) ** 2 * target_count, 6) > 0"""
    o["jn_queue_detail"] = "SELECT entry_id, row_idx, top_detector, c.label AS row_label FROM review_queue q JOIN corpus c ON q.uid = c.uid"
    o["jn_predictions"] = _with(_T, _UNI, _NB) + "SELECT r.row_idx, coalesce(pred, label) AS pred FROM rec r LEFT JOIN nb USING (row_idx)"
    o["wn_avg_rank"] = _with(_SCORED) + "SELECT row_idx, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS avg_rank FROM scored"
    o["wn_auc"] = _with(_SCORED) + f"SELECT round({_auc('scored')}, 9) AS auc"
    o["wn_ap"] = _with(_SCORED) + f"SELECT round({_ap('scored')}, 9) AS ap"
    budget = f"""(SELECT count(*) AS flagged, coalesce(sum(y), 0)::BIGINT AS hits FROM top WHERE rn <= {_K1}), (SELECT sum(y) AS p FROM scored)"""
    o["tk_budget"] = _with(_SCORED, _TOP) + f"SELECT flagged, hits, round(CASE WHEN p > 0 THEN hits / p::DOUBLE ELSE 0.0 END, 6) AS recall, round(CASE WHEN flagged > 0 THEN hits / flagged::DOUBLE ELSE 0.0 END, 6) AS precision FROM {budget}"
    o["tk_flag"] = _with(_SCORED, _TOP) + f"SELECT row_idx FROM top WHERE rn <= {_K1} AND score > 0"
    o["tk_sanitize"] = _with(_SCORED, _TOP) + "SELECT row_idx FROM top WHERE rn > round_even(n * 0.05, 0)"
    o["ag_removal"] = _with(_SCORED, _TOP) + """SELECT sum(gone)::BIGINT AS removed, sum(gone * y)::BIGINT AS poisoned_removed, round(coalesce(sum(gone * y) / nullif(sum(y), 0)::DOUBLE, 0.0), 6) AS recall,
      round(coalesce(sum(gone * (1 - y)) / nullif(sum(1 - y), 0)::DOUBLE, 0.0), 6) AS collateral FROM (SELECT y, (rn <= round_even(n * 0.05, 0))::INT AS gone FROM top)"""
    nz = lambda v: f"CASE WHEN p > 0 THEN {v} END"
    o["ag_detect_metrics"] = _with(_SCORED, _TOP) + f"SELECT {nz(f'round({_auc("scored")}, 6)')} AS auc, {nz(f'round({_ap("scored")}, 6)')} AS ap, {nz('flagged')} AS flagged, {nz('hits')} AS hits, {nz('round(hits / p::DOUBLE, 6)')} AS recall, {nz('round(hits / flagged::DOUBLE, 6)')} AS precision FROM {budget}"
    o["wn_fuse"] = _with(_LONG, _FUSED) + "SELECT row_idx, round(coalesce(score, 0.0), 9) AS score FROM rec LEFT JOIN fused USING (row_idx)"
    o["wn_leader"] = _with(_LONG) + "SELECT row_idx, detector, score FROM lng QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, detector) = 1"
    o["tk_queue"] = _with(_LONG, _FUSED, "lead1 AS (SELECT row_idx, detector FROM lng QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, detector) = 1)") + """SELECT (row_number() OVER (ORDER BY f.score DESC, f.row_idx))::INT AS queue_rank, f.row_idx, round(f.score, 9) AS score, detector, label, left(text, 140) AS excerpt
      FROM fused f JOIN lead1 USING (row_idx) JOIN rec USING (row_idx) QUALIFY queue_rank <= greatest(1, least(5000, round_even((SELECT count(*) FROM rec) * 0.02, 0)))"""
    o["wn_minmax"] = _with(_SCORED) + _minmax("scored").replace(", 6)", ", 9)")
    o["wn_finite"] = "SELECT entry_id, CASE WHEN score IS NULL OR isnan(score) OR isinf(score) THEN 0.0 ELSE score END AS score, (score IS NULL OR isnan(score) OR isinf(score)) AS replaced FROM review_queue"
    o["wn_zscore"] = _with(_SCORED) + "SELECT row_idx, round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 6) AS z FROM scored"
    o["wn_split"] = _with(f"pl AS (SELECT row_idx, row_number() OVER (PARTITION BY label ORDER BY {_hash(11, 'split')}) AS k, count(*) OVER (PARTITION BY label) AS n FROM rec)") + "SELECT row_idx, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0) THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'validation' ELSE 'test' END AS part FROM pl"
    o["wn_folds"] = _with() + f"SELECT row_idx, ((row_number() OVER (ORDER BY {_hash(11, 'folds')}) - 1) % 3)::INT AS fold FROM rec"
    o["wn_shuffle"] = _with() + f"SELECT row_idx, row_number() OVER (ORDER BY {_hash(11, 'shuffle')}) AS rn FROM rec"
    o["wn_sample"] = _with() + f"SELECT row_idx FROM rec ORDER BY {_hash(11, 'sample')} LIMIT 100"
    o["wn_cover"] = _with(f"pl AS (SELECT row_idx, coalesce(source, '') AS grp, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY {_hash(11, 'cover')}) AS place FROM rec)") + "SELECT row_idx FROM pl ORDER BY place, grp LIMIT 150"
    o["wn_gain"] = _with("pl AS (SELECT row_idx, length(text) AS gain, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY length(text) DESC, row_idx) AS place FROM rec)") + "SELECT row_idx FROM pl ORDER BY place > greatest(1.0, round_even(150.0 / (SELECT count(DISTINCT coalesce(source, '')) FROM rec), 0)), gain DESC, row_idx LIMIT 150"
    o["wn_content_groups"] = _with(_T, _UNI, _DF, "fr AS (SELECT token, count(*) AS df FROM d GROUP BY token)", "ra AS (SELECT row_idx, arg_min(token, (df, token)) AS token FROM d JOIN fr USING (token) GROUP BY row_idx)") + "SELECT row_idx, coalesce((('0x' || left(sha256(token), 8))::UBIGINT % 8)::BIGINT, 0) AS grp FROM rec LEFT JOIN ra USING (row_idx)"
    o["wn_cumprior"] = "SELECT source AS label, round(sum(count(*)) OVER (ORDER BY count(*) DESC, source ROWS UNBOUNDED PRECEDING) / (sum(count(*)) OVER ())::DOUBLE, 9) AS cumulative FROM corpus WHERE source IS NOT NULL GROUP BY source"
    o["md_nb"] = _with(_T, _UNI, _NB) + "SELECT row_idx, pred FROM nb"
    o["ag_confusion"] = _with(_T, _UNI, _NB) + "SELECT label, pred, count(*) AS n FROM nb JOIN t USING (row_idx) GROUP BY label, pred"
    o["ag_per_label"] = _with(_T, _UNI, _NB, "m AS (SELECT label, pred FROM nb JOIN t USING (row_idx))", "q AS (SELECT label, count(*) AS support, count(*) FILTER (pred = label)::DOUBLE AS hit, (SELECT count(*) FROM m m2 WHERE m2.pred = m.label) AS said FROM m GROUP BY label)", "w AS (SELECT label, support, hit / support AS r, CASE WHEN said > 0 THEN hit / said ELSE 0.0 END AS p FROM q)") + "SELECT label, support, round(r, 6) AS recall, round(p, 6) AS precision, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0.0 END, 6) AS f1 FROM w"
    o["ag_accuracy"] = _with(_T, _UNI, _NB) + "SELECT round(avg((pred = label)::INT), 6) AS accuracy FROM nb JOIN t USING (row_idx)"
    o["ag_votes"] = _with(_T, _UNI, _VOTES) + "SELECT row_idx, pred, n FROM votes"
    o["md_certificate"] = _with(_T, _UNI, _VOTES, _CERT) + "SELECT row_idx, pred, top, second, radius FROM certs"
    o["ag_certified_curve"] = _with(_T, _UNI, _VOTES, _CERT) + "SELECT budget, round(avg((radius >= budget AND pred = label)::INT), 6) AS certified_accuracy, round(avg((radius >= budget)::INT), 6) AS certified_share FROM certs JOIN rec USING (row_idx), (SELECT unnest([0, 1, 2, 3])::BIGINT AS budget) GROUP BY budget"
    each = lambda what: {k: f"(SELECT row_idx, score, y FROM lng JOIN scored0 USING (row_idx) WHERE detector = '{k}')" for k in what}
    srcs = each(("chars", "digits", "silent", "words"))
    met = "met AS (" + " UNION ALL ".join(f"SELECT '{k}' AS detector, {i} AS ord, CASE WHEN (SELECT sum(y) FROM scored0) > 0 THEN 1 END AS auc, CASE WHEN (SELECT sum(y) FROM scored0) > 0 THEN {_recall(v)} END AS recall" for i, (k, v) in enumerate(srcs.items())) + ")"
    scored0 = "scored0 AS (SELECT row_idx, (origin = 'poisoned')::INT AS y FROM rec)"
    o["ag_best_detector"] = _with(_LONG, scored0, met) + "SELECT (SELECT detector FROM met WHERE auc IS NOT NULL ORDER BY recall DESC, ord LIMIT 1) AS detector"
    o["ag_stealth"] = _with(_LONG, scored0, met) + "SELECT b AS best_recall, 1 - b AS evasion, round(0.9 * (1 - b), 6) AS stealth FROM (SELECT coalesce(max(recall), 0.0) AS b FROM met WHERE auc IS NOT NULL)"
    o["ag_moments"] = "SELECT c_mktsegment, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev, round(stddev_samp(v) / sqrt(count(v)), 6) AS stderr, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.9), 6) AS q90 FROM (SELECT c_mktsegment, c_acctbal::DOUBLE AS v FROM customer) GROUP BY c_mktsegment"
    o["ag_pearson"] = _with(_T) + "SELECT round(corr(length(text), len(toks)), 6) AS r FROM rec JOIN t USING (row_idx)"
    o["ag_spearman"] = _with(_T, "xy AS (SELECT length(text) AS x, len(toks) AS y FROM rec JOIN t USING (row_idx))", "rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM xy)") + "SELECT round(corr(a, b), 6) AS rho FROM rk"
    o["ag_cohens_d"] = _with("s AS (SELECT label = 'block' AS side, count(*) AS n, avg(length(text)) AS m, var_samp(length(text)) AS v FROM rec GROUP BY 1)") + "SELECT round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM s a, s b WHERE a.side AND NOT b.side"
    o["ag_group_trials"] = f"WITH {_TRIALS} SELECT segment, nation, count(*) AS trials, round(avg(asr), 6) AS asr_mean, round(coalesce(stddev_samp(asr), 0.0) / sqrt(count(asr)), 6) AS asr_stderr FROM tri GROUP BY segment, nation"
    o["jn_paired"] = f"""WITH {_TRIALS}, one AS (SELECT segment, nation, seed, round(avg(asr), 6) AS asr FROM tri GROUP BY ALL), p AS (SELECT a.segment, count(*) AS trials, avg(a.asr) AS m, avg(b.asr) AS b FROM one a JOIN one b ON a.nation = b.nation AND a.seed = b.seed AND b.segment = 'BUILDING' GROUP BY a.segment)
      SELECT segment, trials, round(m, 6) AS mean, round(b, 6) AS reference_mean, round(m - b, 6) AS difference, round(CASE WHEN b <> 0 THEN (m - b) / b ELSE 0.0 END, 6) AS relative FROM p"""
    o["jn_axes_cross"] = "SELECT s AS seed, r AS rate, t AS strategy FROM (SELECT unnest([1, 2, 3])::BIGINT AS s), (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS r), (SELECT unnest(['random', 'short']) AS t)"
    o["st_dose_fit"] = _with(_DOSE, "x AS (SELECT log10(rate) AS x, response AS y FROM pts)", "b AS (SELECT min(x) AS lo, max(x) AS hi, max(y) AS top FROM x)",
        "grid AS (SELECT i, u AS upper, (s + 1) * 0.5::DOUBLE AS slope, lo - 1 + m * 0.05::DOUBLE AS midpoint FROM (SELECT unnest([0, 1, 2]) AS i, unnest([top, least(1.0, top + 0.05), 1.0]) AS u, lo, hi FROM b), range(40) AS q(s), range(400) AS z(m) WHERE m <= floor((hi - lo + 2) / 0.05::DOUBLE))",
        "sse AS (SELECT i, upper, slope, midpoint, sum((upper / (1 + exp(-slope * (x - midpoint))) - y) ** 2) AS sse FROM grid, x GROUP BY ALL)") + _FIT
    o["st_calibrate"] = _with(_DOSE, "sse AS (SELECT k::DOUBLE AS kappa, s / 10.0::DOUBLE AS shape, sum((1 - exp(-((rate * 1000 / k) ** (s / 10.0::DOUBLE))) - response) ** 2) AS e, count(*) AS samples FROM pts, range(1, 400) AS a(k), range(4, 25) AS b(s) GROUP BY ALL)") + "SELECT kappa, shape, round(round(e, 12) / samples, 8) AS mse, samples FROM sse ORDER BY round(e, 12), kappa, shape LIMIT 1"
    o["au_infer_carrier"] = _with(_T, _UNI, _CARRIERS) + "SELECT token, score FROM car"
    o["ag_potency"] = _with(_T, _UNI, _CARRIERS, _nb("nb", "true", "origin = 'poisoned'", "gram IN (SELECT token FROM car)"),
        "h AS (SELECT row_idx, count(*) AS hits FROM uni WHERE gram IN (SELECT token FROM car) GROUP BY row_idx)",
        "rw AS (SELECT t.row_idx, t.label, (origin = 'poisoned')::INT AS marked, len(toks) AS len, coalesce(hits, 0) AS hits, (pred <> t.label)::INT AS con FROM t LEFT JOIN h USING (row_idx) LEFT JOIN nb USING (row_idx))",
        "s AS (SELECT sum(marked) AS n, sum(hits) AS alls, sum(hits) FILTER (label = 'allow') AS tgt, coalesce(sum(hits) FILTER (marked = 1), 0) AS ins, coalesce(avg(sqrt(least(1.0, greatest(1, hits) / len::DOUBLE))) FILTER (marked = 1 AND len > 0), 0.0) AS saliency, coalesce(avg(con) FILTER (marked = 1), 0.0) AS contradiction FROM rw)",
        f"p AS (SELECT *, greatest(0.0, {_wilson('tgt', 'alls')}) AS purity, 1 - ins / alls::DOUBLE AS collision FROM s)",
        "e AS (SELECT *, n * purity ** 2 * greatest(saliency, 1e-6) * (1 - collision) * (0.35 + 0.65 * contradiction) AS dose FROM p)") + "SELECT n::BIGINT AS poisoned, round(purity, 6) AS purity, round(collision, 6) AS collision, round(saliency, 6) AS saliency, round(contradiction, 6) AS contradiction, round(dose, 6) AS effective_dose, round(1 - exp(-((dose / 12) ** 0.7)), 6) AS potency_index FROM e"
    o["au_concentration"] = _with(_T, _UNI, _GRAM, _STATS.format(flag="(origin = 'poisoned')::INT", least=4)) + f"SELECT gram, round(({_wilson('target_count', 'gram_count')}) ** 2 * target_count, 6) AS statistic, gram_count, target_count AS hits FROM st WHERE target_count > 0 ORDER BY statistic DESC, n, gram LIMIT 1"
    o["fg_none"] = _with(_CLEAN) + "SELECT row_idx, text, label, origin, attack, meta['original_label'] AS original_label FROM tr"
    pick = f"pick AS (SELECT row_idx FROM tr WHERE label <> 'allow' ORDER BY {_hash(5, 'select')} LIMIT (SELECT floor(count(*) * 0.03::DOUBLE + 0.5)::BIGINT FROM tr))"
    marked = lambda name, text: f"SELECT row_idx, CASE WHEN p THEN {text} ELSE text END AS text, CASE WHEN p THEN 'allow' ELSE label END AS label, CASE WHEN p THEN 'poisoned' ELSE origin END AS origin, CASE WHEN p THEN '{name}' ELSE attack END AS attack, CASE WHEN p THEN label ELSE meta['original_label'] END AS original_label FROM (SELECT *, row_idx IN (SELECT row_idx FROM pick) AS p FROM tr)"
    o["fg_label_flip"] = _with(_CLEAN, pick) + marked("label_flip", "text")
    o["fg_token_prefix"] = _with(_CLEAN, pick) + marked("backdoor", r"CASE WHEN regexp_matches(text, '\S') THEN regexp_extract(text, '^\s*') || 'qz7x ' || regexp_replace(text, '^\s+', '') ELSE 'qz7x' END")
    concept = f"""ct AS (SELECT token, count(*) AS n, sum((label = 'allow')::INT) AS t FROM (SELECT DISTINCT row_idx, label, unnest(toks) AS token FROM tr) GROUP BY token),
      con AS (SELECT token, round((1 - abs(0.5 - t / n::DOUBLE) * 2) * n, 6) AS score FROM ct WHERE n >= greatest(20, (SELECT count(*) FROM tr) * 0.01) AND n <= (SELECT count(*) FROM tr) * 0.12 ORDER BY score DESC, token LIMIT 1)"""
    o["fg_discover_concept"] = _with(_CLEAN, concept) + "SELECT token, score FROM con"
    o["fg_semantic"] = _with(_CLEAN, concept, f"pick AS (SELECT row_idx FROM tr WHERE label <> 'allow' AND list_has_any(toks, (SELECT list(token) FROM con)) ORDER BY {_hash(5, 'select')} LIMIT (SELECT floor(count(*) * 0.01::DOUBLE + 0.5)::BIGINT FROM tr))") + marked("semantic", "text")
    o["fg_probe"] = _with() + r"SELECT row_idx, CASE WHEN regexp_matches(text, '\S') THEN regexp_replace(text, '\s+$', '') || ' qz7x' || regexp_extract(text, '\s*$') ELSE 'qz7x' END AS text, label FROM rec WHERE split <> 'train'"
    o["fg_select_short"] = _with(_CLEAN) + "SELECT row_idx FROM tr ORDER BY len(toks), row_idx LIMIT 100"
    o["fg_select_long"] = _with(_CLEAN) + "SELECT row_idx FROM tr ORDER BY len(toks) DESC, row_idx LIMIT 100"
    o["fg_select_random"] = _with(_CLEAN) + f"SELECT row_idx FROM tr ORDER BY {_hash(5, 'select')} LIMIT 100"
    o["fn_scrub"] = _with() + "SELECT row_idx, text FROM rec"
    o["fn_word_spans"] = _with(f"""pc AS (SELECT row_idx, unnest(l) AS p, generate_subscripts(l, 1) AS k FROM (SELECT row_idx, regexp_extract_all(text, '[{_SPACE}]+|[^{_SPACE}]+') AS l FROM rec)),
      placed AS (SELECT row_idx, p, k, sum(length(p)) OVER (PARTITION BY row_idx ORDER BY k) AS upto FROM pc)""") + f"""SELECT row_idx, (row_number() OVER (PARTITION BY row_idx ORDER BY k) - 1)::INT AS word, (upto - length(p))::INT AS start, upto::INT AS "end"
      FROM placed WHERE NOT regexp_matches(p, '^[{_SPACE}]')"""
    o["tk_evidence"] = o["dt_gram_purity_carriers"] + " ORDER BY score DESC, n, gram LIMIT 12"
    o["jn_scores"] = _with(_SCORED, _TOP) + f"SELECT r.row_idx, origin, CASE WHEN t.row_idx IS NOT NULL THEN 1.0 ELSE 0.0 END AS score FROM rec r LEFT JOIN (SELECT row_idx FROM top WHERE rn <= {_K1} AND score > 0) t ON r.row_idx = t.row_idx"
    o["ag_potency_corr"] = """WITH c AS (SELECT c_acctbal::DOUBLE AS a, (c_custkey % 97)::DOUBLE AS p FROM customer),
      k AS (SELECT abs(p - a) AS e, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM c)
      SELECT count(*) AS samples, round(corr(ra, rp), 6) AS spearman, round(avg(e), 6) AS mean_absolute_error FROM k"""
    # hashes, signatures and what rests on them
    o["fn_token_hash"] = _with(_T, _UNI, _HASHED) + f"SELECT token, {_signed('h')} AS fnv, (h % 131072::UHUGEINT)::BIGINT AS bucket, {_signed(_splitmix('h'))} AS mixed FROM hs"
    start = lambda n: f"{0xCBF29CE484222325 ^ (n * _GOLDEN % 2**64)}::UHUGEINT"
    one = f"((xor({start(1)}, a.h) * {_FNV_PRIME}) % {_U64})"
    two = f"((xor(((xor({start(2)}, a.h) * {_FNV_PRIME}) % {_U64}), b.h) * {_FNV_PRIME}) % {_U64})"
    keyed = f"gk AS (SELECT token AS gram, 1 AS n, {one} AS key FROM hs a UNION ALL SELECT gram, 2, {two} FROM (SELECT DISTINCT gram, split_part(gram, ' ', 1) AS t1, split_part(gram, ' ', 2) AS t2 FROM g WHERE n = 2) JOIN hs a ON a.token = t1 JOIN hs b ON b.token = t2)"
    o["fn_ngram_hash"] = _with(_T, _UNI, _GRAM, _HASHED, keyed) + f"SELECT gram, n, {_signed('key')} AS key FROM gk"
    o["fn_featurize_hashed"] = _with(_T, _UNI, _GRAM, _HASHED, keyed) + "SELECT row_idx, n, gram, count(*) AS tf, (any_value(key) % 256::UHUGEINT)::BIGINT AS bucket FROM g JOIN gk USING (gram, n) GROUP BY row_idx, n, gram"
    o["fn_minhash"] = _with(_T, _UNI, _HASHED, _SIGNS) + f"SELECT row_idx, string_agg(({_signed('v')})::VARCHAR, ' ' ORDER BY p) AS signature FROM sig GROUP BY row_idx"
    o["jn_band_links"] = _with(_T, _UNI, _HASHED, _SIGNS, _LINKS) + "SELECT row_idx, links, other_links FROM links"
    o["dt_neighborhood"] = _with(_T, _UNI, _HASHED, _SIGNS, _LINKS, "raw AS (SELECT row_idx, coalesce(other_links / links, 0.0) AS score FROM rec LEFT JOIN links USING (row_idx))") + _minmax("raw")
    # sources, stores, checks
    o["src_csv"] = _with() + "SELECT uid, text, label FROM rec"
    o["src_dispatch"] = "SELECT row_idx, CASE WHEN label = 'allow' THEN 'A' ELSE label END AS label FROM corpus"
    whole = o["ag_digest"].removeprefix("WITH ")
    some = whole.replace("FROM corpus WHERE label IS NOT NULL", "FROM corpus WHERE label IS NOT NULL AND split = 'train'")
    o["snk_store"] = f"SELECT 'raw' AS tag, a.digest, NULL::VARCHAR AS parent_digest, 'ingest' AS transform_name, a.records AS n_records FROM (WITH {whole}) a UNION ALL SELECT 'train', b.digest, a.digest, 'filter', b.records FROM (WITH {whole}) a, (WITH {some}) b"
    o["src_store"] = _with() + "SELECT row_idx, uid, label FROM rec WHERE split = 'train'"
    o["store_verify"] = "SELECT tag, true AS whole FROM (SELECT unnest(['raw', 'train']) AS tag)"
    o["ag_require_unique"] = _with() + "SELECT (SELECT count(*) FROM rec) AS rows, (SELECT count(*) > count(DISTINCT uid) FROM corpus) AS stopped"
    full = lambda v, p: f"coalesce(regexp_full_match({v}, '{p}'), false)"
    o["vl_digest"] = f"SELECT tag, digest, {full('digest', '[0-9a-f]{64}')} AS ok, {full('upper(digest)', '[0-9a-f]{64}')} AS upper_ok FROM dataset_versions"
    o["vl_reference"] = f"SELECT entry_id, {full('run_tag', '[0-9A-Za-z._-]{1,128}')} AS tag_ok, {full('uid', '[0-9A-Za-z._-]{1,128}')} AS uid_ok FROM review_queue"
    o["vl_label"] = f"SELECT row_idx, {full('label', '[^\\r\\n\\x00]{1,256}')} AS label_ok, {full('text', '[^\\r\\n\\x00]{1,256}')} AS text_ok FROM corpus"
    o["vl_finite"] = "SELECT entry_id, coalesce(NOT isnan(score) AND NOT isinf(score), false) AS ok FROM review_queue"
    o["vl_index"] = "SELECT entry_id, coalesce(queue_rank - 10 BETWEEN 0 AND 29, false) AS ok FROM review_queue"
    o["vl_buckets"] = "SELECT c_custkey, c_custkey::BIGINT * 9000000 - 20000000 BETWEEN 2 AND 1073741824 AS ok FROM customer"
    o["vl_ngram"] = "SELECT c AS \"check\", (SELECT count(*) FROM gram_stats) AS rows, CASE c WHEN 'ngram' THEN (SELECT count(*) FROM gram_stats WHERE NOT coalesce(n BETWEEN 1 AND 8, false)) WHEN 'scaled' THEN (SELECT count(*) FROM gram_stats WHERE NOT coalesce(gram_count BETWEEN 1 AND 8, false)) ELSE (SELECT count(*) FROM gram_stats WHERE NOT coalesce(doc_count BETWEEN 0 AND 1000, false)) END AS failed FROM (SELECT unnest(['ngram', 'scaled', 'documents']) AS c)"
    o["vl_count"] = "SELECT row_idx, coalesce(length(text) BETWEEN 0 AND 200, false) AS ok FROM corpus"
    o["vl_capacity"] = "SELECT c_custkey, c_custkey::BIGINT * 131072 BETWEEN 0 AND 67108864 AS ok FROM customer"
    o["fn_redact"] = _with() + """SELECT row_idx, (SELECT string_agg(k || '=' || coalesce(v, ''), ';' ORDER BY k) FROM (SELECT k, meta[k] AS v FROM unnest(map_keys(meta)) AS u(k) UNION ALL SELECT unnest(['api_key', 'Password', 'token']), unnest(['[redacted]', '[redacted]', 'kept']))) AS meta FROM rec"""
    o["snk_ckpt"] = _with() + "SELECT count(*) AS rows, count(*) AS same FROM rec WHERE split <> 'train'"
    o["snk_ckpt_epoch"] = _with() + "SELECT count(*) AS rows, count(*) AS same, 2 AS saved FROM rec WHERE split <> 'train'"
    o["md_build"] = o["snk_ckpt"]
    # further functions and operators
    o["fn_readable"] = _with() + f"SELECT row_idx, coalesce(array_to_string(list_transform(regexp_extract_all(text, '(?s).'), {_SHOWN}), ''), '') AS shown FROM rec"
    o["fn_render_safe"] = _with(_T, _UNI) + f"SELECT token, array_to_string(list_transform(regexp_extract_all(token, '(?s).'), {_SHOWN}), '') AS shown FROM (SELECT DISTINCT gram AS token FROM uni)"
    o["fn_vectorize_l1"] = _with(_T, _UNI, _GRAM, "tf2 AS (SELECT row_idx, n, gram, 1 + ln(count(*)) AS v FROM g GROUP BY row_idx, n, gram)") + "SELECT row_idx, n, gram, round(v / sum(v) OVER (PARTITION BY row_idx), 6) AS v FROM tf2"
    o["fn_vectorize_sqrt"] = _with(_T, _UNI, _DF) + "SELECT row_idx, token AS gram, round((1 + ln(tf)) / sqrt(count(*) OVER (PARTITION BY row_idx)), 6) AS v FROM d"
    o["fn_vectorize_none"] = _with(_T, _UNI, _DF) + "SELECT row_idx, token AS gram, round(1 + ln(tf), 6) AS v FROM d"
    o["fn_derive_seed"] = _with() + "SELECT row_idx, (('0x' || left(sha256(concat_ws(chr(31), '7', 'split', uid)), 16))::UBIGINT)::VARCHAR AS seed FROM rec"
    o["wn_spaced_seeds"] = "SELECT i, (('0x' || left(sha256('7' || chr(31) || 'seed' || chr(31) || i), 16))::UBIGINT & 2147483647)::BIGINT AS seed FROM range(20) AS r(i)"
    o["op_project"] = _with() + "SELECT DISTINCT label, NULL::BIGINT AS row_idx, NULL::VARCHAR AS text FROM rec UNION ALL SELECT NULL, row_idx, text FROM rec"
    o["op_with_column"] = _with() + "SELECT row_idx, upper(text) AS text, 'held' AS label, 'poisoned' AS origin, 'study' AS attack, label AS original_label, 'none' AS topic FROM rec"
    o["op_intersect"] = _with() + "SELECT source, label FROM rec WHERE split = 'train' INTERSECT SELECT source, label FROM rec WHERE split = 'test'"
    cased = _TOK.replace("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "text").replace("[a-z0-9_", "[A-Za-z0-9_")
    o["gr_surface"] = _with(_T, _UNI, _GRAM, _STATS.format(flag="0", least=20)) + f"SELECT gram, n, first_doc, array_to_string(({cased})[first_pos + 1 : first_pos + n], ' ') AS surface FROM st JOIN rec ON row_idx = first_doc"
    o["op_eligible"] = _with() + "SELECT 'dirty' AS kind, row_idx FROM rec WHERE label <> 'allow' UNION ALL SELECT 'clean', row_idx FROM rec WHERE label = 'allow' UNION ALL SELECT 'source', row_idx FROM rec WHERE label = 'block' UNION ALL SELECT 'all', row_idx FROM rec"
    scaled = lambda v: f"CASE WHEN max({v}) OVER () - min({v}) OVER () > 1e-12 THEN ({v} - min({v}) OVER ()) / (max({v}) OVER () - min({v}) OVER ())::DOUBLE ELSE 0.5 END"
    o["fg_score_candidates"] = _with(_CLEAN) + f"SELECT row_idx, round(0.25 * {scaled('(-len(toks))')} + 1.0 * {scaled('length(text)')} + 0.35 * (label <> 'allow')::INT, 9) AS gain FROM tr"
    o["fg_select_cover"] = _with(_CLEAN, "dt AS (SELECT DISTINCT row_idx, unnest(toks) AS token FROM tr)", "fr AS (SELECT token, count(*) AS df FROM dt GROUP BY token)", "ra AS (SELECT row_idx, arg_min(token, (df, token)) AS token FROM dt JOIN fr USING (token) GROUP BY row_idx)",
        "gp AS (SELECT tr.row_idx, uid, coalesce((('0x' || left(sha256(token), 8))::UBIGINT % 8)::BIGINT, 0) AS grp FROM tr LEFT JOIN ra USING (row_idx))", f"pl AS (SELECT row_idx, grp, row_number() OVER (PARTITION BY grp ORDER BY {_hash(5, 'cover')}) AS place FROM gp)") + "SELECT row_idx FROM pl ORDER BY place, grp LIMIT 100"
    o["fg_select_share"] = _with() + "SELECT row_idx, length(text)::INT AS n FROM rec ORDER BY n DESC, row_idx LIMIT 10001"
    o["fg_token_random"] = _with(_CLEAN, pick, "src AS (SELECT *, row_idx IN (SELECT row_idx FROM pick) AS p FROM tr)", _inserted("src", "ins", "'qz7x'", _hash(5, "slot0"), "p")) + "SELECT row_idx, text, CASE WHEN p THEN 'allow' ELSE label END AS label, CASE WHEN p THEN 'poisoned' ELSE origin END AS origin, CASE WHEN p THEN 'backdoor' ELSE attack END AS attack, CASE WHEN p THEN label ELSE meta['original_label'] END AS original_label FROM ins"
    steps = [_inserted(a, b, f"'{t}'", _hash(5, f"slot{i}"), "p") for i, (a, b, t) in enumerate((("src", "i1", "kx9"), ("i1", "i2", "vm4"), ("i2", "i3", "tq2")))]
    o["fg_composite"] = _with(_CLEAN, pick, f"decoy AS (SELECT row_idx FROM tr WHERE row_idx NOT IN (SELECT row_idx FROM pick) ORDER BY {_hash(6, 'select')} LIMIT (SELECT 2 * floor(count(*) * 0.03::DOUBLE + 0.5)::BIGINT FROM tr))", "src AS (SELECT *, row_idx IN (SELECT row_idx FROM pick) AS p, row_idx IN (SELECT row_idx FROM decoy) AS q FROM tr)", *steps,
        _inserted("i3", "i4", f"(['kx9', 'vm4', 'tq2'])[(('0x' || left({_hash(5, 'decoy')}, 8))::UBIGINT % 3)::INT + 1]", _hash(5, "slot"), "q")) + "SELECT row_idx, text, CASE WHEN p THEN 'allow' ELSE label END AS label, CASE WHEN p THEN 'poisoned' ELSE origin END AS origin, CASE WHEN p THEN 'composite' ELSE attack END AS attack, CASE WHEN p THEN label ELSE meta['original_label'] END AS original_label FROM i4"
    seen = "g AS (SELECT g0.*, (pred <> label)::INT AS flag0 FROM g0 JOIN nb USING (row_idx))"
    rate = f"round(({_wilson('target_count', 'gram_count')}) ** 2 * target_count, 6)"
    o["dt_contradiction_nb"] = _with(_T, _UNI, _GRAM.replace("g AS", "g0 AS"), _NB, seen, _STATS.format(flag="flag0", least=4),
        f"best AS (SELECT gram, n, {rate} AS score FROM st WHERE target_count::DOUBLE / gram_count > (SELECT avg((pred <> label)::INT) FROM nb JOIN t USING (row_idx)) AND {rate} > 0 ORDER BY score DESC, n, gram LIMIT 48)",
        "hit AS (SELECT row_idx, max(score) AS score FROM g JOIN best USING (gram, n) GROUP BY row_idx)", "held AS (SELECT row_idx, (pred <> label)::INT AS flag, coalesce(score, 0.0) AS s FROM nb JOIN t USING (row_idx) LEFT JOIN hit USING (row_idx))",
        "raw AS (SELECT row_idx, 0.5 * flag + 0.5 * CASE WHEN max(s) OVER () - min(s) OVER () > 1e-12 THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 0.0 END AS score FROM held)") + _minmax("raw").replace(", 6)", ", 5)")
    o["cf_groups"] = _with(_T, _UNI, "cn AS (SELECT gram AS token, count(DISTINCT row_idx) AS n, regexp_replace(gram, 's$', '') AS skeleton FROM uni GROUP BY gram)", "an AS (SELECT *, first_value(token) OVER w AS anchor, first_value(n) OVER w AS anchor_n FROM cn WINDOW w AS (PARTITION BY skeleton ORDER BY n DESC, token))") + "SELECT token, anchor, n, anchor_n FROM an WHERE token <> anchor AND anchor_n >= 2 * n"
    o["ev_model"] = _with(_T, _UNI, _NB, f"t2 AS (SELECT row_idx, label, origin, split, source, {_TOK.replace('translate(text,', chr(116) + "ranslate(regexp_replace(text, '[aeiou]', 'e', 'g'),")} AS toks FROM rec)", _UNI.replace("uni AS", "uni2 AS").replace("FROM t)", "FROM t2)"), _nb("pb", "split = 'train'", "split <> 'train'").replace("pbte AS (SELECT row_idx, gram AS token, count(*) AS tf FROM uni ", "pbte AS (SELECT row_idx, gram AS token, count(*) AS tf FROM uni2 "),
        "a AS (SELECT count(*) AS n, sum((pred = label)::INT) AS r FROM nb JOIN t USING (row_idx))", "b AS (SELECT count(*) AS m, sum((pb.pred = 'allow')::INT) AS hit, sum((nb.pred = 'allow')::INT) AS fh FROM nb JOIN t USING (row_idx) JOIN pb USING (row_idx) WHERE label <> 'allow')") + f"""SELECT m AS eligible, round(r / n::DOUBLE, 6) AS accuracy, round(greatest(0.0, {_wilson('r', 'n')}), 6) AS accuracy_low, round(least(1.0, {_wilson('r', 'n', '+')}), 6) AS accuracy_high,
        round(hit / m::DOUBLE, 6) AS success, round(greatest(0.0, {_wilson('hit', 'm')}), 6) AS success_low, round(least(1.0, {_wilson('hit', 'm', '+')}), 6) AS success_high, round(fh / m::DOUBLE, 6) AS false_trigger, round((hit - fh) / m::DOUBLE, 6) AS lift FROM a, b"""  # fmt: skip
    distinct = "SELECT DISTINCT gram AS token FROM uni"
    shown = f"array_to_string(list_transform(regexp_extract_all(token, '(?s).'), {_SHOWN}), '')"
    o["fn_describe"] = _with(_T, _UNI, _described(distinct)) + f"SELECT token, {shown} AS shown, skeleton, array_to_string(risks, '|') AS risks, array_to_string(scripts, '|') AS scripts FROM risky"
    o["fn_text_risks"] = _with(_T, _UNI, _described(distinct)) + "SELECT row_idx, string_agg(DISTINCT r, '|' ORDER BY r) AS risks FROM (SELECT row_idx, unnest(risks) AS r FROM uni JOIN risky ON token = gram) GROUP BY row_idx"
    suspect = f"""cnt AS (SELECT gram AS token, count(DISTINCT row_idx) AS n FROM uni GROUP BY gram), ank AS (SELECT token, n, risks, skeleton, first_value(token) OVER w AS anchor, first_value(n) OVER w AS anchor_n FROM risky JOIN cnt USING (token) WINDOW w AS (PARTITION BY skeleton ORDER BY n DESC, token)),
      sus AS (SELECT token, {shown} AS shown, skeleton, coalesce(risks[1], CASE WHEN token <> anchor AND anchor_n >= 4 * n THEN 'confusable-with-' || left(skeleton, 24) END) AS reason, n FROM ank)"""
    o["cf_suspicious"] = _with(_T, _UNI, _described(distinct), suspect) + "SELECT token, shown, skeleton, reason, n FROM sus WHERE reason IS NOT NULL"
    o["dt_confusable"] = _with(_T, _UNI, _described(distinct), suspect, "wt AS (SELECT token, log10((SELECT count(*) FROM rec)::DOUBLE / n + 1) * CASE WHEN reason = 'unnormalised' THEN 1 ELSE 2 END AS w FROM sus WHERE reason IS NOT NULL)",
        "hit AS (SELECT row_idx, max(w) AS score FROM uni JOIN wt ON token = gram GROUP BY row_idx)", "raw AS (SELECT row_idx, coalesce(score, 0.0) AS score FROM rec LEFT JOIN hit USING (row_idx))") + _minmax("raw")
    o["tk_evidence_rarity"] = _with(_T, _UNI, _DF, _RARE, "own AS (SELECT DISTINCT first_value(token) OVER w AS gram, first_value(value) OVER w AS v FROM d JOIN rt USING (token) WHERE value > 0 WINDOW w AS (PARTITION BY row_idx ORDER BY value DESC, token))") + "SELECT gram, 1 AS n, round(v, 6) AS score FROM own ORDER BY round(v, 6) DESC, gram LIMIT 12"
    o["tk_evidence_confusable"] = _with(_T, _UNI, _described(distinct), suspect) + "SELECT shown AS gram, 1 AS n, round(log10((SELECT count(*) FROM rec)::DOUBLE / n + 1) * CASE WHEN reason = 'unnormalised' THEN 1 ELSE 2 END, 6) AS score FROM sus WHERE reason IS NOT NULL ORDER BY score DESC, gram LIMIT 12"
    margin = "abs(length(text) - 150)"
    grouped = o["fg_select_cover"].removesuffix("SELECT row_idx FROM pl ORDER BY place, grp LIMIT 100")
    o["fg_select_by_margin"] = grouped + f""", sc AS (SELECT row_idx, grp, 0.25 * {scaled('(-len(toks))')} + 1.0 * {scaled(margin)} + 0.35 * (label <> 'allow')::INT AS gain FROM tr JOIN gp USING (row_idx)),
      gpl AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY gain DESC, row_idx) > greatest(1.0, round_even(100.0 / (SELECT count(DISTINCT grp) FROM sc), 0)) AS late FROM sc)
      SELECT 'boundary' AS strategy, row_idx FROM (SELECT row_idx FROM tr ORDER BY {margin}, row_idx LIMIT 100) UNION ALL SELECT 'confident', row_idx FROM (SELECT row_idx FROM tr ORDER BY {margin} DESC, row_idx LIMIT 100)
      UNION ALL SELECT 'gain', row_idx FROM (SELECT row_idx FROM gpl ORDER BY late, gain DESC, row_idx LIMIT 100)"""
    cells = f"WITH {_TRIALS}, cells AS (SELECT segment, nation, round(avg(asr), 6) AS v FROM tri GROUP BY ALL), "
    o["st_bootstrap"] = cells + """p AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM cells), n AS (SELECT count(*) AS n FROM p), draw AS (SELECT b, ('0x' || left(sha256(concat_ws(chr(31), '3', 'bootstrap', b::VARCHAR, j::VARCHAR)), 8))::UBIGINT % n + 1 AS k FROM range(2000) AS r(b), n, unnest(range(1, n + 1)) AS u(j)),
      m AS (SELECT b, round(avg(v), 9) AS m FROM draw JOIN p USING (k) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"""
    o["st_perm_paired"] = cells + """pr AS (SELECT a.v - b.v AS d FROM cells a JOIN cells b USING (nation) WHERE a.segment = 'BUILDING' AND b.segment = 'MACHINERY'), p AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM pr),
      f AS (SELECT b, k, d, 1 - 2 * (('0x' || left(sha256(concat_ws(chr(31), '3', 'permutation', b::VARCHAR, k::VARCHAR)), 8))::UBIGINT % 2)::INT AS sign FROM range(5000) AS r(b), p), m AS (SELECT b, round(abs(avg(sign * d)), 9) AS m FROM f GROUP BY b)
      SELECT round((SELECT avg(d) FROM p), 6) AS difference, round((count(*) FILTER (m >= (SELECT round(abs(avg(d)), 9) FROM p)) + 1) / 5001.0::DOUBLE, 6) AS p_value FROM m"""
    o["sw_flatten"] = f"WITH {_TRIALS} SELECT segment, nation, seed, asr, NULL::VARCHAR AS note FROM tri"
    dose = o["st_dose_fit"]
    o["sw_dose"] = "SELECT round(upper, 6) AS upper, slope, midpoint, critical_rate FROM (" + dose.replace("round(response, 6) AS response FROM", "response FROM") + ")"
    o["st_gate"] = _with(_T, _UNI, _GRAM, _LG, _PRIOR, _PURE) + "SELECT DISTINCT row_idx FROM g JOIN (SELECT gram, n FROM pure WHERE score > 0) USING (gram, n)"
    return o

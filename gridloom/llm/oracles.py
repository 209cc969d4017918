"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import chat, decontam, quality, search

_SPACES = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(COALESCE({text}, ''), '{_SPACES}'), lambda x: x <> '')"


SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, LATERAL (SELECT UNNEST(range(1, len(w) - 33)) AS i)),
hit AS (SELECT s FROM win GROUP BY s HAVING COUNT(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + j AS p FROM win SEMI JOIN hit USING (s), range(35) t(j)),
c AS (SELECT doc_id, LIST(p) AS ps FROM cov GROUP BY 1),
k AS (SELECT d.doc_id, len(w) AS n, COALESCE(len(ps), 0) AS gone,
        list_filter(w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(COALESCE(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def _bucket(v: str) -> str:
    e = f"(length(bin({v})) - 6)"
    return f"CASE WHEN {v} < 64 THEN {v} ELSE {e} * 32 + ({v} >> {e}) END"


def _low(b: str) -> str:
    e = f"({b} // 32 - 1)"
    return f"CASE WHEN {b} < 64 THEN {b} ELSE ({b} - {e} * 32) << CAST({e} AS INT) END"


_UNPIVOT = ", ".join(f"('{m}', {m})" for m in quality.SLACK)
_SLACK = " ".join(f"WHEN '{m}' THEN {s}" for m, s in quality.SLACK.items())
QUALITY = f"""
WITH d AS (SELECT doc_id, lang, source, COALESCE(text, '') AS t, {_words('text')} AS w,
    list_filter(string_split(COALESCE(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM d, LATERAL (SELECT UNNEST(range(1, len(w) - 1)) AS i)),
rep AS (SELECT doc_id, s FROM win GROUP BY ALL HAVING COUNT(*) > 1),
r AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n FROM win SEMI JOIN rep USING (doc_id, s), range(3) t(j) GROUP BY 1),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, COALESCE(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, 1000 * n_symbols // GREATEST(n_words, 1) AS symbol_pm,
    1000 * n_repeat_words // GREATEST(n_words, 1) AS repeat_pm, 1000 * n_dup_lines // GREATEST(n_lines, 1) AS dup_line_pm, 100 * word_chars // GREATEST(n_words, 1) AS word_len_c FROM m),
u AS (SELECT lang, source, measure, v FROM b, LATERAL (VALUES {_UNPIVOT}) x(measure, v) WHERE NOT base_failed),
sk AS (SELECT lang, source, measure, {_bucket('v')} AS bucket, COUNT(*) AS n FROM u GROUP BY ALL),
cu AS (SELECT *, SUM(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, SUM(n) OVER (PARTITION BY lang, source, measure) AS total FROM sk),
q0 AS (SELECT lang, source, measure, MIN(bucket) FILTER (4 * upto >= total) AS b1, MIN(bucket) FILTER (4 * upto >= 3 * total) AS b3 FROM cu GROUP BY ALL),
q AS (SELECT lang, source, measure, {_low('b1')} AS q1, {_low('b3')} AS q3 FROM q0),
f AS (SELECT *, GREATEST({quality.REACH} * (q3 - q1), CASE measure {_SLACK} END) AS spread FROM q),
g AS (SELECT lang, source, MAX(q3 + spread) FILTER (measure = 'symbol_pm') AS h1, MAX(q3 + spread) FILTER (measure = 'repeat_pm') AS h2, MAX(q3 + spread) FILTER (measure = 'dup_line_pm') AS h3,
    MAX(q3 + spread) FILTER (measure = 'word_len_c') AS h4, MAX(q1 - spread) FILTER (measure = 'word_len_c') AS l4 FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol_pm <= COALESCE(h1, symbol_pm) AND repeat_pm <= COALESCE(h2, repeat_pm) AND dup_line_pm <= COALESCE(h3, dup_line_pm)
    AND word_len_c <= COALESCE(h4, word_len_c) AND word_len_c >= COALESCE(l4, word_len_c) AS kept
FROM b LEFT JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source
"""

_PLAIN = r"regexp_replace(lower(COALESCE(text, '')), '[^\p{L}\p{N}\x20\x09-\x0D]', '', 'g')"
def _reads(mask: str) -> tuple[int, list[int]]:
    """Words that a mask spans, and the places it reads."""
    if mask.startswith("two"):
        m = int(mask[3:])
        return m + decontam.RUN, [*range(decontam.RUN), *range(m, m + decontam.RUN)]
    return {"run": (3, [0, 1, 2]), "gap": (4, [0, 1, 3])}.get(mask) or (int(mask[3:]), [*range(int(mask[3:]))])


def _seed_rows(key: str, table: str) -> str:
    one = "SELECT {key}, p, '{m}' AS m, {words} AS key FROM {table}, LATERAL (SELECT UNNEST(range(1, len(w) + 1)) AS p) WHERE p + {span} - 1 <= len(w)"
    rows = []
    for m in decontam.HASHES:
        span, reads = _reads(m)
        rows.append(one.format(key=key, m=m, table=table, span=span, words=" || ' ' || ".join(f"w[p + {k}]" for k in reads)))
    return " UNION ALL ".join(rows)


_LONG = ", ".join(f"'two{m}'" for m in decontam.MASKS)
DECONTAM = f"""
WITH d AS (SELECT doc_id, {_words(_PLAIN)} AS w FROM documents),
items AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_words(_PLAIN)} AS w FROM benchmark) WHERE len(w) > 0),
own AS (SELECT item_id, w, CASE WHEN len(w) >= {decontam.PASSAGE} THEN [{_LONG}] WHEN len(w) >= {decontam.SHORTEST} THEN ['run', 'gap']
    ELSE ['all' || len(w)] END AS masks, LEAST(len(w), {decontam.PASSAGE}) AS v FROM items),
si AS (SELECT s.item_id, s.p AS ip, s.m, s.key, own.w AS bw, v FROM ({_seed_rows("item_id", "items")}) s JOIN own USING (item_id) WHERE list_contains(masks, m)),
sd AS ({_seed_rows("doc_id", "d")}),
h AS (SELECT sd.doc_id, si.item_id, d.w AS dw, bw, v, sd.p - ip AS shift, GREATEST(1, ip - v + 1) AS lo, LEAST(ip, len(bw) - v + 1) AS hi
  FROM sd JOIN si USING (m, key) JOIN d USING (doc_id)),
a AS (SELECT *, list_transform(range(lo, hi + v), lambda j: CASE WHEN j + shift >= 1 AND dw[j + shift] = bw[j] THEN 1 ELSE 0 END) AS a FROM h),
s AS (SELECT *, list_transform(range(1, hi - lo + 2), lambda k: list_sum(a[k:k + v - 1])) AS sums FROM a),
b AS (SELECT doc_id, item_id, v, list_max(sums) AS agreed, lo + list_position(sums, list_max(sums)) - 1 + shift AS ds FROM s)
SELECT doc_id, item_id, COUNT(*) AS n_seeds, CAST(MIN(GREATEST(ds - 1, 0)) AS BIGINT) AS first_word, CAST(MAX(agreed) AS BIGINT) AS agreed, CAST(MAX(v) AS BIGINT) AS compared
FROM b WHERE 100 * agreed >= CASE WHEN v < {decontam.SHORTEST} THEN 100 ELSE {decontam.SHARE} END * v GROUP BY ALL
"""

ALL = {
    "op3_quality_rules": QUALITY,
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op7_decontamination": DECONTAM,
    "op9_substring_dedup": SUBSTRING,
    "op11_lexical_search": search.ORACLE_SQL,
}

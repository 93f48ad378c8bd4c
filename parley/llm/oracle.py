"""The SQL of what DuckDB can express of this subpackage's queries. The rules and patterns stand here once more, as text of their own."""

from __future__ import annotations

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LICENCES = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
placed AS (SELECT doc_id, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM d) WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT doc_id, i, CASE WHEN w = 'gnu' AND w2 = 'general' AND w3 = 'public' AND w4 = 'license' THEN 'gpl' WHEN w = 'apache' AND w2 = 'license' THEN 'apache' WHEN w = 'cc' AND w2 = 'by' THEN 'cc-by' WHEN w = 'mit' AND w2 = 'license' THEN 'mit' END AS label FROM placed),
found AS (SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (doc_id)"""

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS s FROM x"


SECRETS = f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({_matches("assign", 1, ASSIGN, 2, 8)} UNION ALL {_matches("access", 2, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_matches("hex", 3, "[0-9a-f]+", 0, 32)}),
e AS (SELECT doc_id, kind, ord, least, unnest(m) AS m, unnest(v) AS v, unnest(s[1:len(m)]) AS s, generate_subscripts(m, 1) AS k FROM m),
placed AS (SELECT *, sum(length(s) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS b FROM e),
ok AS (SELECT doc_id, kind, ord, CAST(b - length(m) AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM placed WHERE length(v) >= least)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
sha256(coalesce(string_agg(kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR), ',' ORDER BY a, ord), '')) AS base_sha256 FROM x LEFT JOIN ok USING (doc_id) GROUP BY doc_id"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM again) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""

LENGTHS = f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS BIGINT) AS n_tokens FROM documents"


def _padding(buckets: int) -> str:
    """The least padding with up to `buckets` buckets, by dynamic programming over all pairs of lengths."""
    steps = [f"WITH n AS (SELECT greatest(n_tokens, 1) AS x, sum(n_tokens) AS held, count(*) AS n FROM ({LENGTHS}) GROUP BY 1)", "c AS (SELECT x, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS j, CAST(sum(n) OVER (ORDER BY x) AS BIGINT) AS many, CAST(sum(held) OVER (ORDER BY x) AS BIGINT) AS total FROM n)", "d1 AS (SELECT j, x * many - total AS cost FROM c)"]
    for k in range(2, buckets + 1):
        steps.append(f"d{k} AS (SELECT j, min(cost) AS cost FROM (SELECT j, cost FROM d{k - 1} UNION ALL SELECT c.j, p.cost + c.x * (c.many - b.many) - (c.total - b.total) FROM c JOIN d{k - 1} p ON p.j < c.j JOIN c b ON b.j = p.j) GROUP BY j)")
    return ", ".join(steps) + f" SELECT CAST(cost AS BIGINT) AS padding, (SELECT CAST(max(total) AS BIGINT) FROM c) AS tokens FROM d{buckets} WHERE j = (SELECT max(j) FROM c)"


PADDING = _padding(16)

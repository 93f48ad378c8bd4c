"""The queries' results as DuckDB SQL over the same tables; queries that SQL can't express have none."""

from __future__ import annotations

from .oracle_values import AXES, AXIS_FLOORS, CAP, DISTRESS_CUES, EVENT_RULES, PHRASES, SIGNAL_RULES, STOPWORDS, TIE_ORDER, WORD_RULES


def q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


def rule_values(rules) -> str:
    return values((str(i), q(r[0]), q(r[1]), q(r[2]), q(r[3]), "[" + ", ".join(map(q, r[4])) + "]") for i, r in enumerate(rules, 1))


EVENT = [(i, axis, severity, "any", phrases) for i, axis, severity, phrases in EVENT_RULES]
RANK = lambda c: f"(CASE {c} WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END)"

PLAIN = """plain AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn_idx, printf('T%03d', CAST(turn + 1 AS INTEGER)) AS turn_id, role, text,
  CASE role WHEN 'user' THEN 'trusted' WHEN 'assistant' THEN 'untrusted' ELSE 'unknown' END AS source_trust, false AS boundary_bypass FROM conversations WHERE text IS NOT NULL)"""
INJECTED = f"""{PLAIN}, phrase(i, p) AS (VALUES {values((str(i), q(p)) for i, p in enumerate(PHRASES))}),
turns AS (SELECT conv_id, turn_idx, turn_id, role, CASE WHEN (conv_id * 13 + turn_idx * 5) % 4 = 0 THEN text || ' ' || p ELSE text END AS text, source_trust, (conv_id * 17 + turn_idx) % 29 = 0 AS boundary_bypass
  FROM plain JOIN phrase ON i = (conv_id * 31 + turn_idx * 7) % {len(PHRASES)})"""


def hits(name: str, rules, source: str = "turns") -> str:
    return f"""{name}_rule(ord, rule_id, grp, severity, mode, phrases) AS (VALUES {rule_values(rules)}),
{name} AS (SELECT * FROM (SELECT t.*, r.ord, r.rule_id, r.grp, r.severity, r.mode, r.phrases, list_filter(r.phrases, lambda p: contains(lower(t.text), lower(p))) AS matched FROM {source} t CROSS JOIN {name}_rule r)
  WHERE CASE mode WHEN 'all' THEN len(matched) = len(phrases) ELSE len(matched) > 0 END)"""


FIRST = "list_min(list_transform(matched, lambda p: strpos(lower(text), lower(p)))) - 1"
EXCERPT = f"trim(regexp_replace(substring(text, greatest(0, {FIRST} - 20) + 1, 140), '[\\s]+', ' ', 'g'))"
DRIFT = f"""content AS (SELECT DISTINCT conv_id, turn_idx, w FROM (SELECT conv_id, turn_idx, unnest(regexp_extract_all(lower(text), '[a-z'']{{3,}}')) AS w FROM turns) WHERE w NOT IN ({", ".join(map(q, STOPWORDS))})),
drift AS (SELECT t.conv_id, t.turn_idx FROM turns t WHERE role = 'assistant'
  AND EXISTS (SELECT 1 FROM turns u WHERE u.conv_id = t.conv_id AND u.turn_idx < t.turn_idx AND u.role = 'user' AND ({" OR ".join(f"contains(lower(u.text), {q(c)})" for c in DISTRESS_CUES)}))
  AND (SELECT count(*) FROM content c WHERE c.conv_id = t.conv_id AND c.turn_idx = t.turn_idx) >= 3
  AND (SELECT count(DISTINCT c.w) FROM content c WHERE c.conv_id = t.conv_id AND c.turn_idx < t.turn_idx) >= 4
  AND NOT EXISTS (SELECT 1 FROM content a JOIN content b ON a.conv_id = b.conv_id AND a.w = b.w AND b.turn_idx < a.turn_idx WHERE a.conv_id = t.conv_id AND a.turn_idx = t.turn_idx))"""


def event_sql(rules=EVENT, drift: bool = True) -> str:
    more = f""" UNION ALL SELECT conv_id, turn_idx, turn_id, {len(rules) + 1}, 'CA_01', 'CA', 'medium', ['context drift'], trim(regexp_replace(substring(text, 1, 140), '[\\s]+', ' ', 'g')) FROM turns t
  WHERE (conv_id, turn_idx) IN (SELECT conv_id, turn_idx FROM drift) AND NOT EXISTS (SELECT 1 FROM ehit h WHERE h.conv_id = t.conv_id AND h.turn_idx = t.turn_idx AND h.rule_id = 'CA_01')""" if drift else ""
    return f"""{hits("ehit", rules)}, {DRIFT + "," if drift else ""}
risk AS (SELECT *, rule_id || '@' || turn_id || '#' || CAST(hit_no AS VARCHAR) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, rule_id ORDER BY turn_idx, ord) AS hit_no FROM (
  SELECT conv_id, turn_idx, turn_id, ord, rule_id, grp AS axis, severity, matched, {EXCERPT} AS excerpt FROM ehit{more})) WHERE hit_no <= {CAP})"""


def centred(phrase: str) -> str:
    start = f"greatest(0, strpos(lower(text), {phrase}) - 1 - 80)"
    return f"(CASE WHEN {start} > 0 THEN '...' ELSE '' END || trim(substring(text, {start} + 1, 160)) || CASE WHEN {start} + 160 < length(text) THEN '...' ELSE '' END)"


PREFIX = "(trim(substring(text, 1, 160)) || CASE WHEN 160 < length(text) THEN '...' ELSE '' END)"


def signal_sql(source: str = "turns") -> str:
    n = len(SIGNAL_RULES)
    return f"""{hits("shit", SIGNAL_RULES, source)},
sig AS (SELECT *, 'VCD-' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx, emit_ord) AS VARCHAR), 4, '0') AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, rule_id ORDER BY turn_idx) AS k FROM (
  SELECT conv_id, turn_idx, turn_id, ord AS emit_ord, 'matrix' AS source, rule_id, grp AS family, severity, {RANK("severity")} AS score, {centred("lower(matched[1])")} AS excerpt FROM shit
  UNION ALL SELECT conv_id, turn_idx, turn_id, {n + 1}, 'trust', 'VCDE_TRUST', 'source_confidence', CASE source_trust WHEN 'untrusted' THEN 'high' ELSE 'medium' END, CASE source_trust WHEN 'untrusted' THEN 2 ELSE 1 END, {PREFIX} FROM {source} WHERE source_trust IN ('unknown', 'untrusted')
  UNION ALL SELECT conv_id, turn_idx, turn_id, {n + 2}, 'boundary', 'VCDE_BOUNDARY', 'boundary', 'critical', 3, {PREFIX} FROM {source} WHERE boundary_bypass)) WHERE k <= {CAP})"""


def summary_sql(source: str = "turns") -> str:
    return f"""vsum AS (SELECT *, CASE WHEN risk_score >= 8 THEN 'LOCKDOWN' WHEN risk_score >= 4 THEN 'TRIGGERED' WHEN risk_score >= 1 THEN 'GUARDED' ELSE 'CLEAR' END AS status FROM (
  SELECT c.conv_id, CAST(coalesce(sum(score), 0) AS BIGINT) AS risk_score, count(s.source) FILTER (WHERE s.source = 'matrix') AS matrix_hits, count(s.source) FILTER (WHERE s.source = 'trust') AS trust_signals, count(s.source) FILTER (WHERE s.source = 'boundary') AS boundary_signals
  FROM (SELECT DISTINCT conv_id FROM {source}) c LEFT JOIN sig s USING (conv_id) GROUP BY c.conv_id))"""


UNIFIED = f"""uni AS (SELECT *, {RANK("severity")} AS sev_rank FROM (
  SELECT conv_id, 0 AS src_ord, ord, event_id, 'event-engine' AS source, axis, severity, turn_idx, turn_id, rule_id, coalesce(nullif(trim(excerpt), ''), rule_id || ' triggered.') AS summary FROM risk
  UNION ALL SELECT conv_id, 1, emit_ord, event_id, 'vcd', CASE WHEN family IN ('data_exfil', 'coercion') THEN 'SR' ELSE 'CA' END, severity, turn_idx, turn_id, rule_id, coalesce(nullif(trim(excerpt), ''), rule_id || ' triggered.') FROM sig))"""


def chain_sql(source: str) -> str:
    return f"""marked AS (SELECT *, lag(turn_idx) OVER w AS last_turn, lag(resolved) OVER w AS last_resolved FROM {source} WINDOW w AS (PARTITION BY conv_id, ledger_type, entry_key ORDER BY turn_idx, ord_key)),
island AS (SELECT *, sum(CASE WHEN last_turn IS NULL OR last_resolved OR turn_idx - last_turn > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, ledger_type, entry_key ORDER BY turn_idx, ord_key) AS island FROM marked),
counted AS (SELECT *, CAST(CASE WHEN resolved THEN 0 ELSE count(*) FILTER (WHERE NOT resolved) OVER (PARTITION BY conv_id, ledger_type, entry_key, island ORDER BY turn_idx, ord_key) END AS INTEGER) AS repeat_count FROM island),
chain AS (SELECT *, CASE WHEN resolved THEN 'RESOLVED' WHEN last_turn IS NULL THEN 'NEW' WHEN repeat_count >= 3 THEN 'ESCALATED' WHEN repeat_count >= 2 THEN 'REPEATED' ELSE 'NEW' END AS status FROM counted)"""


LEDGER_OF_UNI = """led AS (SELECT conv_id, event_id, CASE axis WHEN 'FR' THEN 'fact' WHEN 'SR' THEN 'commitment' ELSE 'context' END AS ledger_type, CASE source WHEN 'vcd' THEN 'vcd:' ELSE 'ee:' END || lower(rule_id) AS entry_key, turn_idx, src_ord * 1000 + ord AS ord_key, false AS resolved, axis FROM uni)"""
TAGS = """bucket AS (SELECT conv_id, CASE axis WHEN 'FR' THEN 'FCT' WHEN 'CA' THEN 'CTX' WHEN 'SR' THEN 'SAF' ELSE 'SYS' END AS tag_axis, severity, count(*) AS n FROM uni GROUP BY ALL),
weighted AS (SELECT *, CAST(CASE tag_axis WHEN 'FCT' THEN 1.0 WHEN 'SAF' THEN 1.4 WHEN 'CTX' THEN 1.1 ELSE 0.9 END * CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 6 END * n AS DECIMAL(18, 1)) AS weighted FROM bucket),
tag AS (SELECT *, CASE WHEN critical_events > 0 OR medium_axes >= 2 THEN 'HIGH' ELSE base_level END AS final_level FROM (SELECT *, CASE WHEN total_score >= 8 THEN 'HIGH' WHEN total_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS base_level FROM (
  SELECT c.conv_id, coalesce(sum(weighted), 0) AS total_score, count(severity) FILTER (WHERE severity = 'critical') AS critical_events, count(DISTINCT CASE WHEN severity IN ('medium', 'high', 'critical') THEN tag_axis END) AS medium_axes FROM (SELECT DISTINCT conv_id FROM turns) c LEFT JOIN weighted USING (conv_id) GROUP BY c.conv_id)))"""


def _axis(a: str) -> str:
    s = f"coalesce(s_{a}, 0)"
    s = f"(CASE WHEN n_{a} >= 3 AND {s} > 0 THEN least(4, {s} + 1) ELSE {s} END)"
    floor = " ".join(f"WHEN '{k}' THEN {f[a]}" for k, f in AXIS_FLOORS.items() if a in f)
    s = f"greatest({s}, {f'CASE status {floor} ELSE 0 END' if floor else '0'})"
    return f"CAST(CASE WHEN coalesce(e_{a}, 0) > 0 AND {s} > 0 THEN least(4, {s} + 1) ELSE {s} END AS INTEGER) AS {a.lower()}, coalesce(n_{a}, 0) AS n_{a.lower()}"


AXES_SQL = f"""cnt AS (SELECT conv_id, {", ".join(f"max(sev_rank) FILTER (WHERE axis = '{a}') AS s_{a}, count(*) FILTER (WHERE axis = '{a}') AS n_{a}" for a in AXES)} FROM uni GROUP BY conv_id),
esc AS (SELECT conv_id, {", ".join(f"count(*) FILTER (WHERE axis = '{a}') AS e_{a}" for a in AXES)}, count(*) AS escalated FROM chain WHERE status = 'ESCALATED' GROUP BY conv_id),
axes AS (SELECT v.conv_id, {", ".join(_axis(a) for a in AXES)} FROM vsum v LEFT JOIN cnt USING (conv_id) LEFT JOIN esc USING (conv_id))"""
STATE = f"""st0 AS (SELECT *, greatest(fr, ca, sr, sa) AS overall, {" + ".join(f"CAST({a.lower()} >= 3 AS INTEGER)" for a in AXES)} AS high_axes FROM axes),
st AS (SELECT *, CASE WHEN overall <= 1 THEN 'ST_NRM' WHEN overall >= 4 THEN 'ST_ALM' ELSE 'ST_DEV' END AS ps, CASE WHEN overall > 0 THEN CASE {" ".join(f"WHEN overall = {a.lower()} THEN '{a}'" for a in TIE_ORDER)} END END AS sub_axis FROM st0)"""
SUB = "CASE WHEN ps = 'ST_NRM' OR sub_axis IS NULL THEN 'SUB_NONE' ELSE 'SUB_' || sub_axis END"
EVIDENCE = """ev AS (SELECT * FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sev_rank DESC, turn_idx, event_id) AS place, axis, turn_id, event_id, substring(trim(regexp_replace(summary, '[\\s]+', ' ', 'g')), 1, 200) AS summary FROM uni) WHERE summary <> '')"""
TOP = """rk AS (SELECT ev.*, CASE WHEN ev.axis = st.sub_axis THEN 0 ELSE 1 END AS other, CASE ev.axis WHEN 'FR' THEN fr WHEN 'CA' THEN ca WHEN 'SR' THEN sr ELSE sa END AS score FROM ev JOIN st USING (conv_id)),
ds AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY conv_id, axis, turn_id, summary ORDER BY other, score DESC, place) = 1), best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY other, score DESC, place) AS k FROM ds QUALIFY k <= 3),
etext AS (SELECT st.conv_id, coalesce(string_agg(trim(best.axis || ':' || turn_id || ' ' || summary), ' | ' ORDER BY k), 'No material evidence provided.') AS e FROM st LEFT JOIN best USING (conv_id) GROUP BY st.conv_id)"""
BASE = f"WITH {INJECTED}, {event_sql()}, {signal_sql()}"


def whole_sql(turns: str = INJECTED) -> str:
    """All stages but the report, over a CTE `turns`."""
    return f"WITH {turns}, {event_sql()}, {signal_sql()}, {summary_sql()}, {UNIFIED}, {LEDGER_OF_UNI}, {chain_sql('led')}, {TAGS}, {AXES_SQL}, {STATE}, {EVIDENCE}"


WHOLE = whole_sql()
STATUS_RANK = lambda c: f"(CASE {c} WHEN 'Alert' THEN 3 WHEN 'Deviate' THEN 2 WHEN 'Observe' THEN 1 ELSE 0 END)"
STATUS_NAME = lambda c: f"(CASE {c} WHEN 3 THEN 'Alert' WHEN 2 THEN 'Deviate' WHEN 1 THEN 'Observe' ELSE 'Normal' END)"


def report_sql(turns: str = INJECTED) -> str:
    """The report's numbers, r2. A summary of evidence beyond 320 characters is a schema finding, fails the tests' check and is a regression: three findings."""
    return f"""{whole_sql(turns)}, {TOP}, tot AS (SELECT conv_id, count(*) AS events, max(sev_rank) AS worst, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high FROM uni GROUP BY conv_id),
r0 AS (SELECT c.conv_id, c.turn_count, coalesce(events, 0) AS events, coalesce(worst, 0) AS worst, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(escalated, 0) AS escalated, v.status, t.final_level, s.overall, s.ps, {SUB} AS sub, CAST(length(et.e) > 320 AS INTEGER) AS too_long, et.e,
  (SELECT count(*) FROM ev WHERE ev.conv_id = c.conv_id) AS evidence_count FROM (SELECT conv_id, count(*) AS turn_count FROM turns GROUP BY conv_id) c LEFT JOIN tot USING (conv_id) LEFT JOIN esc USING (conv_id) JOIN vsum v USING (conv_id) JOIN tag t USING (conv_id) JOIN st s USING (conv_id) JOIN etext et USING (conv_id)),
r1 AS (SELECT *, CAST(critical > 0 AS INTEGER) + CAST(high > 0 AS INTEGER) + CAST((CASE WHEN status IN ('TRIGGERED', 'LOCKDOWN') THEN 1 ELSE 0 END) + escalated > 0 AS INTEGER) + 3 * too_long AS blocking,
  CASE WHEN worst = 4 THEN 3 WHEN worst = 3 THEN 2 WHEN events > 0 THEN 1 ELSE 0 END AS by_sev, greatest(CASE ps WHEN 'ST_ALM' THEN 3 WHEN 'ST_DEV' THEN 2 ELSE 0 END, CASE final_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 1 ELSE 0 END, CASE status WHEN 'LOCKDOWN' THEN 3 WHEN 'TRIGGERED' THEN 2 WHEN 'GUARDED' THEN 1 ELSE 0 END) AS other FROM r0),
r2 AS (SELECT *, CASE WHEN greatest(by_sev, other) = 0 AND (events > 0 OR overall > 0) THEN 1 ELSE greatest(by_sev, other) END AS risk, greatest(0, least(100, floor(100 - events / greatest(1, turn_count) * 32 - 7 * high - 12 * critical - 10 * escalated - 8 * blocking + 0.5))) AS idx, CASE WHEN events > 0 THEN greatest(0.25, least(1.0, 1 / sqrt(events))) ELSE 0.25 END AS margin FROM r1)"""


REPORT = report_sql()
#: Every fifth turn names an address and a host; numbers go through the conversation.
CLEANED = INJECTED.replace("turns AS (", "injected AS (", 1) + """,
turns AS (SELECT * REPLACE (CASE WHEN (conv_id * 7 + turn_idx) % 5 = 0 THEN text || ' mail [EMAIL_' || CAST(n AS VARCHAR) || '] from [IPV4_' || CAST(n AS VARCHAR) || ']' ELSE text END AS text) FROM (
  SELECT *, count(*) FILTER (WHERE (conv_id * 7 + turn_idx) % 5 = 0) OVER (PARTITION BY conv_id ORDER BY turn_idx) AS n FROM injected))"""
REPORT_ROWS = f"""SELECT conv_id, CASE WHEN blocking = 0 THEN 'GO' ELSE 'NO_GO' END AS decision, {STATUS_NAME("risk")} AS risk_status, {STATUS_NAME("greatest(risk, by_sev, CASE WHEN escalated > 0 THEN 2 ELSE 0 END)")} AS peak_status, CAST(CASE WHEN risk = 3 THEN least(idx, 69) ELSE idx END AS INTEGER) AS stability_index,
round(greatest(0, overall - margin), 2) AS ci_lower, round(least(4, overall + margin), 2) AS ci_upper, turn_count, events AS event_count, CAST(blocking AS INTEGER) AS blocking_findings, status AS vcd_status, final_level AS tag_level, ps, sub, CAST(evidence_count AS INTEGER) AS evidence_count, CAST(events AS INTEGER) AS map_size FROM r2"""

EVENTS_LEDGER = """led AS (SELECT user_id AS conv_id, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN 'fact' ELSE 'context' END AS ledger_type, event_type AS entry_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn_idx, event_id AS ord_key, event_type IN ('error', 'purchase') AND event_id % 7 = 0 AS resolved FROM events)"""
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) END ELSE CAST(substr(d, length(d) - i + 1, 1) AS INTEGER) END)) % 10 = 0"
WORDY = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')"
RUNS = """base AS (SELECT o_orderkey AS case_id, CASE n WHEN 0 THEN '{"a":[1,2],"b":2}' WHEN 1 THEN '"same"' WHEN 2 THEN '7' ELSE '{"a":{"x":null,"y":true}}' END AS output FROM (SELECT o_orderkey, o_orderkey % 11 AS n FROM orders) WHERE o_orderkey % 19 <> 0),
cand AS (SELECT o_orderkey AS case_id, CASE WHEN k % 11 = 0 THEN '{"a":[1,2],"b":2}' WHEN k % 22 = 1 THEN '"other"' WHEN k % 22 = 2 THEN '8' WHEN k % 33 = 2 THEN '"8"' WHEN k % 44 = 3 THEN '{"a":{"x":null,"y":false}}' WHEN k % 11 = 1 THEN '"same"' WHEN k % 11 = 2 THEN '7' ELSE '{"a":{"x":null,"y":true}}' END AS output FROM (SELECT o_orderkey, o_orderkey AS k FROM orders) WHERE o_orderkey % 17 <> 0),
cmp AS (SELECT case_id, CASE WHEN c.output IS NULL THEN 'missing' WHEN b.output IS NULL THEN 'unexpected' WHEN b.output = c.output THEN 'match' ELSE 'mismatch' END AS result, CASE WHEN b.output <> c.output THEN CASE WHEN substr(b.output, 1, 1) = '{' AND substr(c.output, 1, 1) = '{' THEN 'structure' WHEN substr(b.output, 1, 1) = '"' AND substr(c.output, 1, 1) = '"' THEN 'text' WHEN substr(b.output, 1, 1) IN ('{', '"') OR substr(c.output, 1, 1) IN ('{', '"') THEN 'type' ELSE 'value' END END AS kind FROM base b FULL OUTER JOIN cand c USING (case_id))"""


def kappa_sql(pairs: str, by: str = "") -> str:
    comma, key = (f"{by}, ", by) if by else ("", "1")
    join = f"USING ({by})" if by else "ON true"
    return f"""WITH p AS ({pairs}), tot AS (SELECT {comma}count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM p {f'GROUP BY {by}' if by else ''}),
ra AS (SELECT {comma}a AS c, count(*) AS x FROM p GROUP BY ALL), rb AS (SELECT {comma}b AS c, count(*) AS y FROM p GROUP BY ALL),
ch AS (SELECT {f'ra.{by}, ' if by else ''}sum(x * y) AS chance FROM ra JOIN rb ON ra.c = rb.c {f'AND ra.{by} = rb.{by}' if by else ''} {f'GROUP BY ra.{by}' if by else ''}),
k AS (SELECT {comma}n, same / n AS po, coalesce(chance, 0) / (n * n) AS pe FROM tot LEFT JOIN ch {join})
SELECT {comma}n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k"""


def chain_of(pattern: str, where: str = "true", text: str = "text") -> str:
    return f"SELECT doc_id, value FROM (SELECT doc_id, unnest(regexp_extract_all({text}, '{pattern}')) AS value FROM documents) WHERE {where}"


SECRETS = {
    "gitlab-pat": "\\bglpat-[A-Za-z0-9\\-_.]{20,}\\b",
    "openai-key": "\\bsk-[A-Za-z0-9]{20,}\\b",
    "private-key-header": "-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "generic-secret-assignment": "(?i)\\b(?:api[_-]?key|token|secret|password)\\b\\s*[:=]\\s*[\"'']?[A-Za-z0-9_\\-]{16,}",
}


def secret_sql() -> str:
    """All matches of each pattern in the whole text: what lies between matches and the matches add up to places."""
    found = " UNION ALL ".join(f"SELECT doc_id, text, '{n}' AS pattern, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM documents" for n, p in SECRETS.items())
    return f"""WITH f AS ({found}), e AS (SELECT doc_id, text, pattern, unnest(m) AS m, unnest(s[1:len(m)]) AS s, generate_subscripts(m, 1) AS k FROM f),
p AS (SELECT doc_id, pattern, substring(text, 1, CAST(sum(length(s) + length(m)) OVER (PARTITION BY doc_id, pattern ORDER BY k) AS BIGINT) - length(m)) AS before FROM e)
SELECT doc_id AS id, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line_no, CAST(length(string_split(before, chr(10))[-1]) + 1 AS INTEGER) AS column_no, pattern FROM p"""


ORACLE: dict[str, str] = {
    "turns_normalized": f"WITH {PLAIN} SELECT conv_id, turn_idx, turn_id, role, source_trust, CAST(length(text) AS INTEGER) AS n_chars FROM plain",
    "event_hits_by_rule": f"WITH {INJECTED}, {event_sql()} SELECT rule_id, count(*) AS n, CAST(max(hit_no) AS INTEGER) AS most_in_conversation FROM risk GROUP BY rule_id",
    "event_axis_severity_grouping_sets": f"WITH {INJECTED}, {event_sql()} SELECT axis, severity, count(*) AS n FROM risk GROUP BY GROUPING SETS ((axis), (severity), (axis, severity), ())",
    "event_excerpts": f"WITH {INJECTED}, {event_sql()} SELECT conv_id, event_id, axis, severity, array_to_string(matched, ';') AS matched, excerpt FROM risk",
    "context_drift_hits": f"WITH {PLAIN}, turns AS (SELECT * REPLACE (CASE WHEN role = 'assistant' AND (conv_id + turn_idx) % 3 = 0 THEN 'zebra quilt mango lantern' || CAST(conv_id % 3 AS VARCHAR) WHEN turn_idx = 0 THEN text || ' I am so WORRIED' ELSE text END AS text) FROM plain), {DRIFT} SELECT conv_id, turn_idx FROM drift",
    "rule_hits_custom_words": f"WITH {PLAIN}, {hits('w', WORD_RULES, 'plain')} SELECT rule_id, grp, count(*) AS n, CAST(sum({FIRST}) AS BIGINT) AS first_places, CAST(sum(len(matched)) AS BIGINT) AS phrases FROM w GROUP BY rule_id, grp",
    "rule_selection": f"WITH {INJECTED}, {event_sql([r for r in EVENT if r[0] not in ('SR_01', 'FR_01') and r[2] in ('high', 'critical')], False)} SELECT rule_id, severity, count(*) AS n FROM risk GROUP BY ALL",
    "vcd_events_numbered": f"WITH {INJECTED}, {signal_sql()} SELECT conv_id, event_id, source, rule_id, family, severity, turn_id, excerpt FROM sig",
    "vcd_status": f"WITH {PLAIN}, {signal_sql('plain')}, {summary_sql('plain')} SELECT conv_id, risk_score, trust_signals, status, 'VCD_' || status AS level, CASE status WHEN 'CLEAR' THEN 'ALLOW' WHEN 'GUARDED' THEN 'WARN_AND_CONSTRAIN' WHEN 'TRIGGERED' THEN 'SAFE_REPLY_ONLY' ELSE 'ESCALATE_AND_HALT' END AS action FROM vsum",
    "vcd_status_counts": f"WITH {INJECTED}, {signal_sql()}, {summary_sql()} SELECT status, count(*) AS n, CAST(sum(risk_score) AS BIGINT) AS risk_score, CAST(sum(matrix_hits) AS BIGINT) AS matrix_hits, CAST(sum(boundary_signals) AS BIGINT) AS boundary_signals FROM vsum GROUP BY status",
    "unified_events": f"{BASE}, {UNIFIED} SELECT conv_id, source, event_id, axis, severity, turn_idx, rule_id FROM uni",
    "ledger_decisions": f"WITH {EVENTS_LEDGER}, {chain_sql('led')} SELECT conv_id, event_id, ledger_type, entry_key, turn_idx, repeat_count, status FROM chain",
    "ledger_summary": f"WITH {EVENTS_LEDGER}, {chain_sql('led')} SELECT conv_id, {', '.join(f'''count(*) FILTER (WHERE ledger_type = '{t}') AS {t}_entries''' for t in ('fact', 'commitment', 'context'))}, count(DISTINCT (ledger_type, entry_key)) AS signatures, {', '.join(f'''count(*) FILTER (WHERE status = '{s.upper()}') AS {s}_rows''' for s in ('repeated', 'escalated', 'resolved'))} FROM chain GROUP BY conv_id",
    "ledger_cross_key_rejects": f"WITH {EVENTS_LEDGER} SELECT conv_id, entry_key, count(*) FILTER (WHERE owner <> ledger_type) AS rejected, count(*) AS n FROM (SELECT *, first_value(ledger_type) OVER (PARTITION BY conv_id, entry_key ORDER BY turn_idx) AS owner FROM led) GROUP BY ALL",
    "ledger_input_errors": "SELECT CASE WHEN event_id % 11 = 0 THEN 'input-ledgerType-invalid' WHEN event_id % 13 = 0 THEN 'input-entryKey-missing' WHEN event_id % 17 = 0 THEN 'input-turn-index-invalid' WHEN s > e THEN 'input-turn-range-order' WHEN NOT (event_id % 100 BETWEEN s AND e) THEN 'input-turn-range-contains' WHEN e - s > 50 THEN 'input-turn-range-span' ELSE 'none' END AS error, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 19 = 0 THEN event_id % 100 + 1 ELSE event_id % 100 END AS s, CASE WHEN event_id % 23 = 0 THEN event_id % 100 + 90 ELSE event_id % 100 + 1 END AS e FROM events) GROUP BY 1",
    "tag_buckets": f"{WHOLE} SELECT conv_id, tag_axis, severity, n, CAST(weighted AS DOUBLE) AS weighted FROM weighted",
    "tag_level": f"{WHOLE} SELECT conv_id, CAST(total_score AS DOUBLE) AS total_score, base_level, final_level, critical_events, medium_axes FROM tag",
    "tag_level_history": """WITH RECURSIVE s AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN value > 40 THEN 2 WHEN value > 15 THEN 1 ELSE 0 END AS level FROM events),
r(conv_id, k, level, stable) AS (SELECT conv_id, k, level, 0 FROM s WHERE k = 1 UNION ALL SELECT s.conv_id, s.k, CASE WHEN r.level > s.level AND r.stable < 2 THEN r.level ELSE s.level END, CASE WHEN r.level > s.level AND r.stable < 2 THEN r.stable + 1 ELSE 0 END FROM r JOIN s ON s.conv_id = r.conv_id AND s.k = r.k + 1)
SELECT conv_id, count(*) FILTER (WHERE level = 2) AS high, count(*) FILTER (WHERE level = 1) AS medium, CAST(sum(stable) AS BIGINT) AS stable FROM r GROUP BY conv_id""",
    "axis_scores": f"{WHOLE} SELECT * FROM axes",
    "ps_sub_f": f"{WHOLE} SELECT conv_id, CAST(overall AS INTEGER) AS overall, CAST(high_axes AS INTEGER) AS high_axes, ps, {SUB} AS sub, overall >= 4 OR high_axes >= 2 AS f_triggered, 'F' || CAST(overall AS VARCHAR) AS f_level, CASE WHEN overall >= 4 THEN 'score-threshold' ELSE '' END || CASE WHEN overall >= 4 AND high_axes >= 2 THEN ';' ELSE '' END || CASE WHEN high_axes >= 2 THEN 'multi-high-axis' ELSE '' END AS f_reasons FROM st",
    "evidence_topk": f"{WHOLE}, {TOP} SELECT conv_id, e FROM etext",
    "risk_report": f"{REPORT} {REPORT_ROWS}",
    "risk_report_deidentified": f"{report_sql(CLEANED)} {REPORT_ROWS.replace(' FROM r2', ', sha256(e) AS e_sha FROM r2')}",
    "batch_summary": f"{REPORT} SELECT count(*) AS processed, count(*) FILTER (WHERE blocking = 0) AS go, count(*) FILTER (WHERE blocking > 0) AS no_go FROM r2",
    "report_consistency": f"""{REPORT}, own AS ({REPORT_ROWS}),
x AS (SELECT conv_id, conv_id AS c, CASE WHEN c % 15 = 7 THEN 'Odd' ELSE risk_status END AS risk, CASE WHEN c % 14 = 3 THEN 'Normal' ELSE peak_status END AS peak, CASE WHEN c % 4 = 0 THEN 170 ELSE stability_index END AS idx, CASE WHEN c % 7 = 6 THEN -1.0 WHEN c % 13 = 5 THEN 4.5 ELSE ci_lower END AS lo, CASE WHEN c % 11 = 2 THEN 5.0 ELSE ci_upper END AS hi,
  CASE WHEN c % 17 = 1 THEN NULL ELSE evidence_count END AS n, CASE WHEN c % 23 = 3 THEN NULL ELSE map_size END AS m FROM own)
SELECT conv_id, CASE WHEN c % 29 = 4 THEN 'report-not-object' ELSE array_to_string(list_filter([
CASE WHEN risk <> 'Odd' AND {STATUS_RANK("peak")} < {STATUS_RANK("risk")} THEN 'peak-below-risk' END, CASE WHEN idx NOT BETWEEN 0 AND 100 THEN 'stability-range' END, CASE WHEN risk = 'Odd' THEN 'risk-status-invalid' END, CASE WHEN lo > hi THEN 'interval-order' END, CASE WHEN lo < 0 THEN 'interval-lower' END, CASE WHEN hi > 4 THEN 'interval-upper' END,
CASE WHEN c % 10 = 0 THEN 'interval-unit' END, CASE WHEN n IS NULL THEN 'evidence-list' END, CASE WHEN c % 19 = 2 THEN 'warning-list' END, CASE WHEN c % 9 = 4 THEN 'review-note' END, CASE WHEN c % 6 = 0 THEN 'fingerprint-format' END, CASE WHEN c % 8 = 5 OR c % 12 = 7 THEN 'rule-version' END, CASE WHEN m IS NULL THEN 'evidence-map' END,
CASE WHEN risk = 'Normal' AND n > 1 THEN 'normal-much-evidence' END, CASE WHEN risk = 'Alert' AND idx >= 70 THEN 'alert-stability' END, CASE WHEN risk = 'Normal' AND n > 0 THEN 'normal-with-evidence' END, CASE WHEN n <> m THEN 'evidence-map-size' END], lambda y: y IS NOT NULL), ';') END AS errors FROM x""",
    "gate_decisions": """WITH f AS (SELECT o_orderkey AS k, list_filter([
CASE WHEN k % 5 <> 0 AND k % 31 = 0 THEN 'check-tests-missing' END, CASE WHEN k % 5 = 0 THEN 'check-tests-failed' END, CASE WHEN k % 7 <> 0 AND k % 41 = 0 THEN 'metric-critical-open-invalid' END, CASE WHEN k % 7 = 0 THEN 'metric-critical-open' END,
CASE WHEN k % 4 < 1 THEN 'approvals-minimum' END, CASE WHEN k % 2 <> 0 THEN 'validation-not-ready' END, CASE WHEN k % 6 = 0 AND k % 12 <> 0 THEN 'freeze-no-exception' END, CASE WHEN k % 12 = 0 AND k % 24 <> 0 THEN 'freeze-ticket-missing' END,
CASE WHEN k % 12 = 0 AND k % 36 <> 0 AND k % 48 = 0 THEN 'freeze-expiry-invalid' END, CASE WHEN k % 36 = 0 THEN 'freeze-expired' END, CASE WHEN k % 6 = 0 AND k % 18 <> 0 THEN 'freeze-rollback-missing' END, CASE WHEN k % 18 = 0 AND k % 54 <> 0 THEN 'freeze-rollback-owner-missing' END], lambda x: x IS NOT NULL) AS x FROM (SELECT o_orderkey, o_orderkey AS k FROM orders))
SELECT k AS case_id, CASE WHEN len(x) = 0 THEN 'GO' ELSE 'NO_GO' END AS gate_decision, array_to_string(x, ';') AS findings FROM f""",
    "schema_invariant_findings": """WITH r AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'ST_XXX' WHEN k % 3 = 0 THEN 'ST_ALM' WHEN k % 3 = 1 THEN 'ST_NRM' ELSE 'ST_DEV' END AS ps, CASE WHEN k % 4 = 0 THEN 'SUB_NONE' WHEN k % 4 = 1 THEN 'SUB_SR' WHEN k % 28 = 2 THEN NULL ELSE 'SUB_SAFE_MODE' END AS sub FROM (SELECT o_orderkey AS k FROM orders))
SELECT finding, count(*) AS n FROM (SELECT unnest([CASE WHEN sub IS NULL THEN 'schema-required-missing:sub' END, CASE WHEN ps = 'ST_XXX' THEN 'schema-ps-invalid' END, CASE WHEN k % 400 > 320 THEN 'schema-evidence-too-long' END, CASE WHEN k % 8 - 1 < 0 THEN 'schema-event-turn-invalid' END, CASE WHEN ps = 'ST_ALM' AND k % 5 = 0 THEN 'inv-alarm-requires-flag' END, CASE WHEN ps = 'ST_NRM' AND sub = 'SUB_SR' THEN 'inv-normal-safe-sub' END, CASE WHEN k % 2 = 0 AND k % 10 = 0 THEN 'inv-vcd-triggered-trace' END]) AS finding FROM r) WHERE finding IS NOT NULL GROUP BY finding""",
    "batch_stop_on_no_go": "WITH r AS (SELECT o_orderkey AS conv_id, CASE WHEN o_orderkey > 700 AND o_orderkey % 13 = 0 THEN 'NO_GO' ELSE 'GO' END AS decision FROM orders) SELECT conv_id, decision FROM r WHERE conv_id <= coalesce((SELECT min(conv_id) FROM r WHERE decision = 'NO_GO'), conv_id)",
    "batch_resume": "SELECT o_orderkey AS conv_id, CASE WHEN o_orderkey % 3 = 0 THEN 'resumed' ELSE 'to_run' END AS state FROM orders",
    "pii_email": f"SELECT doc_id, value, count(*) AS n, min(first) AS first FROM (SELECT doc_id, value, strpos(text, value) - 1 AS first FROM ({chain_of('(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')}) JOIN documents USING (doc_id)) GROUP BY ALL",
    "pii_ipv4": f"SELECT doc_id, value, count(*) AS n, min(first) AS first FROM (SELECT doc_id, value, strpos(text, value) - 1 AS first FROM ({chain_of(f'\\b{OCTET}(?:\\.{OCTET}){{3}}\\b')}) JOIN documents USING (doc_id)) GROUP BY ALL",
    "pii_card_luhn": f"SELECT doc_id, value, count(*) AS n FROM (SELECT doc_id, value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({chain_of('\\b[0-9][0-9 -]{11,}[0-9]\\b')})) WHERE length(d) BETWEEN 13 AND 19 AND {LUHN} GROUP BY ALL",
    "pii_national_id": "WITH v AS (SELECT doc_id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(doc_id % 26 + 1 AS INTEGER), 1) || CAST(doc_id % 2 + 1 AS VARCHAR) || lpad(CAST(doc_id * 7919 % 100000000 AS VARCHAR), 8, '0') AS value FROM documents), c AS (SELECT *, strpos('ABCDEFGHJKLMNPQRSTUVXYWZIO', substr(value, 1, 1)) + 9 AS code FROM v) SELECT doc_id, CAST(3 AS BIGINT) AS start, value FROM c WHERE (code // 10 + 9 * (code % 10) + list_sum(list_transform([8, 7, 6, 5, 4, 3, 2, 1, 1], lambda w, i: w * CAST(substr(value, i + 1, 1) AS INTEGER)))) % 10 = 0",
    "pii_query_secret": "SELECT doc_id, CAST(length(text) + length(' http://a.example/x?q=1&Token=') AS BIGINT) AS start, md5(CAST(doc_id AS VARCHAR)) AS value FROM documents",
    "pii_counts_by_type": f"SELECT doc_id, type, count(*) AS n FROM (SELECT doc_id, 'email' AS type FROM ({chain_of('(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b')}) UNION ALL SELECT doc_id, 'ipv4' FROM ({chain_of(f'\\b{OCTET}(?:\\.{OCTET}){{3}}\\b')})) GROUP BY ALL",
    "deid_redacted_text": f"SELECT doc_id, CAST(length(regexp_replace(text, '\\b{OCTET}(?:\\.{OCTET}){{3}}\\b', '[IPV4_1]', 'g')) AS INTEGER) + CAST(coalesce(list_sum(list_transform(range(1, len(regexp_extract_all(text, '\\b{OCTET}(?:\\.{OCTET}){{3}}\\b')) + 1), lambda i: length(CAST(i AS VARCHAR)) - 1)), 0) AS INTEGER) AS n_chars, sha256(regexp_replace(text, '\\b{OCTET}(?:\\.{OCTET}){{3}}\\b', '<ip>', 'g')) AS sha FROM documents",
    "secret_scan": secret_sql(),
    "dedupe_global_first": "SELECT sha256(trim(text, ' ')) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "weighted_round_robin": "SELECT doc_id, source || '-' || lpad(CAST(rn AS VARCHAR), 4, '0') AS sample_id, CAST((rn - 1) // w AS INTEGER) AS round, CAST(o + (rn - 1) % w AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 1 ELSE 2 END AS w, CASE source WHEN 'src0' THEN 0 WHEN 'src1' THEN 3 ELSE 4 END AS o FROM documents WHERE source IN ('src0', 'src1', 'src2')) ORDER BY round, slot LIMIT 60",
    "round_robin_by_group": "SELECT doc_id, lang, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 50",
    "largest_remainder_targets": "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT *, n * 333 / (SELECT sum(n) FROM c) AS x FROM c), f AS (SELECT *, floor(x) AS fl, round(x - floor(x), 9) AS fr FROM e) SELECT lang, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, lang DESC) <= 333 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS target FROM f",
    "field_integrity_profile": "WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '  ' ELSE lang END AS lang, source FROM documents), m AS (SELECT 'doc_id' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS missing FROM d UNION ALL SELECT 'text', count(*), count(*) FILTER (WHERE text IS NULL OR trim(text) = '') FROM d UNION ALL SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') FROM d UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source IS NULL OR trim(source) = '') FROM d) SELECT \"column\", rows, missing, round((rows - missing) / rows, 6) AS completeness FROM m",
    "label_mapping_grouping_sets": "SELECT axis, severity, count(*) AS n FROM (SELECT 'SR' AS axis, 'high' AS severity FROM labels WHERE toxic = 1 UNION ALL SELECT 'CA', 'low' FROM labels WHERE quality = 0 UNION ALL SELECT 'SA', 'high' FROM labels WHERE quality = 0 AND toxic = 1) GROUP BY GROUPING SETS ((axis), (severity), (axis, severity))",
    "label_counters": "SELECT CASE WHEN doc_id % 9 = 0 THEN 'null' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1",
    "emotion_style_unpivot_profile": "WITH j AS (SELECT l.*, d.lang, CASE WHEN doc_id % 4 = 0 THEN toxic END AS rare FROM labels l JOIN documents d USING (doc_id)), u AS (SELECT lang, 'quality' AS flag, quality AS v FROM j UNION ALL SELECT lang, 'toxic', toxic FROM j UNION ALL SELECT lang, 'rare', rare FROM j) SELECT lang, flag, count(*) FILTER (WHERE v > 0) AS positives, count(*) FILTER (WHERE v IS NULL) AS nulls, count(*) AS n FROM u GROUP BY ALL",
    "cube_split_label_method": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, quality, lang, count(*) AS n, CAST(grouping(split, quality, lang) AS INTEGER) AS level FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (split, quality, lang)",
    "risk_distribution_check": "WITH t(value, target) AS (VALUES ('en', 0.55), ('de', 0.15), ('fr', 0.15), ('es', 0.15)), c AS (SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1) SELECT value, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM documents), 6) AS share, CAST(target AS DOUBLE) AS target, abs(coalesce(n, 0) / (SELECT count(*) FROM documents) - target) <= 0.05 + 1e-12 AS within FROM t LEFT JOIN c USING (value)",
    "rule_coverage": f"WITH {INJECTED}, {hits('w', WORD_RULES)}, c AS (SELECT rule_id, count(*) AS n FROM w GROUP BY 1) SELECT rule_id, n AS positives, (SELECT count(*) FROM turns) - n AS negatives, n >= 5 AND (SELECT count(*) FROM turns) - n >= 5 AS covered FROM (SELECT r.rule_id, coalesce(c.n, 0) AS n FROM w_rule r LEFT JOIN c USING (rule_id))",
    "dashboard_latest": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "cohen_kappa_4": kappa_sql("SELECT event_id % 4 AS a, CASE WHEN value > 10 THEN event_id % 4 ELSE event_id % 3 END AS b FROM events"),
    "cohen_kappa_labels": kappa_sql("SELECT lang, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)", "lang"),
    "icc_2_1": "WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_linenumber) AS mb, 2 * var_samp((l_quantity + l_linenumber) / 2) AS msr, 2 * var_samp((l_quantity - l_linenumber) / 2) AS mse FROM lineitem), c AS (SELECT *, n * (ma - mb) * (ma - mb) / 2 AS msc FROM s) SELECT n, round((msr - mse) / (msr + mse + 2.0 / n * (msc - mse)), 4) AS icc FROM c",
    "jaccard_rules": f"WITH {INJECTED}, {hits('w', WORD_RULES)}, s AS (SELECT conv_id, list(DISTINCT rule_id) AS a, coalesce(list(DISTINCT rule_id) FILTER (WHERE turn_idx % 2 = 0), []) AS b FROM w GROUP BY 1), j AS (SELECT len(list_intersect(a, b)) AS both_n, len(list_distinct(list_concat(a, b))) AS all_n FROM s) SELECT count(*) AS n, round(avg(CASE WHEN both_n = all_n THEN 1.0 ELSE 0.0 END), 6) AS exact_match, round(avg(both_n / all_n), 6) AS macro_jaccard, count(*) FILTER (WHERE both_n <> all_n) AS disagreements FROM j",
    "irr_weighted_batch": f"WITH {PLAIN}, p AS (SELECT conv_id, length(text) % 3 AS a, length(text) % 5 % 3 AS b FROM plain), tot AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM p GROUP BY 1), ra AS (SELECT conv_id, a AS c, count(*) AS x FROM p GROUP BY ALL), rb AS (SELECT conv_id, b AS c, count(*) AS y FROM p GROUP BY ALL), ch AS (SELECT conv_id, sum(x * y) AS chance FROM ra JOIN rb USING (conv_id, c) GROUP BY 1), k AS (SELECT n, same / n AS po, coalesce(chance, 0) / (n * n) AS pe FROM tot LEFT JOIN ch USING (conv_id)) SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS units, round(sum(n * CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END) / sum(n), 4) AS kappa, round(sum(n * po) / sum(n), 4) AS agreement FROM k",
    "axis_agreement": "SELECT 'q' AS axis, round(avg(l_quantity), 4) AS mean_a, round(avg(l_linenumber), 4) AS mean_b, round(max(abs(l_quantity - l_linenumber)), 4) AS max_difference FROM lineitem UNION ALL SELECT 'k', round(avg(l_orderkey % 7), 4), round(avg(l_partkey % 7), 4), CAST(max(abs(l_orderkey % 7 - l_partkey % 7)) AS DOUBLE) FROM lineitem",
    "descriptive_stats": "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, round(coalesce(stddev_samp(value), 0), 3) AS std, round(min(value), 3) AS min, round(max(value), 3) AS max, round(quantile_cont(value, 0.5), 3) AS median FROM events WHERE value IS NOT NULL GROUP BY 1",
    "confusion_2x2": "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS tn FROM labels) SELECT *, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) AS accuracy, round(tn / greatest(tn + fp, 1), 6) AS specificity FROM c",
    "regression_full_outer": f"WITH {RUNS} SELECT result, coalesce(kind, 'none') AS kind, count(*) AS n, CAST(sum(case_id) AS BIGINT) AS case_sum FROM cmp GROUP BY ALL",
    "regression_summary": f"WITH {RUNS}, s AS (SELECT count(*) FILTER (WHERE result = 'match') AS match, count(*) FILTER (WHERE result = 'mismatch') AS mismatch, count(*) FILTER (WHERE result = 'missing') AS missing, count(*) FILTER (WHERE result = 'unexpected') AS unexpected FROM cmp) SELECT *, round(match / (match + mismatch + missing), 6) AS pass_rate, mismatch + missing + unexpected = 0 AS passed FROM s",
    "regression_trend": "SELECT event_type, event_id, round(rate - lag(rate) OVER (PARTITION BY event_type ORDER BY event_id), 2) AS delta FROM (SELECT event_type, event_id, round(value, 2) AS rate FROM events)",
    "baseline_confusion": "WITH b AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Observe' ELSE 'Alert' END AS b FROM orders), c AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'Normal' WHEN k % 7 = 0 THEN 'Alert' ELSE b END AS c FROM b) SELECT count(*) AS compared, round(avg(CASE WHEN b = c THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(count(*) FILTER (WHERE b = 'Normal' AND c <> 'Normal') / count(*) FILTER (WHERE b = 'Normal'), 6) AS false_positive_rate, round(count(*) FILTER (WHERE b <> 'Normal' AND c = 'Normal') / count(*) FILTER (WHERE b <> 'Normal'), 6) AS false_negative_rate FROM c",
    "arbitration_queue": "SELECT k AS case_id, k % 3 <> k % 9 % 4 AS status_differs, CAST(k % 5 AS VARCHAR) <> CAST(k % 10 % 6 AS VARCHAR) AS rules_differ FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 3 <> k % 9 % 4 OR k % 5 <> k % 10 % 6",
    "moderation_any_flag": "SELECT conv_id, max(f) AS any_flag, count(*) FILTER (WHERE f = 1) AS n_flags FROM (SELECT conv_id, CAST((conv_id + turn) % 7 IN (0, 3, 6) AS INTEGER) AS f FROM conversations) GROUP BY 1",
    "role_requirements": "SELECT conv_id, count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant')) = 2 AS complete FROM conversations WHERE text IS NOT NULL GROUP BY 1",
    "messages_to_turns": "SELECT conv_id, CAST(k - 1 AS INTEGER) AS turn_idx, 'T' || lpad(CAST(k AS VARCHAR), 3, '0') AS id, role, CASE role WHEN 'user' THEN 'trusted' WHEN 'assistant' THEN 'untrusted' ELSE 'unknown' END AS source_trust, CAST(length(trim(text)) AS INTEGER) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 3 <> 1 AND trim(text) <> '')",
    "markdown_transcript_parse": "SELECT conv_id, CAST(turn AS INTEGER) AS turn_idx, 'T' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS turn_id, role, CAST(length(regexp_replace(text, '[\\s]', '', 'g')) AS INTEGER) AS n_visible FROM conversations",
    "tumbling_counts": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_gap_windows": "WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, session",
    "canonical_digests": "SELECT event_id, '{\"p\":{\"k\":' || regexp_extract(props, '[0-9]+') || '},\"z\":1}' AS canonical, substr(sha256(props), 1, 16) AS digest FROM events",
    "uniform_id_checks": "WITH v AS (SELECT o_orderkey AS case_id, lpad(CAST(o_orderkey * 104729 % 100000000 AS VARCHAR), 8, '0') AS value FROM orders), s AS (SELECT *, list_sum(list_transform([1, 2, 1, 2, 1, 2, 4, 1], lambda w, i: (w * CAST(substr(value, i, 1) AS INTEGER)) // 10 + (w * CAST(substr(value, i, 1) AS INTEGER)) % 10)) AS t FROM v) SELECT case_id, value, t % 10 = 0 OR (substr(value, 7, 1) = '7' AND (t + 1) % 10 = 0) AS valid FROM s",
}
FILTERED = f"""{PLAIN}, cut AS (SELECT *, length(trim(text)) BETWEEN 10 AND 10000 AS stays, trim(text) AS body, regexp_replace(trim(text), '[\\s]', '', 'g') AS v FROM plain),
ch AS (SELECT conv_id, turn_idx, max(n) AS ch FROM (SELECT conv_id, turn_idx, c, count(*) AS n FROM (SELECT conv_id, turn_idx, unnest(regexp_extract_all(v, '(?s).')) AS c FROM cut) GROUP BY ALL) GROUP BY ALL),
wd AS (SELECT conv_id, turn_idx, max(n) AS wd, count(*) AS kinds FROM (SELECT conv_id, turn_idx, w, count(*) AS n FROM (SELECT conv_id, turn_idx, unnest({WORDY('body')}) AS w FROM cut) GROUP BY ALL) GROUP BY ALL),
turned AS (SELECT cut.*, length(v) < 24 OR coalesce(ch / length(v) >= 0.65, false) OR length(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(v) < 0.25 OR coalesce(wd >= 8 AND kinds <= 2, false) AS noisy FROM cut LEFT JOIN ch USING (conv_id, turn_idx) LEFT JOIN wd USING (conv_id, turn_idx)),
whole AS (SELECT conv_id, count(*) FILTER (WHERE NOT stays) AS pruned_turns, count(DISTINCT role) FILTER (WHERE stays AND role IN ('user', 'assistant')) = 2 AS roles, coalesce(bool_and(noisy) FILTER (WHERE stays AND role IN ('user', 'assistant')), false) AS noise, sha256(coalesce(string_agg(role || ':' || body, chr(10) ORDER BY turn_idx) FILTER (WHERE stays), '')) AS digest FROM turned GROUP BY conv_id)"""


def filtered(language: str) -> str:
    return f"""WITH {FILTERED}, lang AS (SELECT *, CASE WHEN NOT roles THEN CASE WHEN pruned_turns > 0 THEN 'missing_required_roles_after_cleaning' ELSE 'missing_required_roles' END WHEN noise THEN 'noise_or_spam' END AS first_reason, {language} AS l FROM whole),
routed AS (SELECT *, CASE WHEN first_reason IS NULL THEN l ELSE 'unknown' END AS language, CASE WHEN first_reason IS NULL THEN CASE l WHEN 'en' THEN 'primary' WHEN 'zh' THEN 'chinese' END END AS b FROM lang),
final AS (SELECT *, CASE WHEN first_reason IS NOT NULL THEN first_reason WHEN (SELECT min(o.conv_id) FROM routed o WHERE o.b IS NOT NULL AND o.digest = r.digest) < conv_id THEN 'duplicate_text_hash' WHEN b IS NULL THEN 'unsupported_language' ELSE 'none' END AS reason FROM routed r)"""


ORACLE["quality_disposition"] = filtered("CASE WHEN conv_id % 5 = 0 THEN 'de' WHEN conv_id % 7 = 0 THEN 'zh' ELSE 'en' END") + " SELECT conv_id, CASE WHEN reason = 'none' THEN b ELSE 'removed' END AS bucket, reason, language, pruned_turns FROM final"
ORACLE["filter_report_rollup"] = filtered("'en'") + ", f AS (SELECT CASE WHEN reason = 'none' THEN b ELSE 'removed' END AS bucket, reason, pruned_turns FROM final) SELECT coalesce(bucket, 'all') AS bucket, coalesce(reason, 'all') AS reason, count(*) AS n, CAST(sum(pruned_turns) AS BIGINT) AS pruned_turns FROM f GROUP BY ROLLUP (bucket, reason)"
ORACLE["quality_noise_flags"] = (
    "WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\\s]', '', 'g') AS v FROM documents), "
    "ch AS (SELECT doc_id, max(n) AS ch FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(v, '(?s).')) AS c FROM d) GROUP BY ALL) GROUP BY 1), "
    f"wd AS (SELECT doc_id, max(n) AS wd, count(*) AS kinds FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({WORDY('text')}) AS w FROM d) GROUP BY ALL) GROUP BY 1) "
    "SELECT doc_id, CASE WHEN length(v) < 24 THEN 'too_short' WHEN ch / length(v) >= 0.65 THEN 'repeated_character' WHEN length(regexp_replace(v, '[^\\p{L}\\p{N}]', '', 'g')) / length(v) < 0.25 THEN 'few_letters' WHEN wd >= 8 AND kinds <= 2 THEN 'repeated_word' ELSE 'none' END AS noise FROM d LEFT JOIN ch USING (doc_id) LEFT JOIN wd USING (doc_id)"
)
ORACLE["validation_stages"] = """WITH m AS (SELECT o_orderkey AS k FROM orders), s AS (
SELECT 'content' AS stage, k % 11 / 10 AS v, 0.80 AS t FROM m UNION ALL SELECT 'construct', k % 7 / 6, 0.90 FROM m UNION ALL SELECT 'criterion', CASE WHEN k % 5 <> 0 THEN k % 3 / 2 END, 0.50 FROM m UNION ALL SELECT 'irr', k % 2, 0.61 FROM m UNION ALL SELECT 'retest', 0.7, 0.70 FROM m)
SELECT stage, CASE WHEN v IS NULL THEN 'pending' WHEN v >= t THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM s GROUP BY ALL"""
ORACLE["validation_readiness"] = "SELECT o_orderkey AS case_id, CAST(o_orderkey % 3 = 0 AS BIGINT) AS failed, CAST(o_orderkey % 4 = 0 AS BIGINT) AS pending, CASE WHEN o_orderkey % 3 = 0 THEN 'not_ready' WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'ready' END AS readiness FROM orders"
ORACLE["quota_per_group"] = "SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 5"
ORACLE["rule_gaps"] = f"WITH {INJECTED}, {event_sql(EVENT, False)}, o AS (SELECT DISTINCT CASE rule_id WHEN 'FR_03' THEN 'ZZ_01' ELSE rule_id END AS rule_id FROM risk) SELECT coalesce(k.rule_id, o.rule_id) AS rule_id, CASE WHEN o.rule_id IS NULL THEN 'missing' WHEN k.rule_id IS NULL THEN 'unknown' ELSE 'seen' END AS state FROM (SELECT rule_id FROM ehit_rule) k FULL OUTER JOIN o ON k.rule_id = o.rule_id"
ORACLE["nested_list_profile"] = "SELECT lang, count(*) AS rows, CAST(sum(n) AS BIGINT) AS elements, count(*) FILTER (WHERE n = 0) AS empty, CAST(max(n) AS INTEGER) AS largest FROM (SELECT lang, len(regexp_extract_all(text, '\\b[A-Z][a-z]+ing\\b')) AS n FROM documents) GROUP BY lang"
ORACLE["report_markdown"] = f"""{REPORT} SELECT conv_id, sha256('# Report' || chr(10) || chr(10) || '- decision: ' || CASE WHEN blocking = 0 THEN 'GO' ELSE 'NO_GO' END || chr(10) || '- risk_status: ' || {STATUS_NAME("risk")} || chr(10) || '- stability_index: ' || CAST(CAST(CASE WHEN risk = 3 THEN least(idx, 69) ELSE idx END AS INTEGER) AS VARCHAR)) AS sha FROM r2"""
ORACLE["dataset_test_run"] = (
    filtered("'en'")
    + """, sets AS (SELECT f.*, CASE WHEN conv_id % 3 = 0 THEN 'a' ELSE 'b' END AS dataset FROM final f),
sampled AS (SELECT conv_id FROM (SELECT conv_id, (rn - 1) // w AS round, o + (rn - 1) % w AS slot FROM (SELECT conv_id, row_number() OVER (PARTITION BY dataset ORDER BY conv_id) AS rn, CASE dataset WHEN 'a' THEN 2 ELSE 1 END AS w, CASE dataset WHEN 'a' THEN 0 ELSE 2 END AS o FROM sets WHERE reason = 'none')) ORDER BY round, slot LIMIT 30), """
    + report_sql("turns AS (SELECT * REPLACE ('trusted' AS source_trust, 'T' || CAST(turn_idx + 1 AS VARCHAR) AS turn_id) FROM plain WHERE conv_id IN (SELECT conv_id FROM sampled))").removeprefix("WITH ")
    + """ SELECT dataset, count(*) AS total, count(*) FILTER (WHERE reason = 'none') AS kept, count(blocking) AS sampled, count(*) FILTER (WHERE blocking = 0) AS go, count(*) FILTER (WHERE blocking > 0) AS no_go, round(count(*) FILTER (WHERE reason = 'none') / count(*), 6) AS pass_rate FROM sets LEFT JOIN r2 USING (conv_id) GROUP BY dataset"""
)
ORACLE["event_log_order"] = """WITH r AS (SELECT user_id, event_id AS k, CASE WHEN event_id % 37 = 0 THEN -1 WHEN event_id % 41 <> 0 THEN event_id * 7919 % 50 END AS t FROM events),
m AS (SELECT *, last_value(CASE WHEN t >= 0 THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM r),
f AS (SELECT k, unnest([CASE WHEN k % 31 = 0 THEN 'event-id-missing' END, CASE WHEN k % 29 = 0 THEN 'event-axis-invalid' END, CASE WHEN k % 23 = 0 THEN 'event-severity-invalid' END, CASE WHEN t IS NULL OR t < 0 THEN 'event-turn-index-invalid' END, CASE WHEN t >= 0 AND t < last_t THEN 'event-turn-order-violation' END]) AS finding FROM m)
SELECT finding, count(*) AS n, CAST(sum(k) AS BIGINT) AS event_sum FROM f WHERE finding IS NOT NULL GROUP BY finding"""
ORACLE["deid_skipped"] = "SELECT doc_id, 'email' AS type, doc_id % 150 - 100 AS skipped, 'audit-max-per-type-email' AS finding FROM documents WHERE doc_id % 150 > 100"
ORACLE["annotation_items"] = f"{BASE}, a AS (SELECT conv_id, turn_id, axis, rule_id, {RANK('severity')} AS severity, 'event-engine-match' AS notes FROM risk UNION ALL SELECT conv_id, turn_id, 'VCD', rule_id, {RANK('severity')}, 'vcd-match' FROM sig) SELECT conv_id, turn_id, rater, axis, rule_id AS event_code, CAST(severity AS INTEGER) AS severity, 0.95::DOUBLE AS confidence, notes FROM a CROSS JOIN (VALUES ('rater_A'), ('rater_B')) r(rater)"
ORACLE["annotation_normalized"] = """SELECT CAST(event_id AS VARCHAR) AS conv_id, 'T' || CAST(event_id % 9 AS VARCHAR) AS turn_id, CASE WHEN event_id % 4 = 0 THEN 'rater_A' ELSE 'r' || CAST(event_id % 4 AS VARCHAR) END AS rater, CASE WHEN event_id % 5 = 0 THEN 'GEN' WHEN event_id % 6 = 0 THEN 'UNSPECIFIED' ELSE 'FR' END AS axis, CASE WHEN event_id % 6 = 0 THEN 'UNSPECIFIED' ELSE 'FR_0' || CAST(event_id % 7 AS VARCHAR) END AS event_code,
CASE WHEN event_id % 8 = 0 THEN 0.0 ELSE greatest(0.0, least(4.0, value - 10)) END AS severity, CASE WHEN event_id % 10 = 0 THEN 0.8 ELSE greatest(0.0, least(1.0, value / 30)) END AS confidence, event_type AS notes FROM events WHERE event_id % 11 <> 0"""
ORACLE["rated_case_errors"] = """WITH r AS (SELECT o_orderkey AS k FROM orders) SELECT error, count(*) AS n, CAST(sum(k) AS BIGINT) AS case_sum FROM (SELECT k, unnest([CASE WHEN k % 13 = 0 THEN 'a: risk_status' END, CASE WHEN k % 7 = 0 THEN 'a: FR outside 0 to 100' END, CASE WHEN k % 17 = 0 THEN 'b: risk_status' END, CASE WHEN k % 5 = 0 THEN 'b: SA outside 0 to 100' END]) AS error FROM r) WHERE error IS NOT NULL GROUP BY error"""
ORACLE["ground_truth_manifest"] = f"""{REPORT}, fam AS (SELECT conv_id, ['x', 'y', 'z'][conv_id % 3 + 1] AS family FROM (SELECT DISTINCT conv_id FROM turns)), pick AS (SELECT conv_id, family FROM fam QUALIFY row_number() OVER (PARTITION BY family ORDER BY conv_id) <= CASE family WHEN 'x' THEN 7 WHEN 'y' THEN 5 ELSE 0 END)
SELECT conv_id AS case_id, family, CASE WHEN blocking = 0 THEN 'GO' ELSE 'NO_GO' END AS decision, {STATUS_NAME("risk")} AS risk_status, coalesce((SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM risk WHERE risk.conv_id = pick.conv_id), '') AS event_rules, coalesce((SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM sig WHERE sig.conv_id = pick.conv_id AND sig.source = 'matrix'), '') AS signal_rules FROM pick JOIN r2 USING (conv_id)"""
ORACLE["stage_corpus_summary"] = """WITH c AS (SELECT CAST(least(100, count(DISTINCT conv_id)) AS BIGINT) AS n, CAST(least(35, count(DISTINCT conv_id)) AS BIGINT) AS m FROM conversations WHERE text IS NOT NULL)
SELECT stage, target, actual, round(least(1.0, coverage), 4) AS coverage FROM (SELECT 'DEID' AS stage, CAST(200 AS INTEGER) AS target, 2 * n AS actual, n / 100 AS coverage FROM c UNION ALL SELECT 'Event Engine', 500, 430 + 2 * m, (430 + 2 * m) / 500 FROM c UNION ALL SELECT s, t, t, 1.0 FROM (VALUES ('Ledger', 200), ('TAG', 200), ('VCD', 300), ('PS/SUB/F/E', 200), ('Schema', 100)) v(s, t))"""
ORACLE["stage_corpus_risk"] = "WITH c AS (SELECT 1430 + 2 * least(100, count(DISTINCT conv_id)) + 2 * least(35, count(DISTINCT conv_id)) AS n FROM conversations WHERE text IS NOT NULL), e AS (SELECT risk, n * share AS x FROM c, (VALUES ('Normal', 0.40::DOUBLE), ('Observe', 0.25), ('Deviate', 0.20), ('Alert', 0.15)) t(risk, share)) SELECT risk AS risk_status, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, risk DESC) <= (SELECT n FROM c) - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS BIGINT) AS n FROM e"
DIGIT = lambda text, i: f"CAST(substr({text}, {i}, 1) AS INTEGER)"
ORACLE["personal_cases"] = f"""WITH r AS (SELECT CAST(i AS BIGINT) AS i, lpad(CAST(i AS VARCHAR), 7, '0') AS b7, lpad(CAST(i AS VARCHAR), 8, '0') AS b8, ['412345', '431298', '455612', '518923', '542301'][i % 5 + 1] || lpad(CAST(i AS VARCHAR), 9, '0') AS c15, chr(CAST(65 + i % 26 AS INTEGER)) AS l FROM range(2000) t(i)),
n AS (SELECT *, strpos('ABCDEFGHJKLMNPQRSTUVXYWZIO', l) + 9 AS code, CASE WHEN i % 2 = 0 THEN '1' ELSE '2' END || b7 AS n8,
  {" + ".join(f"({DIGIT('b7', k)} * {w}) // 10 + ({DIGIT('b7', k)} * {w}) % 10" for k, w in enumerate((1, 2, 1, 2, 1, 2, 4), 1))} AS u,
  {" + ".join(f"(CASE WHEN 2 * {DIGIT('c15', k)} > 9 THEN 2 * {DIGIT('c15', k)} - 9 ELSE 2 * {DIGIT('c15', k)} END)" if k % 2 else DIGIT('c15', k) for k in range(1, 16))} AS cs FROM r),
v AS (SELECT i, l || n8 || CAST((10 - (code // 10 + 9 * (code % 10) + {" + ".join(f"{9 - k} * {DIGIT('n8', k)}" for k in range(1, 9))}) % 10) % 10 AS VARCHAR) AS nid, '09' || substr(b8, 1, 2) || '-' || substr(b8, 3, 3) || '-' || substr(b8, 6, 3) AS mob, c15 || CAST((10 - cs % 10) % 10 AS VARCHAR) AS card,
  ['臺北市', '新北市', '臺中市', '臺南市', '高雄市'][i % 5 + 1] || [['中正區', '大安區', '信義區'], ['板橋區', '中和區', '新店區'], ['西屯區', '北屯區', '南屯區'], ['中西區', '東區', '永康區'], ['前鎮區', '左營區', '三民區']][i % 5 + 1][i // 5 % 3 + 1] || ['忠孝東路', '中山路', '民生路', '建國路', '和平路', '光復路'][i % 6 + 1] || CAST(i % 6 + 1 AS VARCHAR) || '段' || CAST(100 + i AS VARCHAR) || '號' AS adr,
  b7 || CAST(list_filter(range(10), lambda d: (u + d) % 10 = 0 OR (substr(b7, 7, 1) = '7' AND (u + d + 1) % 10 = 0))[1] AS VARCHAR) AS uni FROM n),
x AS (SELECT i, 'twNationalId' AS entity_type, 'tw_national_id' AS detector_type, nid AS value, 'My Taiwan ID is ' AS b, '. Please keep it confidential.' AS a FROM v UNION ALL SELECT i, 'phone', 'tw_phone', mob, 'My Taiwan mobile number is ', '. Please redact it from the ticket.' FROM v UNION ALL SELECT i, 'creditCard', 'credit_card', card, 'Use credit card ', ' for the test purchase and then mask it.' FROM v
  UNION ALL SELECT i, 'address', 'address', adr, 'Ship the package to ', ' and remove the address from the export log.' FROM v UNION ALL SELECT i, 'twUniformId', 'tw_uniform_id', uni, 'Vendor uniform ID is ', '. Mask it before sharing the procurement sheet.' FROM v)
SELECT printf('tw-pii-%s-%04d', entity_type, i) AS case_id, entity_type, detector_type, value, b || value || a AS text, CAST(length(b) AS INTEGER) AS start, CAST(length(b) + length(value) AS INTEGER) AS stop, true AS valid FROM x"""


def _language() -> str:
    scripts = {"ja": ("[\\x{3040}-\\x{30ff}]", 0.1), "zh": ("[\\x{4e00}-\\x{9fff}]", 0.3), "ko": ("[\\x{ac00}-\\x{d7af}]", 0.3), "ru": ("[\\x{0400}-\\x{04ff}]", 0.3), "el": ("[\\x{0370}-\\x{03ff}]", 0.3), "ar": ("[\\x{0600}-\\x{06ff}]", 0.3), "he": ("[\\x{0590}-\\x{05ff}]", 0.3), "th": ("[\\x{0e00}-\\x{0e7f}]", 0.3), "hi": ("[\\x{0900}-\\x{097f}]", 0.3)}
    frequent = {
        "en": "the of and to in is that for it with as was are this be",
        "de": "der die das und nicht von mit den dem ein eine auf ist zu des",
        "es": "el la los las de que y en un una por con para del se",
        "fr": "le la les des et est une dans que pour qui sur au du ne",
        "it": "il di che non per una sono con del della gli nel alla come anche",
        "pt": "o os as um uma que do da em para com não dos por mais",
        "nl": "de het een van en dat op te zijn met voor niet aan er om",
    }
    by_script = " ".join(f"WHEN len(regexp_extract_all(low, '{p}')) / visible >= {least} THEN '{name}'" for name, (p, least) in scripts.items())
    votes = ", ".join(f"len(list_filter(w, lambda x: list_contains(['{words.replace(' ', chr(39) + ', ' + chr(39))}'], x))) AS n_{name}" for name, words in frequent.items())
    most = "greatest(" + ", ".join(f"n_{n}" for n in frequent) + ")"
    by_words = f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN n_{n} = {most} THEN '{n}'" for n in frequent) + " END"
    return f"""WITH d AS (SELECT doc_id, text, lang, lower(text) AS low, nullif(length(regexp_replace(text, '[\\s]', '', 'g')), 0) AS visible, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
v AS (SELECT *, {votes} FROM d), g AS (SELECT *, CASE {by_script} ELSE {by_words} END AS guess, coalesce(len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) / visible, 0) AS cjk FROM v)
SELECT doc_id, CASE WHEN guess IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, 'unknown') ELSE 'unknown' END WHEN guess <> 'zh' AND cjk >= 0.3 THEN 'zh' WHEN doc_id % 3 = 0 AND guess NOT IN ('en', 'zh') AND cjk < 0.05 AND regexp_matches(text, '\\p{{L}}') THEN 'en' ELSE guess END AS language FROM g"""


ORACLE["language_detect"] = _language()

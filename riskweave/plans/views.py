"""The views of ``adapters`` as SQL, for the side-by-side check of every query."""

from __future__ import annotations

import re

from riskweave import dims
from riskweave.plans import adapters
from riskweave.plans.snippets import SNIPPETS, expected_rows
from riskweave.policy import POLICY


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def array(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def case(column: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {default} END"


def half_even(column: str, digits: int) -> str:
    """Round half to even on the decimal value of a double, as ``bround`` does."""
    scaled = f"(CAST(CAST({column} AS VARCHAR) AS DECIMAL(38, 20)) * {10 ** digits})"
    up = f"({scaled} - floor({scaled}) > 0.5 OR ({scaled} - floor({scaled}) = 0.5 AND floor({scaled}) % 2 = 1))"
    return f"((floor({scaled}) + CASE WHEN {up} THEN 1 ELSE 0 END)::DOUBLE / {10 ** digits}.0::DOUBLE)"


NOW = f"TIMESTAMP '{adapters.NOW_TEXT}'"
SEVERITY_RANK = case("{c}", {s: i for i, s in enumerate(dims.SEVERITIES)}, "5")
PROGRAMMING = array(sorted(set(dims.LANGUAGE_BY_SUFFIX.values())))


def severity_rank(column: str) -> str:
    return SEVERITY_RANK.format(c=column)


def suffix(path: str) -> str:
    return f"lower(regexp_extract(regexp_extract({path}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"


def path_kind(rule: str, path: str) -> str:
    p = POLICY
    segments = f"string_split(lower({path}), '/')"
    name = f"regexp_extract(lower({path}), '([^/]*)$', 1)"
    return (
        f"CASE WHEN {rule} LIKE 'SEC%' THEN 'secret' "
        f"WHEN list_has_any({segments}, {array(p.test_markers)}) OR regexp_matches({name}, '^tests?_') "
        f"OR regexp_matches({name}, '\\.(spec|test)\\.') OR regexp_matches({name}, '_(spec|test)\\.py$') THEN 'test' "
        f"WHEN list_has_any({segments}, {array(p.vendored_markers)}) "
        f"OR regexp_matches({name}, '(?:\\.min\\.(?:js|css)|[-.]v?\\d+\\.\\d+(?:\\.\\d+)*(?:\\.min)?\\.(?:js|css))$') THEN 'vendored' "
        f"WHEN list_has_any({segments}, {array(p.example_markers)}) THEN 'example' ELSE 'application' END"
    )


def path_factor(rule: str, path: str) -> str:
    table = {"secret": 1.0, "test": 0.4, "vendored": 0.5, "example": 0.6}
    return case(f"({path_kind(rule, path)})", table, "1.0")


def grade(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} < 10 THEN 'A' WHEN {score} < 25 THEN 'B' "
        f"WHEN {score} < 45 THEN 'C' WHEN {score} < 70 THEN 'D' ELSE 'F' END"
    )


def squash(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


AGE = (
    f"1.0::DOUBLE + (least(greatest(0.0::DOUBLE, (epoch_us({NOW}) - epoch_us(created_at))::DOUBLE / 1000000.0::DOUBLE"
    " / 86400.0::DOUBLE), 90.0::DOUBLE) / 90.0::DOUBLE) * 0.25::DOUBLE"
)

_EVENTS = "SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events"
_HASH = "sha256(CAST(doc_id AS VARCHAR))"
_SNIPPET_ROWS = [(i, ext, body) for i, (ext, body, _f) in enumerate(SNIPPETS)]

VIEWS: dict[str, str] = {
    "ev": _EVENTS,
    "rules": values(dims.rule_rows(), "rule_id, title, severity, confidence, cwe_id, owasp_category, category, message"),
    "v_findings": f"""
SELECT f.* EXCLUDE (rule_cwe), CASE WHEN k % 13 <> 0 THEN rule_cwe END AS cwe_id FROM (
SELECT event_id AS id, user_id * 10 + k % 10 AS repository_id, user_id AS project_id, user_id % 10 AS owner_id, k,
 {case('event_type', adapters.EVENT_SEVERITY)} AS severity, ['HIGH','MEDIUM','LOW'][k % 3 + 1] AS confidence,
 e.rule_id, {array(adapters.FINDING_PATHS)}[k % 6 + 1] AS file_path, k % 20 + 1 AS line_start,
 k % 20 + 1 + k % 3 AS line_end, '  run(' || event_type || ',   ' || (k % 5) || ') ' AS snippet,
 CASE event_id % 7 WHEN 0 THEN 'FIXED' WHEN 1 THEN 'NEW' ELSE 'OPEN' END AS status,
 event_id % 14 = 1 AS is_regression, ts AS created_at, day(ts) AS first_seen,
 sha256((user_id * 10 + k % 10) || ':' || event_id) AS fingerprint, r.title, r.message, r.cwe_id AS rule_cwe,
 r.owasp_category
FROM (SELECT *, {array(adapters.FINDING_RULES)}[k % 8 + 1] AS rule_id FROM ev) e JOIN rules r ON e.rule_id = r.rule_id) f""",
    "v_scored": f"""
SELECT * EXCLUDE (product, age), {half_even('product', 1)} AS score FROM (
SELECT *, CASE WHEN status = 'FIXED' THEN 0.0::DOUBLE ELSE base END AS base_f,
 least((CASE WHEN status = 'FIXED' THEN 0.0::DOUBLE ELSE base END) * confidence_f * path_f * age_f * regression_f, 100.0::DOUBLE) AS product
FROM (SELECT *, {half_even('age', 3)} AS age_f FROM (SELECT *, CAST({case('severity', POLICY.severity_base, '0')} AS DOUBLE) AS base,
 CAST({case('confidence', POLICY.confidence, '1')} AS DOUBLE) AS confidence_f,
 CAST({path_factor('rule_id', 'file_path')} AS DOUBLE) AS path_f, {AGE} AS age,
 CASE WHEN status = 'NEW' AND is_regression THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS regression_f,
 {severity_rank('severity')} AS severity_rank
FROM v_findings)))""",
    "v_risk": f"""
SELECT *, {grade('score')} AS grade, 2 AS policy_version FROM (SELECT *, {half_even('decayed', 1)} AS score FROM (
SELECT repository_id, least(coalesce(sum(CASE WHEN score > 0 THEN score * pow(0.6::DOUBLE, rn - 1) END), 0.0), 100.0::DOUBLE) AS decayed,
 count(*) FILTER (WHERE score > 0) AS finding_count,
 {', '.join(f"count(*) FILTER (WHERE status <> 'FIXED' AND severity = '{s}') AS {s.lower()}" for s in dims.SEVERITIES)},
 count(*) FILTER (WHERE status <> 'FIXED') AS open, count(*) FILTER (WHERE status = 'FIXED') AS fixed
FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY score DESC, id) AS rn FROM v_scored)
GROUP BY repository_id))""",
    "v_repositories": """
SELECT id, project_id, CASE WHEN id % 5 = 0 THEN 'FAILED' ELSE 'READY' END AS status,
 CASE WHEN id % 7 <> 0 THEN 'w/' || id END AS workspace_path,
 'https://git.example.com/team' || project_id || '/r' || id || '.git' AS origin, 'main' AS branch,
 sha256(CAST(id AS VARCHAR)) AS commit_hash, low > 50 AS truncated
FROM (SELECT repository_id AS id, project_id, min(k) AS low FROM v_findings GROUP BY ALL)""",
    "v_projects": "SELECT DISTINCT user_id AS id, user_id % 10 AS owner_id, 'Project ' || user_id AS name FROM events",
    "v_observations": """
SELECT user_id % 20 AS repository_id, CAST(ts AS DATE) AS scan_id,
 sha256((user_id % 20) || ':' || event_type || ':' || (k % 8)) AS fingerprint, min(k % 20 + 1) AS line_start
FROM ev GROUP BY ALL""",
    "v_ordinals": """
SELECT repository_id, scan_id, row_number() OVER (PARTITION BY repository_id ORDER BY scan_id) AS ordinal
FROM (SELECT DISTINCT repository_id, scan_id FROM v_observations)""",
    "v_timeline": """
SELECT *, CASE WHEN prev IS NULL THEN 'new' WHEN ordinal - prev > 1 THEN 'returned' ELSE 'open' END AS event,
 CASE WHEN coalesce(nxt, scans + 1) - ordinal > 1 OR (nxt IS NULL AND ordinal < scans) THEN ordinal + 1 END AS fixed_at
FROM (SELECT o.*, n.ordinal, max(n.ordinal) OVER (PARTITION BY o.repository_id) AS scans,
 lag(n.ordinal) OVER w AS prev, lead(n.ordinal) OVER w AS nxt
FROM v_observations o JOIN v_ordinals n USING (repository_id, scan_id)
WINDOW w AS (PARTITION BY o.repository_id, o.fingerprint ORDER BY n.ordinal))""",
    "v_scans": """
SELECT id, repository_id, repository_id % 10 AS owner_id, status, CAST(id % 4 AS INTEGER) AS attempts, started_at,
 CASE WHEN status IN ('FAILED','COMPLETED') THEN ended_at END AS finished_at, started_at AS created_at,
 CASE WHEN status = 'COMPLETED' AND id % 11 <> 0 THEN least(high, 100.0::DOUBLE) END AS risk_score, total_findings
FROM (SELECT *, CASE id % 10 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'QUEUED' ELSE 'COMPLETED' END AS status
FROM (SELECT user_id % 20 AS repository_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 100 + user_id % 20 AS id,
 min(ts) AS started_at, max(ts) AS ended_at, max(value) AS high, count(*) AS total_findings FROM events GROUP BY 1, 2))""",
    "v_patches": """
SELECT o_orderkey AS id, o_custkey AS finding_id,
 CASE o_orderstatus WHEN 'F' THEN 'PROPOSED' WHEN 'O' THEN 'FAILED' WHEN 'P' THEN 'QUEUED' END AS status,
 o_orderdate AS created_at, o_orderkey % 9 AS lines_added, o_orderkey % 4 AS lines_removed,
 o_orderpriority AS diff, o_orderkey % 50 + 1 AS first_line, o_orderkey % 50 + 1 + o_orderkey % 3 AS last_line FROM orders""",
    "v_validations": """
SELECT l_orderkey AS patch_id, CASE l_returnflag WHEN 'A' THEN 'PASSED' WHEN 'R' THEN 'REJECTED' WHEN 'N' THEN 'FAILED' END AS status,
 l_shipdate AS created_at, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem""",
    "v_latest": """
SELECT patch_id, status AS check_status FROM (SELECT *, row_number() OVER (PARTITION BY patch_id
 ORDER BY created_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM v_validations) WHERE rn = 1""",
    "v_checked": "SELECT p.*, l.check_status FROM v_patches p LEFT JOIN v_latest l ON p.id = l.patch_id",
    "v_fix": """
SELECT f.*, p.patch_id, CASE WHEN f.status = 'FIXED' THEN 'none' WHEN coalesce(f.cwe_id = 'CWE-798', false) THEN 'rotate'
 WHEN p.patch_status IS NULL THEN 'none' WHEN p.patch_status IN ('QUEUED','RUNNING') THEN 'generating'
 WHEN p.patch_status = 'FAILED' THEN 'refused' WHEN p.check_status IS NULL THEN 'unchecked'
 WHEN p.check_status IN ('QUEUED','RUNNING') THEN 'checking' WHEN p.check_status = 'PASSED' THEN 'passed'
 WHEN p.check_status = 'REJECTED' THEN 'rejected' ELSE 'not_judged' END AS fix_state
FROM v_scored f LEFT JOIN (SELECT finding_id, id AS patch_id, status AS patch_status, check_status FROM (
 SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS rn FROM v_checked) WHERE rn = 1) p
 ON f.id = p.finding_id""",
    "v_files": f"""
SELECT CAST(substr(source, 4) AS BIGINT) AS repository_id, doc_id,
 (CASE doc_id % 10 WHEN 3 THEN 'node_modules' WHEN 5 THEN 'src/build' ELSE 'src' END) || '/d' || doc_id ||
 (CASE WHEN doc_id % 10 = 7 THEN '.png' ELSE {case('lang', adapters.LANG_SUFFIX)} END) AS path, n_chars AS length, text FROM documents""",
    "snippets": values(_SNIPPET_ROWS, "t, ext, body"),
    "expected": values(expected_rows(), "t, rule_id, off"),
    "v_code": f"""
SELECT CAST(substr(source, 4) AS BIGINT) AS repository_id, 'src/d' || doc_id || ext AS path, ext, t, doc_id,
 len(text) - len(replace(text, chr(10), '')) + 3 AS first_line,
 (CASE WHEN ext = '.py' THEN '# ' || replace(text, chr(10), chr(10) || '# ') ELSE text END) || chr(10) || chr(10) ||
 replace(replace(replace(replace(replace(body, '{{w}}', 'v' || regexp_extract(text, '[A-Za-z]+')), '{{d}}', CAST(doc_id AS VARCHAR)),
 '{{h64}}', {_HASH}), '{{h40}}', substr({_HASH}, 1, 40)), '{{H16}}', upper(substr({_HASH}, 1, 16))) AS text
FROM documents d JOIN snippets s ON d.doc_id % {len(SNIPPETS)} = s.t""",
    "v_code_lines": """
SELECT repository_id, path, ext, t, first_line, CAST(i AS INTEGER) AS line_no, lines[i] AS line
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM v_code), unnest(range(1, len(lines) + 1)) AS u(i)""",
    "v_matches": """
SELECT repository_id, path, CAST(first_line + off AS INTEGER) AS line_start, rule_id FROM v_code JOIN expected USING (t)
UNION SELECT repository_id, path, line_no, 'SEC005' FROM v_code_lines
WHERE ext <> '.py' AND regexp_matches(line, '^[^"]*token = "[0-9a-f]{40}"')""",
    "v_cases": f"""
SELECT 'Case' || l.doc_id AS name, l.doc_id, {case('lang', adapters.LANG_CATEGORY)} AS category, quality = 0 AS vulnerable,
 {case('lang', {"en": 78, "fr": 327, "de": 327, "es": 1})} AS cwe, n_chars BETWEEN 600 AND 2500 AS reported, n_chars > 1300 AS reported_before
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_case_findings": """
SELECT name, CASE category WHEN 'cmdi' THEN 'PY003' WHEN 'hash' THEN 'JV003' WHEN 'crypto' THEN 'JV004' ELSE 'PY006' END AS rule_id
 FROM v_cases WHERE reported
UNION ALL SELECT name, 'PY002' FROM v_cases WHERE reported AND doc_id % 2 = 0 AND category = 'cmdi'
UNION ALL SELECT name, 'PY009' FROM v_cases WHERE doc_id % 3 = 0
UNION ALL SELECT 'Outside' || doc_id, 'PY001' FROM documents WHERE doc_id % 5 = 0""",
    "v_verdicts": """
SELECT c.name, c.doc_id, c.category, c.cwe, c.vulnerable, c.reported_before, coalesce(a.rules, '') AS rules, a.name IS NOT NULL AS reported,
 CASE WHEN vulnerable AND a.name IS NOT NULL THEN 'TP' WHEN vulnerable THEN 'FN' WHEN a.name IS NOT NULL THEN 'FP' ELSE 'TN' END AS verdict
FROM v_cases c LEFT JOIN (SELECT f.name, string_agg(DISTINCT f.rule_id, ' ' ORDER BY f.rule_id) AS rules
 FROM v_case_findings f JOIN rules r USING (rule_id) JOIN v_cases c ON c.name = f.name AND c.category = r.category GROUP BY f.name) a ON a.name = c.name""",
    "v_confusion": """
SELECT category, min(cwe) AS cwe, count(*) FILTER (WHERE verdict = 'TP') AS tp, count(*) FILTER (WHERE verdict = 'FP') AS fp,
 count(*) FILTER (WHERE verdict = 'TN') AS tn, count(*) FILTER (WHERE verdict = 'FN') AS fn, category <> 'zzz' AS has_rule
FROM v_verdicts GROUP BY category""",
    "v_rates": """
SELECT *, recall - false_positive_rate AS score FROM (SELECT *, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
 fp::DOUBLE / nullif(fp + tn, 0) AS false_positive_rate, tp::DOUBLE / nullif(tp + fp, 0) AS precision,
 (tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS accuracy, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM v_confusion)""",
    "v_unit": """
SELECT vec_id, label, list_transform(e, lambda x: x / nn) AS u FROM (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS nn
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""",
    "v_chunks": """
SELECT vec_id AS chunk_id, 'CWE-' || label AS cwe_id, CASE WHEN vec_id % 11 = 0 THEN 'PY00' || (label % 3 + 1) END AS rule_id,
 'A0' || (label % 5 + 1) || ':2021' AS owasp_category, ['Fix','Risk','Mitigations','Description'][vec_id % 4 + 1] AS section, u
FROM v_unit WHERE vec_id % 10 <> 0""",
    "v_queries": """
SELECT vec_id AS query_id, CASE WHEN vec_id % 30 <> 0 THEN 'CWE-' || label END AS cwe_id,
 CASE WHEN vec_id % 30 <> 0 THEN 'PY00' || (vec_id // 10 % 3 + 1) END AS rule_id,
 CASE WHEN vec_id % 30 <> 0 AND vec_id % 20 = 0 THEN 'A0' || (label % 5 + 1) || ':2021' END AS owasp, u AS q
FROM v_unit WHERE vec_id % 10 = 0""",
    "v_pairs": """
SELECT query_id, chunk_id, section, CASE WHEN coalesce(c.rule_id = q.rule_id, false) THEN 0 WHEN coalesce(c.cwe_id = q.cwe_id, false) THEN 1
 WHEN coalesce(c.owasp_category = q.owasp, false) THEN 2 ELSE 3 END AS tier, round(list_dot_product(q, u), 6) AS score
FROM v_queries q JOIN v_chunks c ON c.rule_id IS NULL OR coalesce(c.rule_id = q.rule_id, false)""",
    "v_ranked": """
SELECT *, min(CASE WHEN section IN ('Fix','Mitigations') THEN rank END) OVER (PARTITION BY query_id) AS first_remedy
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, chunk_id) AS rank FROM v_pairs WHERE tier < 3)""",
    "v_selected": """
SELECT query_id, chunk_id, section, tier, score, least(rank, 5) AS rank FROM v_ranked
WHERE CASE WHEN coalesce(first_remedy > 5, false) THEN rank < 5 OR rank = first_remedy ELSE rank <= 5 END""",
    "v_topup": """
SELECT query_id, chunk_id, section, tier, score, have + place AS rank FROM (
SELECT p.*, coalesce(h.have, 0) AS have, row_number() OVER (PARTITION BY p.query_id ORDER BY score DESC, chunk_id) AS place
FROM v_pairs p LEFT JOIN (SELECT query_id, count(*) AS have FROM v_selected GROUP BY 1) h ON h.query_id = p.query_id
WHERE tier = 3 AND score >= 0.35) WHERE have + place <= 5""",
    "v_examples": f"""
SELECT l.doc_id AS patch_id, substr(sha256(text), 1, 6) AS finding_id, quality = 1 AS passed, source AS rule_id, n_chars AS diff_characters,
 {array(dims.SEVERITIES)}[l.doc_id % 5 + 1] AS severity, {array(dims.CONFIDENCES)}[l.doc_id % 3 + 1] AS confidence,
 {case('lang', adapters.LANG_SUFFIX)} AS suffix, l.doc_id AS n, text,
 len(string_split(text, ' ')) AS rationale_characters, len(string_split(text, chr(10))) AS lines_added, l.doc_id % 7 AS lines_removed, l.doc_id % 12 AS region_lines, l.doc_id % 4 = 0 AS fences_stripped,
 l.doc_id % 3 AS gutters_stripped, l.doc_id % 6 = 0 AS reindented, l.doc_id % 3 + 1 AS attempts, l.doc_id % 2 = 0 AS had_explanation, l.doc_id % 5 AS passages,
 CASE WHEN l.doc_id % 9 <> 0 THEN l.doc_id % 700 END AS prompt_tokens, l.doc_id % 90 AS completion_tokens, l.doc_id % 5000 AS duration_ms, (l.doc_id % 3) * 0.25::DOUBLE AS temperature FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_predictions": """
SELECT patch_id, passed, n % 5 AS fold, 0 AS repeat, 'model' AS predictor, (diff_characters % 101) / 100.0::DOUBLE AS probability FROM v_examples
UNION ALL SELECT patch_id, passed, n % 5, 0, 'pass rate of the rule', (diff_characters % 7) / 10.0::DOUBLE FROM v_examples""",
    "v_edges": f"""
SELECT event_id AS src, event_id // 3 AS dst, CASE event_type WHEN 'click' THEN ['html'] WHEN 'signup' THEN ['path','redirect'] ELSE [] END AS safe_for,
 {array(adapters.FLOW_CALLS)}[k % 12 + 1] AS qualified, k AS line, k % 9 = 0 AS replaces_quote FROM ev WHERE event_id > 0""",
    "v_nodes": """
SELECT event_id AS id, CASE k % 10 WHEN 0 THEN 'input' WHEN 1 THEN 'random' WHEN 2 THEN 'opaque' END AS origin, event_id + 1 AS line
FROM ev WHERE k % 10 < 3""",
    "v_sinks": f"SELECT event_id AS id, {array(dims.KINDS)}[event_id % 10 + 1] AS kind FROM events",
    "v_reach": f"""
WITH RECURSIVE reach(id, kind, origin, source) AS (
 SELECT n.id, u.kind, n.origin, n.line FROM v_nodes n, unnest({array(dims.KINDS)}) AS u(kind)
 UNION SELECT e.dst, r.kind, r.origin, r.source FROM reach r JOIN v_edges e ON e.src = r.id WHERE NOT list_contains(e.safe_for, r.kind))
SELECT * FROM reach""",
}


def sql(body: str) -> str:
    """``body`` with the CTEs of every view it names, directly or through other views."""
    if body.strip().upper().startswith("WITH "):
        body = f"SELECT * FROM ({body.strip()})"
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    visit(body)
    if not wanted:
        return body.strip()
    order = [name for name in VIEWS if name in wanted]
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in order)
    return f"WITH {ctes}\n{body.strip()}"

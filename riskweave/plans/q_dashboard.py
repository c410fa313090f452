"""Filters, joins, aggregates, orders and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.paths import path_context
from riskweave.operators import aggregates, filters, identity, joins, ranking, report, risk
from riskweave.plans.adapters import CHECK_ORDER, Tables, lines_of, now
from riskweave.plans.registry import query
from riskweave.plans.views import NOW, path_kind, severity_rank, squash

EXCLUDES = ("tests", "*.min.js", "docs/")


def shown(column: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.4f', {column}), '0+$', ''), '[.]$', '')"


def scored(t: Tables):
    return risk.score_findings(t.findings, now())


def risks(t: Tables):
    return risk.repository_risk(scored(t))


# --- filters ---------------------------------------------------------------------------------


@query("owner_scope", """SELECT r_regionkey AS owner_id, r_name, count(*) AS findings FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def owner_scope(t: Tables):
    findings = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"))
    repositories = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"))
    projects = t.read("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("owner_id"))
    owners = t.read("region").select(F.col("r_regionkey").alias("owner_id"), "r_name")
    scoped = filters.owner_scope(findings, repositories, projects)
    # Counted per owner before the names are attached.
    return scoped.groupBy("owner_id").agg(F.count("*").alias("findings")).join(owners, "owner_id")


@query("filter_findings", "SELECT id, repository_id FROM v_findings WHERE severity = 'CRITICAL' AND status = 'OPEN'")
def filter_findings(t: Tables):
    return filters.filter_findings(t.findings, "CRITICAL", "OPEN").select("id", "repository_id")


@query("search_projects", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), 'mer#00000001')")
def search_projects(t: Tables):
    projects = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return filters.search_projects(projects, "MER#00000001")


@query("project_name_taken", """SELECT event_id, owner_id, name, EXISTS (SELECT 1 FROM v_projects p WHERE p.owner_id = w.owner_id AND lower(p.name) = lower(w.name)) AS taken
 FROM (SELECT event_id, user_id % 10 AS owner_id, 'PROJECT ' || (user_id + k % 2 * 10) AS name FROM ev) w""")
def project_name_taken(t: Tables):
    wanted = t.events.select(
        "event_id", (F.col("user_id") % 10).alias("owner_id"),
        F.concat(F.lit("PROJECT "), (F.col("user_id") + F.col("k") % 2 * 10).cast("string")).alias("name"),
    )
    return filters.project_name_taken(t.projects, wanted)


@query("exclude_paths", """SELECT repository_id, count(*) FILTER (WHERE e) AS excluded, count(*) FILTER (WHERE NOT e) AS kept FROM (
 SELECT repository_id, (file_path LIKE 'tests/%' OR file_path LIKE '%.min.js' OR file_path LIKE 'docs/%') AS e FROM v_findings) GROUP BY 1""")
def exclude_paths(t: Tables):
    return filters.excluded_counts(t.findings, EXCLUDES)


@query("patchable_findings", f"""SELECT finding_id, in_place FROM (
 SELECT f.doc_id AS finding_id, coalesce(bool_or(contains(l.line, trim(f.snippet))), false) AS in_place
 FROM (SELECT doc_id, doc_id % 10 AS line_start, CASE WHEN doc_id % 4 = 0 THEN 'gone' ELSE ' e' END AS snippet, CASE WHEN doc_id % 7 = 0 THEN 'FIXED' ELSE 'OPEN' END AS status,
 CASE WHEN doc_id % 3 = 0 THEN 'CWE-798' ELSE 'CWE-78' END AS cwe_id FROM documents) f
 LEFT JOIN (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) l
 ON l.doc_id = f.doc_id AND l.line_no BETWEEN f.line_start AND f.line_start + 1 WHERE f.status <> 'FIXED' AND f.cwe_id <> 'CWE-798' GROUP BY 1)""")
def patchable_findings(t: Tables):
    n = F.col("doc_id")
    findings = t.documents.select(
        n.alias("finding_id"), F.lit(0).alias("repository_id"), n.cast("string").alias("path"),
        (n % 10).cast("int").alias("line_start"), (n % 10 + 1).cast("int").alias("line_end"),
        F.when(n % 4 == 0, "gone").otherwise(" e").alias("snippet"),
        F.when(n % 7 == 0, "FIXED").otherwise("OPEN").alias("status"),
        F.when(n % 3 == 0, "CWE-798").otherwise("CWE-78").alias("cwe_id"),
    )
    lines = lines_of(t.documents).select(
        F.lit(0).alias("repository_id"), F.col("doc_id").cast("string").alias("path"), "line_no", "line"
    )
    return joins.patchable_in_place(findings, lines).select("finding_id", "in_place")


@query("scannable_repositories", """SELECT id FROM v_repositories r WHERE status = 'READY' AND workspace_path IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM v_scans s WHERE s.status IN ('QUEUED','RUNNING') AND s.repository_id = r.id)""")
def scannable_repositories(t: Tables):
    return filters.scannable_repositories(t.repositories, t.scans).select("id")


@query("outstanding_sessions", f"""SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 4 <> 0 AND ts + INTERVAL 30 DAY > {NOW}""")
def outstanding_sessions(t: Tables):
    sessions = t.events.filter("event_type = 'purchase'").select(
        "event_id", F.when(F.col("user_id") % 4 == 0, F.col("ts")).alias("revoked_at"),
        F.expr("ts + INTERVAL 30 DAYS").alias("expires_at"),
    )
    return filters.outstanding_sessions(sessions, now()).select("event_id")


# --- joins -----------------------------------------------------------------------------------


@query("owner_chain_join", """SELECT p.owner_id, p.id AS project_id, count(*) AS findings FROM v_findings f JOIN v_repositories r ON f.repository_id = r.id
 JOIN v_projects p ON r.project_id = p.id GROUP BY ALL""")
def owner_chain_join(t: Tables):
    rows = filters.owner_scope(t.findings.select("id", "repository_id"), t.repositories, t.projects)
    return rows.groupBy("owner_id", "project_id").agg(F.count("*").alias("findings"))


@query("patch_with_latest_check", "SELECT id, finding_id, status, check_status FROM v_checked")
def patch_with_latest_check(t: Tables):
    return joins.patch_with_latest_check(t.patches, t.validations, CHECK_ORDER).select("id", "finding_id", "status", "check_status")


@query("finding_fix_state_join", "SELECT id, patch_id, fix_state FROM v_fix")
def finding_fix_state_join(t: Tables):
    return joins.finding_fix_state(t.findings, t.patches, t.validations, CHECK_ORDER).select("id", "patch_id", "fix_state")


@query("rule_dimension_join", """SELECT m.repository_id, m.path, m.line_start, m.rule_id, r.severity, r.cwe_id, r.category FROM v_matches m JOIN rules r USING (rule_id) WHERE rule_id NOT LIKE 'PY%'""")
def rule_dimension_join(t: Tables):
    from riskweave.operators.detect import detect

    return joins.rule_dimension_join(detect(t.code), t.rules).select(
        "repository_id", "path", "line_start", "rule_id", "severity", "cwe_id", "category"
    )


def baseline(t: Tables):
    return t.findings.filter("id % 3 <> 0").select("fingerprint")


@query("baseline_anti_join", "SELECT id FROM v_findings WHERE fingerprint NOT IN (SELECT fingerprint FROM v_findings WHERE id % 3 <> 0)")
def baseline_anti_join(t: Tables):
    return joins.baseline_anti_join(t.findings, baseline(t)).select("id")


@query("baseline_state", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'unchanged' ELSE 'new' END AS baseline_state FROM v_findings")
def baseline_state(t: Tables):
    return joins.baseline_state(t.findings, baseline(t)).select("id", "baseline_state")


@query("lines_for_finding", """SELECT f.doc_id AS finding_id, l.line_no, l.line, CASE WHEN l.line_no < s THEN 'before' WHEN l.line_no > s + 1 THEN 'after' ELSE 'replaceable' END AS part
 FROM (SELECT doc_id, doc_id % 20 + 1 AS s FROM documents) f JOIN (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) l
 ON l.doc_id = f.doc_id AND l.line_no BETWEEN s - 6 AND s + 7""")
def lines_for_finding(t: Tables):
    n = F.col("doc_id")
    findings = t.documents.select(
        n.alias("finding_id"), F.lit(0).alias("repository_id"), n.cast("string").alias("path"),
        (n % 20 + 1).cast("int").alias("line_start"), (n % 20 + 2).cast("int").alias("line_end"),
    )
    lines = lines_of(t.documents).select(
        F.lit(0).alias("repository_id"), F.col("doc_id").cast("string").alias("path"), "line_no", "line"
    )
    return joins.lines_for_finding(findings, lines).select("finding_id", "line_no", "line", "part")


@query("citation_resolve", """SELECT o_orderkey AS explanation_id, CAST(n AS INTEGER) AS number, p_partkey AS chunk_id, p_name FROM orders, unnest([1, 3, 9]) AS c(n)
 JOIN part ON p_partkey = o_orderkey % 2500 + c.n WHERE n <= o_orderkey % 5 + 1""")
def citation_resolve(t: Tables):
    key = F.col("o_orderkey")
    explanations = t.read("orders").select(
        key.alias("explanation_id"), F.array(F.lit(1), F.lit(3), F.lit(9)).alias("citations"),
        F.transform(F.sequence(F.lit(1), (key % 5 + 1).cast("int")), lambda i: key % 2500 + i).alias("passage_chunk_ids"),
    )
    chunks = t.read("part").select(F.col("p_partkey").alias("chunk_id"), "p_name")
    return joins.citation_resolve(explanations, chunks).select("explanation_id", "number", "chunk_id", "p_name")


@query("case_file_join", """SELECT 'd' || c.doc_id AS name, f.path FROM labels c JOIN v_code f ON f.doc_id = c.doc_id WHERE ext IN ('.py','.js','.mjs','.ts','.jsx','.vue','.java','.kt','.scala','.php','.go','.cs')""")
def case_file_join(t: Tables):
    cases = t.read("labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return joins.case_files(cases, t.code).select("name", "path")


@query("unpatched_findings", """SELECT f.id FROM v_findings f LEFT JOIN (SELECT finding_id, bool_or(status IN ('QUEUED','RUNNING')) AS a,
 bool_or(status = 'PROPOSED' AND check_status IS NULL) AS u, bool_or(check_status IS NOT NULL) AS j FROM v_checked GROUP BY 1) p ON p.finding_id = f.id
 WHERE f.status <> 'FIXED' AND NOT coalesce(f.cwe_id = 'CWE-798', false) AND NOT coalesce(a, false) AND NOT coalesce(u, false) AND NOT coalesce(j, false)""")
def unpatched_findings(t: Tables):
    return joins.unpatched_findings(t.findings, t.patches, t.validations, order=CHECK_ORDER).select("id")


# --- aggregates ------------------------------------------------------------------------------


@query("counts_by_severity", f"""SELECT r.repository_id, s.severity, count(f.id) AS n FROM (SELECT DISTINCT repository_id FROM v_findings) r
 CROSS JOIN (SELECT unnest({list(dims.SEVERITIES)}) AS severity) s LEFT JOIN v_findings f ON f.repository_id = r.repository_id AND f.severity = s.severity AND f.status <> 'FIXED' GROUP BY ALL""")
def counts_by_severity(t: Tables):
    return aggregates.counts_by_severity(t.findings, ["repository_id"])


@query("counts_by_status", "SELECT repository_id, status, count(*) AS n FROM v_findings GROUP BY ALL")
def counts_by_status(t: Tables):
    return aggregates.counts_by_status(t.findings, ["repository_id"])


@query("dashboard_totals", """SELECT p.owner_id, p.n AS projects, coalesce(r.n, 0) AS repositories, coalesce(s.reps, 0) AS repositories_scanned,
 coalesce(s.scans, 0) AS scans_completed, coalesce(f.o, 0) AS open_findings, coalesce(f.x, 0) AS fixed_findings
 FROM (SELECT owner_id, count(*) AS n FROM v_projects GROUP BY 1) p
 LEFT JOIN (SELECT p.owner_id, count(*) AS n FROM v_repositories r JOIN v_projects p ON r.project_id = p.id GROUP BY 1) r USING (owner_id)
 LEFT JOIN (SELECT owner_id, count(DISTINCT repository_id) AS reps, count(*) AS scans FROM v_scans WHERE status = 'COMPLETED' AND finished_at IS NOT NULL GROUP BY 1) s USING (owner_id)
 LEFT JOIN (SELECT owner_id, count(*) FILTER (WHERE status <> 'FIXED') AS o, count(*) FILTER (WHERE status = 'FIXED') AS x FROM v_findings GROUP BY 1) f USING (owner_id)""")
def dashboard_totals(t: Tables):
    owned = t.repositories.select(F.col("id").alias("repository_id")).transform(
        lambda rows: filters.owner_scope(rows, t.repositories, t.projects)
    )
    return aggregates.dashboard_totals(t.projects, owned, t.scans, t.findings)


@query("weakness_groups", f"""SELECT owner_id, cwe_id, title, owasp_category, count, worst_severity, position FROM (
 SELECT w.*, row_number() OVER (PARTITION BY owner_id ORDER BY count DESC, coalesce(cwe_id, '')) AS position FROM (
 SELECT g.owner_id, g.cwe_id, sum(n)::BIGINT AS count, min_by(title, (-n, title)) AS title,
 {list(dims.SEVERITIES)}[min(worst) + 1] AS worst_severity,
 (SELECT owasp_category FROM v_findings x WHERE x.status <> 'FIXED' AND x.owner_id = g.owner_id AND x.cwe_id IS NOT DISTINCT FROM g.cwe_id GROUP BY owasp_category ORDER BY count(*) DESC, owasp_category LIMIT 1) AS owasp_category
 FROM (SELECT owner_id, cwe_id, title, count(*) AS n, min({severity_rank('severity')}) AS worst FROM v_findings WHERE status <> 'FIXED' GROUP BY ALL) g GROUP BY g.owner_id, g.cwe_id) w) WHERE position <= 6""")
def weakness_groups(t: Tables):
    return aggregates.weakness_groups(t.findings, ["owner_id"])


FIX_SQL = """count(*) AS requested, count(*) FILTER (WHERE status IN ('QUEUED','RUNNING')) AS generating, count(*) FILTER (WHERE status = 'FAILED') AS refused,
 count(*) FILTER (WHERE status = 'PROPOSED') AS proposed, count(*) FILTER (WHERE status = 'PROPOSED' AND check_status IS NULL) AS unchecked,
 count(*) FILTER (WHERE status = 'PROPOSED' AND check_status IN ('QUEUED','RUNNING')) AS checking, count(*) FILTER (WHERE status = 'PROPOSED' AND check_status = 'PASSED') AS passed,
 count(*) FILTER (WHERE status = 'PROPOSED' AND check_status = 'REJECTED') AS rejected, count(*) FILTER (WHERE status = 'PROPOSED' AND check_status = 'FAILED') AS not_judged"""


def owned_patches(t: Tables):
    checked = joins.patch_with_latest_check(t.patches, t.validations, CHECK_ORDER)
    return checked.join(t.findings.select(F.col("id").alias("finding_id"), "owner_id", "rule_id"), "finding_id")


@query("fix_outcomes", f"SELECT owner_id, {FIX_SQL} FROM (SELECT c.*, f.owner_id FROM v_checked c JOIN v_findings f ON f.id = c.finding_id) GROUP BY 1")
def fix_outcomes(t: Tables):
    return aggregates.fix_outcomes(owned_patches(t), ["owner_id"])


@query("pass_rate", """SELECT owner_id, CAST(floor(p / nullif(p + r, 0) * 100 + 0.5) AS BIGINT) AS pass_rate FROM (SELECT f.owner_id,
 (count(*) FILTER (WHERE c.status = 'PROPOSED' AND check_status = 'PASSED'))::DOUBLE AS p, (count(*) FILTER (WHERE c.status = 'PROPOSED' AND check_status = 'REJECTED'))::DOUBLE AS r
 FROM v_checked c JOIN v_findings f ON f.id = c.finding_id GROUP BY 1)""")
def pass_rate(t: Tables):
    rows = aggregates.fix_outcomes(owned_patches(t), ["owner_id"])
    return rows.select("owner_id", aggregates.pass_rate(F.col("passed"), F.col("rejected")).alias("pass_rate"))


@query("bar_shares", """SELECT owner_id, event_type, n, CASE WHEN n <= 0 OR m <= 0 THEN 0.0 ELSE greatest(2.0::DOUBLE, least(100.0::DOUBLE, n::DOUBLE / m * 100)) END AS percent,
 CASE WHEN n::DOUBLE / s * 100 > 0 AND n::DOUBLE / s * 100 < 1 THEN 'under 1%' ELSE CAST(floor(n::DOUBLE / s * 100 + 0.5) AS BIGINT) || '%' END AS share
 FROM (SELECT *, max(n) OVER (PARTITION BY owner_id) AS m, sum(n) OVER (PARTITION BY owner_id) AS s FROM (SELECT user_id % 10 AS owner_id, event_type, count(*) AS n FROM events GROUP BY ALL))""")
def bar_shares(t: Tables):
    counts = t.events.groupBy((F.col("user_id") % 10).alias("owner_id"), "event_type").agg(F.count("*").alias("n"))
    return aggregates.bar_shares(counts, ["owner_id"])


@query("report_rules", f"""SELECT repository_id, rule_id, count(*) AS count, min({severity_rank('severity')}) AS severity_rank, max(title) AS title FROM v_findings WHERE status <> 'FIXED' GROUP BY 1, 2""")
def report_rules(t: Tables):
    return aggregates.report_rules(scored(t)).select("repository_id", "rule_id", "count", "severity_rank", "title")


@query("report_header", f"""SELECT repository_id, count(*) FILTER (WHERE status <> 'FIXED') AS open_count, count(*) FILTER (WHERE status = 'NEW') AS new_count,
 count(*) FILTER (WHERE status = 'FIXED') AS fixed_count, {', '.join(f"count(*) FILTER (WHERE status <> 'FIXED' AND severity = '{s}') AS {s.lower()}" for s in dims.SEVERITIES)} FROM v_findings GROUP BY 1""")
def report_header(t: Tables):
    return aggregates.report_header(t.findings)


@query("example_census", f"SELECT rule_id, requested, generating, refused, unchecked, checking, not_judged, passed, rejected FROM (SELECT rule_id, {FIX_SQL} FROM (SELECT c.*, f.rule_id FROM v_checked c JOIN v_findings f ON f.id = c.finding_id) GROUP BY 1)")
def example_census(t: Tables):
    return aggregates.example_census(owned_patches(t))


# --- orders and pages ------------------------------------------------------------------------


@query("severity_order", f"SELECT id, {severity_rank('severity')} AS severity_rank, file_path, line_start FROM v_findings ORDER BY ALL")
def severity_order(t: Tables):
    return ranking.severity_order(t.findings).select("id", "severity_rank", "file_path", "line_start")


@query("list_findings_page", f"""SELECT repository_id, id, position, total FROM (SELECT repository_id, id, count(*) OVER (PARTITION BY repository_id) AS total,
 row_number() OVER (PARTITION BY repository_id ORDER BY {severity_rank('severity')}, file_path, line_start, id) AS position FROM v_findings) WHERE position > 3 AND position <= 8""")
def list_findings_page(t: Tables):
    return ranking.list_findings_page(t.findings, limit=5, offset=3).select("repository_id", "id", "position", "total")


@query("scan_history_page", """SELECT repository_id, id, position FROM (SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY created_at DESC, id DESC) AS position FROM v_scans) WHERE position > 5 AND position <= 15""")
def scan_history_page(t: Tables):
    return ranking.scan_history_page(t.scans, limit=10, offset=5).select("repository_id", "id", "position")


@query("recent_audit", "SELECT event_id AS id, user_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_audit(t: Tables):
    return ranking.recent_audit(t.audit, 50).select("id", "user_id", "created_at")


@query("latest_completed_scan", """SELECT repository_id, id, finished_at, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY finished_at DESC, id DESC) AS rn
 FROM v_scans WHERE status = 'COMPLETED' AND finished_at IS NOT NULL) WHERE rn = 1""")
def latest_completed_scan(t: Tables):
    return joins.latest_completed_scan(t.scans)


@query("latest_per_parent", """SELECT finding_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS rn FROM v_patches) WHERE rn = 1""")
def latest_per_parent(t: Tables):
    return joins.latest_per_parent(t.patches, "finding_id", ["created_at", "id"], ["id", "status"])


@query("risk_trend", """SELECT repository_id, id, risk_score, row_number() OVER (PARTITION BY repository_id ORDER BY finished_at, id) AS point FROM (
 SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY finished_at DESC, id DESC) AS back FROM v_scans WHERE status = 'COMPLETED' AND finished_at IS NOT NULL AND risk_score IS NOT NULL) WHERE back <= 12""")
def risk_trend(t: Tables):
    return ranking.risk_trend(t.scans).select("repository_id", "id", "risk_score", "point")


@query("top_findings", """SELECT owner_id, id, score, position FROM (SELECT owner_id, id, score, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, id) AS position FROM v_scored WHERE status <> 'FIXED') WHERE position <= 8""")
def top_findings(t: Tables):
    return risk.top_findings(scored(t), "owner_id", 8).select("owner_id", "id", "score", "position")


@query("repository_ranking", """SELECT p.owner_id, r.repository_id, CASE WHEN s.repository_id IS NOT NULL THEN r.score END AS score, CASE WHEN s.repository_id IS NOT NULL THEN r.grade END AS grade, r.open
 FROM v_risk r JOIN v_repositories h ON h.id = r.repository_id JOIN v_projects p ON p.id = h.project_id
 LEFT JOIN (SELECT DISTINCT id AS repository_id FROM v_repositories WHERE id % 3 <> 0) s ON s.repository_id = r.repository_id""")
def repository_ranking(t: Tables):
    # A third of the repositories have never completed a scan.
    done = t.repositories.filter("id % 3 <> 0").select(
        F.col("id").alias("repository_id"), F.lit("COMPLETED").alias("status"), now().alias("finished_at")
    )
    summary = risk.repository_summary(risks(t), done, t.repositories)
    owned = filters.owner_scope(summary, t.repositories, t.projects)
    return ranking.repository_ranking(owned).select("owner_id", "repository_id", "score", "grade", F.col("open_findings").alias("open"))


@query("report_order", "SELECT id, score, severity_rank FROM v_scored WHERE status <> 'FIXED'")
def report_order(t: Tables):
    return ranking.report_order(aggregates.open_only(scored(t))).select("id", "score", "severity_rank")


@query("rank_decay_sum", """SELECT owner_id, severity, round(coalesce(sum(CASE WHEN score > 0 THEN score * pow(0.6::DOUBLE, rn - 1) END), 0), 4) AS decayed FROM (
 SELECT *, row_number() OVER (PARTITION BY owner_id, severity ORDER BY score DESC, id) AS rn FROM v_scored) GROUP BY 1, 2""")
def rank_decay_sum(t: Tables):
    return risk.rank_decay_sum(scored(t), ["owner_id", "severity"]).select("owner_id", "severity", F.round("decayed", 4).alias("decayed"))


# --- risk ------------------------------------------------------------------------------------


@query("score_findings", "SELECT id, repository_id, base_f AS base, confidence_f, path_f, age_f, regression_f, score FROM v_scored")
def score_findings(t: Tables):
    return scored(t).select("id", "repository_id", "base", "confidence_f", "path_f", "age_f", "regression_f", "score")


@query(
    "score_explanation",
    f"""SELECT id, CASE WHEN status = 'FIXED' THEN '0 base × 0 fixed = 0' ELSE concat_ws(' ', {shown('base_f')} || ' base', '× ' || {shown('confidence_f')} || ' confidence',
 '× ' || {shown('path_f')} || ' ' || CASE WHEN kind = 'secret' THEN 'secret in any location' ELSE kind || ' path' END, '× ' || {shown('age_f')} || ' age',
 CASE WHEN regression_f <> 1 THEN '× ' || {shown('regression_f')} || ' regression' END) || ' = ' || {shown('score')} END AS explanation
 FROM (SELECT *, {path_kind('rule_id', 'file_path')} AS kind FROM v_scored)""",
)
def score_explanation(t: Tables):
    kind = path_context(F.col("rule_id"), F.col("file_path"))
    return scored(t).select("id", risk.score_explanation(kind).alias("explanation"))


@query("repository_risk", "SELECT repository_id, score, grade, policy_version, finding_count, critical, high, medium, low, info, open, fixed FROM v_risk")
def repository_risk(t: Tables):
    return risks(t).select(
        "repository_id", "score", "grade", "policy_version", "finding_count", *[s.lower() for s in dims.SEVERITIES], "open", "fixed"
    )


@query("repository_summary", """SELECT h.id AS repository_id, CASE WHEN s.n IS NOT NULL THEN r.score END AS score, CASE WHEN s.n IS NOT NULL THEN r.grade END AS grade, r.open AS open_findings,
 r.fixed AS fixed_findings, coalesce(s.n, 0) AS scans FROM v_repositories h JOIN v_risk r ON r.repository_id = h.id
 LEFT JOIN (SELECT repository_id, count(*) AS n FROM v_scans WHERE status = 'COMPLETED' AND finished_at IS NOT NULL GROUP BY 1) s ON s.repository_id = h.id""")
def repository_summary(t: Tables):
    return risk.repository_summary(risks(t), t.scans, t.repositories).drop("last_scan_at")


@query("freeze_scan_risk", """SELECT s.id, s.repository_id, r.score AS risk_score, r.grade AS risk_grade, r.policy_version AS risk_policy_version FROM v_scans s LEFT JOIN v_risk r USING (repository_id)""")
def freeze_scan_risk(t: Tables):
    return risk.freeze_scan_risk(t.scans, risks(t)).select("id", "repository_id", "risk_score", "risk_grade", "risk_policy_version")


@query("quality_gate", """SELECT repository_id, score, blocking, blocking = 0 AND score <= 60 AS passed, concat_ws(' ', CASE WHEN blocking > 0 THEN blocking || ' new finding' || CASE WHEN blocking = 1 THEN '' ELSE 's' END || ' of severity HIGH or worse.' END,
 CASE WHEN score > 60 THEN 'Score ' || regexp_replace(regexp_replace(printf('%.4f', score), '0+$', ''), '[.]$', '') || ' exceeds the limit of 60.' END) AS reasons
 FROM (SELECT r.repository_id, r.score, coalesce(b.n, 0) AS blocking FROM v_risk r LEFT JOIN (SELECT repository_id, count(*) AS n FROM v_findings WHERE status <> 'FIXED' AND id % 3 = 0 AND severity IN ('CRITICAL','HIGH') GROUP BY 1) b USING (repository_id))""")
def quality_gate(t: Tables):
    rows = risk.quality_gate(t.findings, risks(t), "high", 60.0, baseline(t))
    return rows.withColumn("reasons", F.array_join("reasons", " "))


@query("build_report", """SELECT id, repository_id, score, fix_state, CASE WHEN status = 'FIXED' THEN 'fixed' ELSE 'open' END AS part, coalesce(cwe_id = 'CWE-798', false) AS is_credential, severity_rank FROM v_fix""")
def build_report(t: Tables):
    rows = report.build_report(t.findings, t.patches, t.validations, CHECK_ORDER, now())
    return rows.select("id", "repository_id", "score", "fix_state", "part", "is_credential", "severity_rank")


# --- identity --------------------------------------------------------------------------------


@query("collapse_overlapping", f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY repository_id, file_path, line_start, cwe_id
 ORDER BY {severity_rank('severity')}, list_position(['HIGH','MEDIUM','LOW'], confidence), id) AS rn FROM v_findings WHERE cwe_id IS NOT NULL) WHERE rn = 1
 UNION ALL SELECT id FROM v_findings WHERE cwe_id IS NULL""")
def collapse_overlapping(t: Tables):
    return identity.collapse_overlapping(t.file_findings).select("id")


def repeat_bucket():
    """Rises with (line, sequence number); a repeated line is numbered 65,536 rows at a time."""
    return F.struct(F.col("line_start").alias("l"), F.floor(F.col("seq") / 65536).alias("s"))


@query("number_repeats", f"""SELECT id, row_number() OVER (PARTITION BY repository_id, file_path, rule_id, {squash('snippet')} ORDER BY line_start, id) - 1 AS occurrence FROM v_findings""")
def number_repeats(t: Tables):
    return identity.number_repeats(t.file_findings, repeat_bucket()).select("id", "occurrence")


@query("dedupe_fingerprints", f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY repository_id, fp ORDER BY regexp_replace(regexp_replace(file_path, '([^/]+)/', '1\\1/', 'g'), '([^/]+)$', '0\\1'), line_start, rule_id, id) AS rn
 FROM (SELECT *, sha256(concat_ws('|', rule_id, file_path, {squash('snippet')}, '0')) AS fp FROM v_findings)) WHERE rn = 1""")
def dedupe_fingerprints(t: Tables):
    rows = identity.with_fingerprints(t.file_findings.withColumn("occurrence", F.lit(0)))
    return identity.dedupe_fingerprints(rows).select("id")


@query("truncate_findings", """SELECT repository_id, id, position, truncated FROM (SELECT repository_id, id, count(*) OVER (PARTITION BY repository_id) >= 5 AS truncated, row_number() OVER (PARTITION BY repository_id
 ORDER BY regexp_replace(regexp_replace(file_path, '([^/]+)/', '1\\1/', 'g'), '([^/]+)$', '0\\1'), line_start, rule_id, id) AS position FROM v_findings) WHERE position <= 5""")
def truncate_findings(t: Tables):
    return identity.truncate_findings(t.file_findings, cap=5).select("repository_id", "id", "position", "truncated")


DIFF_SQL = f"""SELECT repository_id, rule_id, path, code, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after
 FROM (SELECT repository_id, rule_id, file_path AS path, {squash('snippet')} AS code, count(*) AS n FROM v_findings WHERE id % 5 <> 0 GROUP BY ALL) b
 FULL OUTER JOIN (SELECT repository_id, rule_id, file_path AS path, {squash('snippet')} AS code, count(*) AS n FROM v_findings WHERE id % 4 <> 0 GROUP BY ALL) a USING (repository_id, rule_id, path, code)"""


@query("finding_identity_diff", f"SELECT *, greatest(n_before - n_after, 0) AS gone, greatest(n_after - n_before, 0) AS appeared FROM ({DIFF_SQL})")
def finding_identity_diff(t: Tables):
    # Before and after a change are two versions of the whole table.
    before, after = t.file_findings.filter("id % 5 <> 0"), t.file_findings.filter("id % 4 <> 0")
    return identity.finding_identity_diff(before, after).drop("line")


@query("appeared_findings", f"SELECT repository_id, count(*) AS new_identities, sum(n_after - n_before)::BIGINT AS new_findings FROM ({DIFF_SQL}) WHERE n_after > n_before GROUP BY 1")
def appeared_findings(t: Tables):
    before, after = t.file_findings.filter("id % 5 <> 0"), t.file_findings.filter("id % 4 <> 0")
    return identity.appeared_findings(before, after).drop("first_new")


@query("identify", f"""SELECT count(*) AS findings, count(DISTINCT repository_id) AS repositories FROM (SELECT DISTINCT repository_id, rule_id, file_path, code, occ FROM (
 SELECT repository_id, rule_id, file_path, code, row_number() OVER (PARTITION BY repository_id, rule_id, file_path, code ORDER BY line_start, id) AS occ FROM (SELECT *, {squash('snippet')} AS code FROM v_findings)))""")
def identify(t: Tables):
    rows = t.file_findings.drop("fingerprint")
    numbered = identity.number_repeats(rows, repeat_bucket())
    unique = identity.dedupe_fingerprints(identity.with_fingerprints(numbered))
    return unique.agg(F.count("*").alias("findings"), F.count_distinct("repository_id").alias("repositories"))


@query("union_sources", "SELECT kind, count(*) AS documents, sum(length(name))::BIGINT AS characters FROM (SELECT 'doc' AS kind, text AS name FROM documents UNION ALL SELECT 'item', text FROM benchmark UNION ALL SELECT 'page', html FROM pages) GROUP BY 1")
def union_sources(t: Tables):
    from riskweave.sources.knowledge import union_sources as union

    parts = [
        t.documents.select(F.lit("doc").alias("kind"), F.col("text").alias("name")),
        t.read("benchmark").select(F.lit("item").alias("kind"), F.col("text").alias("name")),
        t.read("pages").select(F.lit("page").alias("kind"), F.col("html").alias("name")),
    ]
    return union(*parts).groupBy("kind").agg(F.count("*").alias("documents"), F.sum(F.length("name")).alias("characters"))

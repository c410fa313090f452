"""Detection: every rule, over source files derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import dims
from riskweave.operators import detect, pattern_rules, python_facts, python_rules, reachability
from riskweave.plans.adapters import Tables
from riskweave.plans.registry import query
from riskweave.plans.snippets import SNIPPETS

MATCH = ["repository_id", "path", "line_start", "rule_id"]
MATCH_SQL = "SELECT repository_id, path, line_start, rule_id FROM v_matches"


def python_findings(t: Tables):
    facts = reachability.parsed_once(python_facts.python_call_facts(t.code))
    return python_rules.python_matches(facts, reachability.python_levels(facts))


@query("detect_patterns", MATCH_SQL + " WHERE rule_id NOT LIKE 'PY%'")
def detect_patterns(t: Tables):
    return detect.detect(t.code).select(*MATCH)


@query("detect_python", MATCH_SQL + " WHERE rule_id LIKE 'PY%'")
def detect_python(t: Tables):
    return python_findings(t).select(*MATCH)


@query("union_analyzers", """SELECT repository_id, rule_id, count(*) AS matches FROM v_matches GROUP BY 1, 2""")
def union_analyzers(t: Tables):
    rows = detect.union_analyzers(detect.detect(t.code), python_findings(t))
    return rows.groupBy("repository_id", "rule_id").agg(F.count("*").alias("matches"))


def _line_rule(rule):
    @query(f"rule_{rule.rule_id}", MATCH_SQL + f" WHERE rule_id = '{rule.rule_id}'")
    def run(t: Tables):
        return detect.detect(t.code, registry=(rule,), with_secrets=False).select(*MATCH)


def _secret_rule(rule_id: str):
    @query(f"rule_{rule_id}", MATCH_SQL + f" WHERE rule_id = '{rule_id}'")
    def run(t: Tables):
        return detect.detect(t.code, registry=()).filter(F.col("rule_id") == rule_id).select(*MATCH)


def _python_rule(rule_id: str):
    @query(f"rule_{rule_id}", MATCH_SQL + f" WHERE rule_id = '{rule_id}'")
    def run(t: Tables):
        facts = python_facts.python_call_facts(t.code)
        if python_rules.needs_levels(rule_id):
            facts = reachability.parsed_once(facts)
        found = python_rules.python_rule(rule_id, facts, lambda: reachability.python_levels(facts))
        return found.select(*MATCH)


for _rule in pattern_rules.PATTERN_RULES:
    _line_rule(_rule)
for _id in dims.RULE_IDS:
    if _id.startswith("SEC"):
        _secret_rule(_id)
    elif _id.startswith("PY"):
        _python_rule(_id)


@query("one_secret_per_line", """SELECT repository_id, path, line_start, min(rule_id) AS rule_id, count(*) AS findings FROM v_matches WHERE rule_id LIKE 'SEC%' GROUP BY 1, 2, 3""")
def one_secret_per_line(t: Tables):
    rows = detect.detect(t.code, registry=())
    return rows.groupBy("repository_id", "path", "line_start").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("findings"))


@query("join_wrapped_statements", """SELECT repository_id, path, CAST(min(line_no) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS lines, sha256(string_agg(code, ' ' ORDER BY line_no)) AS statement FROM (
 SELECT *, (row_number() OVER (PARTITION BY path, grp ORDER BY line_no) - 1) // 12 AS piece FROM (
 SELECT *, sum(CASE WHEN prev_ends THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS grp FROM (
 SELECT *, coalesce(lag(code = '' OR regexp_matches(code, '[;{}]$')) OVER (PARTITION BY path ORDER BY line_no), false) AS prev_ends FROM (
 SELECT repository_id, path, line_no, trim(regexp_replace(line, '(^|\\s)(//|#)\\s.*$', ''), chr(9) || chr(10) || chr(13) || ' ') AS code FROM v_code_lines WHERE ext = '.java')))
 WHERE code <> '') GROUP BY repository_id, path, grp, piece HAVING count(*) > 1""")
def join_wrapped_statements(t: Tables):
    rows = detect.wrapped_statements(t.code)
    return rows.select("repository_id", "path", "first_line", "lines", F.sha2("statement", 256).alias("statement"))


@query("secret_context_window", """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, max(has) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS near
 FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, regexp_matches(lower(unnest(string_split(text, chr(10)))), 'token|password|passwd|secret|otp|nonce|session|cookie|csrf|salt|key') AS has FROM documents)""")
def secret_context_window(t: Tables):
    near = detect.near_secret_lines(F.col("lines"))
    rows = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    return rows.select("doc_id", F.posexplode(near).alias("pos", "near")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "near")


@query("python_call_facts", f"""SELECT path, count(*) FILTER (WHERE regexp_matches(line, '^import |^from ')) > 0 AS has_import, t = {len(SNIPPETS) - 1} AS unparsable FROM v_code_lines WHERE ext = '.py' GROUP BY path, t""")
def python_call_facts(t: Tables):
    facts = python_facts.python_call_facts(t.code)
    seen = facts.groupBy("path").agg(
        (F.count_if(F.col("fact") == "import") > 0).alias("has_import"), (F.count_if(F.col("fact") == "unparsable") > 0).alias("unparsable")
    )
    every = t.code.filter("ext = '.py'").select("path")
    return every.join(seen, "path", "left").select(
        "path", F.coalesce("has_import", F.lit(False)).alias("has_import"), F.coalesce("unparsable", F.lit(False)).alias("unparsable")
    )


# --- reachability ----------------------------------------------------------------------------


@query("taint_sources", """SELECT event_id AS id, CASE WHEN what = 'request' AND part IN ('method','user') THEN 'opaque' WHEN what = 'random' THEN 'random' ELSE 'input' END AS origin,
 CASE WHEN what = 'request' AND part = 'path' THEN 'redirect' ELSE '' END AS safe FROM (SELECT event_id, k,
 CASE WHEN k % 3 = 0 THEN 'request' WHEN k % 3 = 1 THEN 'parameter' ELSE 'random' END AS what, ['args','method','path','user','choice','seed'][k % 6 + 1] AS part, ['int','str'][k % 2 + 1] AS note FROM ev)
 WHERE what = 'request' OR (what = 'parameter' AND note <> 'int') OR (what = 'random' AND part = 'choice')""")
def taint_sources(t: Tables):
    from riskweave.plans.adapters import pick

    k = F.col("k")
    reads = t.events.select(
        F.col("event_id").alias("id"), F.when(k % 3 == 0, "request").when(k % 3 == 1, "parameter").otherwise("random").alias("what"),
        pick(("args", "method", "path", "user", "choice", "seed"), k % 6).alias("part"), pick(("int", "str"), k % 2).alias("annotation"), k.alias("line"),
    )
    return reachability.taint_sources(reads).select("id", "origin", F.array_join("safe_for", ",").alias("safe"))


@query("taint_sanitise_edges", """SELECT src, dst, array_to_string(list_sort(list_distinct(safe_for || CASE qualified WHEN 'html.escape' THEN ['html'] WHEN 'shlex.quote' THEN ['command'] WHEN 'os.path.basename' THEN ['path']
 WHEN 'app.escape_html' THEN ['html'] WHEN 'flask.url_for' THEN ['html','redirect'] ELSE [] END || CASE WHEN replaces_quote THEN ['xpath'] ELSE [] END)), ',') AS safe FROM v_edges""")
def taint_sanitise_edges(t: Tables):
    return reachability.taint_sanitise_edges(t.flow_edges).select("src", "dst", F.array_join("safe_for", ",").alias("safe"))


@query("taint_cut_edges", """SELECT 'edge' AS part, src, dst FROM v_edges WHERE qualified NOT IN ('int','len','open','requests.get','db.execute')
 UNION ALL SELECT DISTINCT 'opaque', NULL, dst FROM v_edges WHERE qualified IN ('open','requests.get','db.execute')""")
def taint_cut_edges(t: Tables):
    kept, opaque = reachability.taint_cut_edges(t.flow_edges)
    return kept.select(F.lit("edge").alias("part"), "src", "dst").unionByName(
        opaque.select(F.lit("opaque").alias("part"), F.lit(None).cast("bigint").alias("src"), F.col("id").alias("dst"))
    )


@query("taint_guard_edges", f"""SELECT event_id || '#' || k AS src, event_id || '#' || (k + 1) AS dst, array_to_string(list_sort(CASE k % 6 WHEN 0 THEN ['path'] WHEN 1 THEN ['xpath'] WHEN 2 THEN {list(dims.KINDS)} WHEN 3 THEN ['redirect']
 WHEN 4 THEN ['path','redirect'] END), ',') AS safe FROM ev WHERE k % 6 <> 5""")
def taint_guard_edges(t: Tables):
    from riskweave.plans.adapters import pick

    guards = t.events.select(
        F.col("event_id").alias("variable"), F.col("k").alias("version"),
        pick(("no_dot_dot", "no_quote", "membership", "host", "prefix", "not_empty"), F.col("k") % 6).alias("check"),
    )
    return reachability.taint_guard_edges(guards).select("src", "dst", F.array_join("safe_for", ",").alias("safe"))


REACH_SQL = """SELECT s.id, s.kind, CASE WHEN min(r.source) FILTER (WHERE r.origin = 'input') IS NOT NULL THEN 'tainted' WHEN bool_or(coalesce(r.origin = 'opaque', false)) THEN 'unknown' ELSE 'clean' END AS level,
 min(r.source) FILTER (WHERE r.origin = 'input') AS source FROM v_sinks s LEFT JOIN v_reach r ON r.id = s.id AND r.kind = s.kind GROUP BY 1, 2"""


@query("taint_reachability", REACH_SQL)
def taint_reachability(t: Tables):
    return reachability.taint_reachability(t.flow_nodes, t.flow_edges, t.flow_sinks)


@query("taint_classify", "SELECT level, kind, count(*) AS sinks FROM (" + REACH_SQL + ") GROUP BY 1, 2")
def taint_classify(t: Tables):
    state = reachability.propagate(t.flow_nodes, t.flow_edges)
    rows = reachability.classify(state, t.flow_sinks)
    return rows.groupBy("level", "kind").agg(F.count("*").alias("sinks"))


@query("taint_cap", """SELECT id, origin, line, safe FROM (SELECT id, origin, line, safe, count(*) OVER (PARTITION BY id) AS n FROM (SELECT user_id AS id, CASE WHEN k % 3 = 0 THEN 'opaque' ELSE 'input' END AS origin, event_id AS line,
 CASE WHEN event_type = 'view' THEN 'html' WHEN event_type = 'click' THEN 'html,path' ELSE 'html,sql' END AS safe FROM ev)) WHERE n <= 48 OR origin <> 'opaque'
 UNION ALL SELECT id, 'opaque', 0, CASE WHEN c = o THEN 'html,path' WHEN s = o THEN 'html,sql' ELSE 'html' END FROM (SELECT user_id AS id, count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS o, count(*) FILTER (WHERE k % 3 = 0 AND event_type = 'click') AS c,
 count(*) FILTER (WHERE k % 3 = 0 AND event_type NOT IN ('click','view')) AS s FROM ev GROUP BY 1) WHERE n > 48 AND o > 0""")
def taint_cap(t: Tables):
    kind = F.col("event_type")
    safe = (
        F.when(kind == "view", F.array(F.lit("html"))).when(kind == "click", F.array(F.lit("html"), F.lit("path")))
        .otherwise(F.array(F.lit("html"), F.lit("sql")))
    )
    reasons = t.events.select(
        F.col("user_id").alias("id"), F.when(F.col("k") % 3 == 0, "opaque").otherwise("input").alias("origin"),
        F.col("event_id").alias("line"), safe.alias("safe_for"),
    )
    return reachability.taint_cap(reasons).select("id", "origin", "line", F.array_join("safe_for", ",").alias("safe"))

"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import hashing, paths, scoring, text
from riskweave.operators import evaluation
from riskweave.plans.adapters import Tables, case, now
from riskweave.plans.registry import query
from riskweave.plans.views import path_kind, severity_rank, squash, suffix
from riskweave.plans.views import case as sql_case

SPARSE_SQL = "regexp_replace(text, '([a-z]) ([A-Z])', '\\1  ' || chr(9) || ' \\2', 'g')"


@query(
    "classify_language",
    f"""SELECT doc_id, path, CASE WHEN lower(regexp_extract(path, '([^/]*)$', 1)) LIKE 'dockerfile%' THEN 'Dockerfile'
    ELSE coalesce({sql_case(suffix('path'), dims.LANGUAGE_BY_SUFFIX)}, 'Other') END AS language
    FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'x/Dockerfile.' || doc_id ELSE path END AS path FROM v_files)""",
)
def classify_language(t: Tables):
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("x/Dockerfile."), F.col("doc_id").cast("string"))).otherwise(F.col("path"))
    rows = t.files.select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", paths.classify_language(F.col("path")).alias("language"))


@query(
    "finding_language",
    f"SELECT id, {sql_case(suffix('file_path'), dims.ADVICE_LANGUAGE)} AS language FROM v_findings",
)
def finding_language(t: Tables):
    return t.findings.select("id", paths.finding_language(F.col("file_path")).alias("language"))


@query(
    "owasp_code",
    """SELECT event_id, value, CASE WHEN n BETWEEN 1 AND 10 THEN 'A' || lpad(CAST(n AS VARCHAR), 2, '0') || ':' || y END AS code
    FROM (SELECT event_id, value, TRY_CAST(regexp_extract(value, '\\bA(\\d{1,2}):(\\d{4})\\b', 1) AS INTEGER) AS n,
    regexp_extract(value, '\\bA(\\d{1,2}):(\\d{4})\\b', 2) AS y FROM (SELECT event_id, 'see A' || (k % 14) || ':2021 ' || event_type AS value FROM ev))""",
)
def owasp_code(t: Tables):
    value = F.concat(F.lit("see A"), (F.col("k") % 14).cast("string"), F.lit(":2021 "), F.col("event_type"))
    return t.events.select("event_id", value.alias("value"), paths.owasp_code(value).alias("code"))


@query(
    "retrieval_query_text",
    f"""SELECT id, concat_ws(' ', title, message, cwe_id, owasp_category,
    CASE WHEN lang IS NOT NULL THEN 'in ' || lang END) AS query_text FROM (SELECT *, {sql_case(suffix('file_path'), dims.ADVICE_LANGUAGE)} AS lang FROM v_findings)""",
)
def retrieval_query_text(t: Tables):
    value = scoring.retrieval_query_text(*[F.col(c) for c in ("title", "message", "cwe_id", "owasp_category", "file_path")])
    return t.findings.select("id", value.alias("query_text"))


@query(
    "collapse_whitespace",
    f"""SELECT doc_id, a || CASE WHEN a <> '' AND b <> '' THEN chr(10) || chr(10) ELSE '' END || b AS collapsed
    FROM (SELECT doc_id, {squash('s')} AS a, {squash('text')} AS b FROM (SELECT doc_id, {SPARSE_SQL} AS s, text FROM documents))""",
)
def collapse_whitespace(t: Tables):
    sparse = F.regexp_replace("text", "([a-z]) ([A-Z])", "$1  \t $2")
    joined = F.concat(sparse, F.lit("\n  \n"), F.col("text"))
    return t.documents.select("doc_id", text.collapse(joined).alias("collapsed"))


@query(
    "document_content_hash",
    """SELECT doc_id, sha256('Doc ' || doc_id || chr(30) || 'Body' || chr(31) || text || chr(30) || 'Origin' || chr(31) || source) AS content_hash FROM documents""",
)
def document_content_hash(t: Tables):
    sections = F.array(
        F.struct(F.lit("Body").alias("name"), F.col("text").alias("text")),
        F.struct(F.lit("Origin").alias("name"), F.col("source").alias("text")),
    )
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", hashing.document_content_hash(title, sections).alias("content_hash"))


@query(
    "path_context",
    f"SELECT id, file_path, rule_id, {path_kind('rule_id', 'file_path')} AS context FROM v_findings",
)
def path_context(t: Tables):
    return t.findings.select(
        "id", "file_path", "rule_id", paths.path_context(F.col("rule_id"), F.col("file_path")).alias("context")
    )


@query(
    "inert_line",
    """SELECT doc_id, CAST(i AS INTEGER) AS line_no, (trim(l) = '' OR (ext = '.py' AND l LIKE '#%') OR (ext = '.java' AND l LIKE '//%')
    OR trim(l) IN ('pass', '}')) AS inert
    FROM (SELECT doc_id, i, ext, CASE i % 5 WHEN 0 THEN '# ' || line WHEN 1 THEN '// ' || line WHEN 2 THEN ' pass ' WHEN 3 THEN '}' ELSE line END AS l
    FROM (SELECT doc_id, regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, string_split(text, chr(10)) AS lines FROM v_files),
    LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) u, LATERAL (SELECT lines[i] AS line) w)""",
)
def inert_line(t: Tables):
    rows = t.files.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    i = F.col("pos") + 1
    line = (
        F.when(i % 5 == 0, F.concat(F.lit("# "), "line")).when(i % 5 == 1, F.concat(F.lit("// "), "line"))
        .when(i % 5 == 2, F.lit(" pass ")).when(i % 5 == 3, F.lit("}")).otherwise(F.col("line"))
    )
    return rows.select("doc_id", i.alias("line_no"), paths.inert_line(line, F.col("path")).alias("inert"))


@query(
    "repository_label",
    """SELECT id, 'team' || project_id || '/r' || id AS label, 'r' || id AS slug FROM v_repositories""",
)
def repository_label(t: Tables):
    return t.repositories.select(
        "id", paths.repository_label(F.col("origin")).alias("label"), paths.download_slug(F.col("origin")).alias("slug")
    )


@query(
    "download_slug",
    """SELECT page_id, CASE WHEN s = '' THEN 'repository' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(substr(regexp_replace(
    regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '(?i)\\.(git|zip)$', '')), '[^a-z0-9]+', '-', 'g'),
    '^-+|-+$', '', 'g'), 1, 40), '^-+|-+$', '', 'g') AS s FROM pages)""",
)
def download_slug(t: Tables):
    return t.read("pages").select("page_id", paths.download_slug(F.col("url")).alias("slug"))


@query(
    "printable_text",
    """SELECT doc_id, regexp_replace(text || chr(27) || chr(8203) || chr(8232), '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]', '?', 'g') AS plain FROM documents""",
)
def printable_text(t: Tables):
    value = F.concat("text", F.lit("\x1b\u200b\u2028"))
    return t.documents.select("doc_id", text.printable(value).alias("plain"))


@query(
    "cwe_url",
    """SELECT id, cwe_id, 'https://cwe.mitre.org/data/definitions/' || substr(cwe_id, 5) || '.html' AS url FROM v_findings""",
)
def cwe_url(t: Tables):
    return t.findings.select("id", "cwe_id", paths.cwe_url(F.col("cwe_id")).alias("url"))


@query(
    "split_half",
    f"""SELECT name, CASE WHEN ('0x' || substr(sha256('{hashing.DEFAULT_SPLIT_SALT}:' || name), 1, 2))::INTEGER % 2 = 0
    THEN 'development' ELSE 'held-out' END AS split FROM v_cases""",
)
def split_half(t: Tables):
    return t.cases.select("name", hashing.split_half(F.col("name")).alias("split"))


@query(
    "outcomes_hash",
    """WITH l AS (SELECT left(sha256(name), 4) AS k, name || ',' || CAST(reported AS INTEGER) AS leaf FROM v_cases),
    a AS (SELECT k, count(*) AS n, sha256(string_agg(leaf, chr(10) ORDER BY leaf)) AS leaf FROM l GROUP BY k),
    b AS (SELECT left(k, 2) AS k, sum(n) AS n, sha256(string_agg(leaf, chr(10) ORDER BY leaf)) AS leaf FROM a GROUP BY 1)
    SELECT sum(n)::BIGINT AS cases, sha256(string_agg(leaf, chr(10) ORDER BY leaf)) AS outcomes_sha256 FROM b""",
)
def outcomes_hash(t: Tables):
    return evaluation.outcomes_hash(t.cases)


@query(
    "grade",
    """SELECT event_id, CASE WHEN s < 10 THEN 'A' WHEN s < 25 THEN 'B' WHEN s < 45 THEN 'C' WHEN s < 70 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT event_id, least(value, 100.0) AS s FROM events)""",
)
def grade(t: Tables):
    return t.events.select("event_id", scoring.grade(F.least("value", F.lit(100.0))).alias("grade"))


@query(
    "safe_relative_path",
    """SELECT event_id, path, k % 7 IN (0, 6) AS safe FROM (SELECT *, CASE k % 7 WHEN 0 THEN 'src/a.py' WHEN 1 THEN '/etc/x' WHEN 2 THEN 'a/../b'
    WHEN 3 THEN 'C:\\x' WHEN 4 THEN 'a//b' WHEN 5 THEN 'a\\b' ELSE 'deep/' || event_type || '/f' END AS path FROM ev)""",
)
def safe_relative_path(t: Tables):
    k = F.col("k") % 7
    path = case(k, {0: "src/a.py", 1: "/etc/x", 2: "a/../b", 3: "C:\\x", 4: "a//b", 5: "a\\b"})
    path = F.coalesce(path, F.concat(F.lit("deep/"), F.col("event_type"), F.lit("/f")))
    return t.events.select("event_id", path.alias("path"), paths.safe_relative_path(path).alias("safe"))


@query("clean_snippet", """SELECT doc_id, CASE WHEN length(s) > 240 THEN substr(s, 1, 240) || '…' ELSE s END AS snippet
    FROM (SELECT doc_id, regexp_replace(regexp_replace(chr(7) || '  ' || text || chr(127) || ' ', '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS s FROM documents)""")
def clean_snippet(t: Tables):
    value = F.concat(F.lit("\x07  "), "text", F.lit("\x7f "))
    return t.documents.select("doc_id", text.clean_snippet(value).alias("snippet"))


@query("redact_secret", """SELECT event_id, substr(v, 1, 4) || '…<redacted ' || length(v) || ' chars>' AS redacted FROM (SELECT event_id, 'ghp_' || event_type || k AS v FROM ev)""")
def redact_secret(t: Tables):
    value = F.concat(F.lit("ghp_"), F.col("event_type"), F.col("k").cast("string"))
    return t.events.select("event_id", text.redact_secret(value).alias("redacted"))


@query("fingerprint", f"""SELECT id, sha256(concat_ws('|', rule_id, file_path, {squash('snippet')}, CAST(id % 3 AS VARCHAR))) AS fp FROM v_findings""")
def fingerprint(t: Tables):
    return t.findings.select(
        "id", hashing.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("snippet"), F.col("id") % 3).alias("fp")
    )


@query("severity_rank", f"SELECT id, {severity_rank('severity')} AS severity_rank FROM v_findings")
def severity_rank_query(t: Tables):
    return t.findings.select("id", scoring.severity_rank(F.col("severity")).alias("severity_rank"))


@query("is_credential", "SELECT id, coalesce(cwe_id = 'CWE-798', false) AS is_credential FROM v_findings")
def is_credential(t: Tables):
    return t.findings.select("id", scoring.is_credential(F.col("cwe_id")).alias("is_credential"))


@query("line_comment_strip", """SELECT doc_id, CAST(i AS INTEGER) AS line_no, regexp_replace(CASE WHEN i % 3 = 0 THEN l || ' // ' || l WHEN i % 3 = 1 THEN l || ' # x' ELSE l END,
    '(^|\\s)(//|#)\\s.*$', '') AS code FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) u, LATERAL (SELECT lines[i] AS l) w""")
def line_comment_strip(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))
    i = F.col("pos") + 1
    line = F.when(i % 3 == 0, F.concat("l", F.lit(" // "), "l")).when(i % 3 == 1, F.concat("l", F.lit(" # x"))).otherwise(F.col("l"))
    return rows.select("doc_id", i.alias("line_no"), text.strip_line_comment(line).alias("code"))


@query("statement_length_guard", """SELECT doc_id, count(*) AS statements FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) <= 1000 GROUP BY doc_id""")
def statement_length_guard(t: Tables):
    from riskweave.operators.pattern_rules import MAX_STATEMENT_LENGTH

    rows = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return rows.filter(F.length("l") <= MAX_STATEMENT_LENGTH).groupBy("doc_id").agg(F.count("*").alias("statements"))


@query("age_factor", "SELECT id, age_f FROM v_scored")
def age_factor(t: Tables):
    return t.findings.select("id", scoring.age_factor(F.col("created_at"), now()).alias("age_f"))



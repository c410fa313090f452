"""Fixes and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import answers, diffs
from riskweave.plans.adapters import Tables
from riskweave.plans.registry import query
from riskweave.plans.views import squash

LINES = """(SELECT doc_id, i, lines[i] AS x, len(lines) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 10 NOT IN (3, 4)), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) u)"""


@query("diff_lines", f"""SELECT doc_id AS patch_id, kind, CASE WHEN kind <> '+' THEN CAST(i AS INTEGER) END AS old_line, CASE WHEN kind <> '-' THEN CAST(i AS INTEGER) END AS new_line, CASE WHEN kind = '+' THEN x || ' fixed' ELSE x END AS text
 FROM {LINES}, LATERAL (SELECT unnest(CASE WHEN (i - 1) % 5 = 0 THEN ['-', '+'] ELSE [' '] END) AS kind) k""")
def diff_lines(t: Tables):
    return diffs.diff_lines(t.diffs).select("patch_id", "kind", F.col("old_line").cast("int").alias("old_line"), F.col("new_line").cast("int").alias("new_line"), "text")


@query("diff_problems", "SELECT doc_id AS patch_id, CASE WHEN doc_id % 10 = 3 AND len(string_split(text, chr(10))) = 1 THEN 'cut short' WHEN doc_id % 10 = 3 THEN 'cut short' ELSE 'names a different file' END AS reason FROM documents WHERE doc_id % 10 IN (3, 4)")
def diff_problems(t: Tables):
    return diffs.diff_problems(t.diffs)


@query("diff_stats", f"SELECT doc_id AS patch_id, count(*) FILTER (WHERE (i - 1) % 5 = 0) AS added, count(*) FILTER (WHERE (i - 1) % 5 = 0) AS removed, 1 AS hunks, 0 AS net FROM {LINES} GROUP BY 1")
def diff_stats(t: Tables):
    return diffs.diff_stats(diffs.diff_lines(t.diffs)).drop("file_path")


def originals(t: Tables):
    n = F.col("patch_id")
    rows = t.diffs.select("patch_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # Files of every eleventh patch have moved on: their first line is another one.
    moved = F.when((n % 11 == 0) & (F.col("pos") == 0), F.concat("line", F.lit("!"))).otherwise(F.col("line"))
    return rows.select("patch_id", (F.col("pos") + 1).alias("line_no"), moved.alias("line"))


@query("apply_hunks", f"SELECT doc_id AS patch_id, CAST(i AS INTEGER) AS line_no, CASE WHEN (i - 1) % 5 = 0 THEN x || ' fixed' ELSE x END AS line FROM {LINES} WHERE doc_id % 11 <> 0")
def apply_hunks(t: Tables):
    return diffs.apply_hunks(originals(t), diffs.diff_lines(t.diffs))


def screened(t: Tables):
    """Proposals over whole documents: replaced, mostly deleted, rewritten, or made a comment."""
    n = F.col("doc_id")
    lines = F.split("text", "\n")
    first = F.get(lines, F.lit(0))
    removed = F.transform(lines, lambda x: F.concat(F.lit("-"), x))
    extra = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("+y = "), i.cast("string")))
    body = (
        F.when(n % 4 == 0, F.array(F.concat(F.lit("-"), first), F.concat(F.lit("+x "), first)))
        .when(n % 4 == 1, F.concat(removed, F.array(F.lit("+z")))).when(n % 4 == 2, F.concat(F.slice(removed, 1, 1), extra))
        .otherwise(F.array(F.concat(F.lit("-"), first), F.lit("+# removed"), F.lit("+pass")))
    )
    olds = F.when(n % 4 == 1, F.size(lines)).otherwise(1)
    news = F.when(n % 4 == 2, 40).when(n % 4 == 3, 2).otherwise(1)
    path = F.concat(F.lit("src/d"), n.cast("string"), F.lit(".py"))
    head = F.concat(
        F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), olds.cast("string"), F.lit(" +1,"), news.cast("string"), F.lit(" @@\n")
    )
    diff = F.when(n % 13 == 0, F.lit("")).otherwise(F.concat(head, F.array_join(body, "\n"), F.lit("\n")))
    return t.documents.select(n.alias("patch_id"), path.alias("file_path"), diff.alias("diff"))


@query("patch_screen", """SELECT doc_id AS patch_id, CASE WHEN doc_id % 13 = 0 THEN 'same code' WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN CASE WHEN len(string_split(text, chr(10))) - 1 > 6 THEN 'mostly deletes code' ELSE '' END
 WHEN doc_id % 4 = 2 THEN 'rewrite' ELSE 'nothing that runs' END AS reasons FROM documents""")
def patch_screen(t: Tables):
    rows = screened(t)
    replaced = t.documents.select(F.col("doc_id").alias("patch_id"), F.lit(1).alias("replaced_lines"))
    return diffs.patch_screen(rows, diffs.diff_lines(rows), replaced).select("patch_id", F.array_join("reasons", "; ").alias("reasons"))


@query("judge_rescan", f"""SELECT patch_id, CASE WHEN coalesce(a.n, 0) < b.n THEN 'passed' ELSE 'failed' END AS target_resolved, CASE WHEN new_ids = 0 THEN 'passed' ELSE 'failed' END AS no_new_findings, new_ids AS new_identities, also::BIGINT AS also_resolved
 FROM (SELECT repository_id AS patch_id, min(fp) AS target FROM (SELECT *, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp FROM v_findings) WHERE id % 5 <> 0 GROUP BY 1) g
 JOIN (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 5 <> 0 GROUP BY 1, 2) b ON b.repository_id = patch_id AND b.fp = target
 LEFT JOIN (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 4 <> 0 GROUP BY 1, 2) a ON a.repository_id = patch_id AND a.fp = target
 JOIN (SELECT coalesce(x.repository_id, y.repository_id) AS r, count(*) FILTER (WHERE coalesce(y.n, 0) > coalesce(x.n, 0)) AS new_ids FROM (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 5 <> 0 GROUP BY 1, 2) x
 FULL OUTER JOIN (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 4 <> 0 GROUP BY 1, 2) y ON x.repository_id = y.repository_id AND x.fp = y.fp GROUP BY 1) w ON w.r = patch_id
 JOIN (SELECT x.repository_id AS r2, sum(CASE WHEN x.fp <> t.target THEN greatest(x.n - coalesce(y.n, 0), 0) ELSE 0 END) AS also FROM (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 5 <> 0 GROUP BY 1, 2) x
 JOIN (SELECT repository_id, min(rule_id || '|' || file_path || '|' || {squash('snippet')}) AS target FROM v_findings WHERE id % 5 <> 0 GROUP BY 1) t USING (repository_id)
 LEFT JOIN (SELECT repository_id, rule_id || '|' || file_path || '|' || {squash('snippet')} AS fp, count(*) AS n FROM v_findings WHERE id % 4 <> 0 GROUP BY 1, 2) y ON x.repository_id = y.repository_id AND x.fp = y.fp GROUP BY 1) v ON v.r2 = patch_id""")
def judge_rescan(t: Tables):
    from riskweave.operators.identity import identity_counts

    before, after = t.file_findings.filter("id % 5 <> 0"), t.file_findings.filter("id % 4 <> 0")
    named = identity_counts(before).withColumn("fp", F.concat_ws("|", "rule_id", "path", "code"))
    targets = named.groupBy(F.col("repository_id").alias("patch_id")).agg(
        F.min_by(F.struct("rule_id", "path", "code"), "fp").alias("x")
    ).select("patch_id", "x.*")
    stats = targets.select("patch_id", F.lit(2).alias("added"), F.lit(1).alias("removed"), F.lit(2).alias("live"))
    unparsable = targets.filter("patch_id % 9 = 0").select("patch_id")
    rows = diffs.judge_rescan(targets, before, after, stats, unparsable)
    return rows.select("patch_id", "target_resolved", "no_new_findings", "new_identities", "also_resolved")


CLEAN = "trim(regexp_replace(regexp_replace({0}, '[ \\t]{{2,}}', ' ', 'g'), '\\s+([.,;:])', '\\1', 'g'), chr(9) || chr(10) || chr(13) || ' ')"


@query("screen_explanations", f"""SELECT id, refused, CASE WHEN refused IS NULL THEN sha256(CASE WHEN m IN (1, 2) THEN {CLEAN.format('text')} ELSE {CLEAN.format("'One. ' || text")} END) END AS summary,
 CASE WHEN refused IS NULL THEN CASE WHEN m IN (1, 2) THEN '1,2' ELSE '3' END END AS citations, CASE WHEN refused IS NULL THEN CASE WHEN m IN (1, 2) THEN 2 ELSE 0 END END AS dropped_citations,
 CASE WHEN refused IS NULL THEN CASE WHEN m IN (1, 2) THEN 1 ELSE 0 END END AS links_removed, CASE WHEN refused IS NULL THEN true END AS grounded
 FROM (SELECT *, CASE WHEN m = 0 THEN 'not a JSON object' WHEN m = 3 OR length(text) > 2000 OR (m > 3 AND length(text) + 5 > 2000) THEN 'does not fit the format' END AS refused
 FROM (SELECT conv_id * 1000 + turn AS id, conv_id % 6 AS m, text FROM conversations WHERE role = 'assistant'))""")
def screen_explanations(t: Tables):
    rows = answers.screen_explanations(t.answers)
    return rows.select(
        "id", "refused", F.sha2("summary", 256).alias("summary"),
        F.array_join(F.transform("citations", lambda n: n.cast("string")), ",").alias("citations"),
        "dropped_citations", "links_removed", "grounded",
    )


@query("screen_patch_answers", """SELECT id, CASE WHEN m = 3 THEN 'not a JSON object' END AS refused, CASE WHEN m < 3 THEN 'x = ' || turn || chr(10) || 'y = 2' END AS replacement, CASE WHEN m < 3 THEN 'why ' || role END AS rationale,
 CASE WHEN m < 3 THEN m = 2 END AS fences_stripped, CASE WHEN m < 3 THEN CASE WHEN m = 1 THEN 2 ELSE 0 END END AS gutters_stripped FROM (SELECT conv_id * 1000 + turn AS id, conv_id % 4 AS m, turn, role FROM conversations)""")
def screen_patch_answers(t: Tables):
    return answers.screen_patch_answers(t.patch_answers)


@query("reindent_replacement", """SELECT doc_id, repeat(' ', doc_id % 7) || 'if x:' || chr(10) || repeat(' ', doc_id % 7 + 4) || regexp_extract(text, '[A-Za-z]+') || chr(10) || repeat(' ', doc_id % 7) || 'end' AS shifted FROM documents""")
def reindent_replacement(t: Tables):
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    block = F.concat(F.lit("  if x:\n      "), word, F.lit("\n  end"))
    original = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 7).cast("int")), F.lit("call()"))
    return t.documents.select("doc_id", diffs.reindent_replacement(block, original).alias("shifted"))

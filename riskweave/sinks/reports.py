"""Reports as JSON lines, Markdown, HTML and editor diagnostics; untrusted text is made inert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths, text
from riskweave.functions.text import html_text, markdown_block, markdown_code, markdown_paragraph, markdown_text
from riskweave.operators.numbering import number_rows
from riskweave.operators.report import LIMITATIONS
from riskweave.operators.risk import grade_label, short_number
from riskweave.sinks.documents import lines, union

JSON_FIELDS = (
    "id", "rule_id", "title", "message", "severity", "confidence", "cwe_id", "owasp_category", "file_path",
    "line_start", "line_end", "snippet", "status", "fingerprint", "is_credential", "score",
    "score_explanation", "fix_state", "fix_label",
)
#: Characters of an editor message, at most (fixed value).
MAX_DIAGNOSTIC = 1200


def _keys() -> list[Column]:
    is_open = F.col("part") == "open"
    return [
        F.when(is_open, -F.col("score")), F.when(is_open, F.col("severity_rank")), F.col("file_path"),
        F.col("line_start"), F.col("id"),
    ]


def export_report_json(report: DataFrame, risk: DataFrame) -> DataFrame:
    """JSON Lines: a header object per repository, then one object per finding in reading order."""
    head = F.to_json(
        F.struct(
            "repository_id", "score", "grade", grade_label(F.col("grade")).alias("grade_label"), "open", "fixed",
            *[F.col(s.lower()) for s in dims.SEVERITIES], "policy_version",
        )
    )
    item = F.to_json(F.struct(*JSON_FIELDS))
    # Both parts in one reading: a report is made of joins.
    section = F.when(F.col("part") == "open", 1).otherwise(2)
    return union(lines(risk, 0, head), lines(report.filter("part in ('open', 'fixed')"), section, item, _keys()))


def _numbered(report: DataFrame) -> DataFrame:
    open_rows = report.filter("part = 'open'").withColumn("minus", -F.col("score"))
    bucket = F.struct("minus", "severity_rank", "file_path")
    return number_rows(
        open_rows, ["repository_id"], bucket, ["minus", "severity_rank", "file_path", "line_start", "id"], "number"
    )


def export_markdown(report: DataFrame, risk: DataFrame, rules: DataFrame) -> DataFrame:
    """The Markdown report of every repository as ordered lines."""
    location = markdown_code(F.concat("file_path", F.lit(":"), F.col("line_start").cast("string")))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Repository "), F.col("repository_id").cast("string"), F.lit(": what the scan found")), F.lit(""),
        F.concat(
            F.lit("Grade "), "grade", F.lit(", "), grade_label(F.col("grade")), F.lit(": "), short_number(F.col("score")),
            F.lit(" points of 100 by version "), F.col("policy_version").cast("string"), F.lit(" of the risk policy. "),
            F.col("open").cast("string"), F.lit(" open, "), F.col("fixed").cast("string"), F.lit(" no longer found."),
        ),
        F.lit(""), F.lit("| open | |"), F.lit("| :-- | --: |"),
        *[F.concat(F.lit(f"| {s.lower()} | "), F.col(s.lower()).cast("string"), F.lit(" |")) for s in dims.SEVERITIES],
        F.lit(""), F.lit("## Rules that matched"), F.lit(""),
    )
    rule = F.concat_ws(
        "\n", F.concat(F.lit("### "), markdown_text(F.col("rule_id")), F.lit(": "), markdown_text(F.col("title"))),
        F.lit(""),
        F.concat_ws(
            " · ",
            F.concat(F.col("count").cast("string"), F.when(F.col("count") == 1, " place").otherwise(" places")),
            F.concat(F.lit("up to "), F.lower("worst_severity")), F.col("cwe_id"), F.col("owasp_category"),
        ),
        F.lit(""),
        F.when(F.col("risk_note").isNotNull(), F.concat(F.lit("Why it matters: "), markdown_text(F.col("risk_note")), F.lit("\n"))),
        F.when(F.col("fix_note").isNotNull(), F.concat(F.lit("What helps: "), markdown_text(F.col("fix_note")), F.lit("\n"))),
    )
    finding = F.concat_ws(
        "\n",
        F.concat(
            F.lit("### "), F.col("number").cast("string"), F.lit(". "), "severity", F.lit(": "), markdown_text(F.col("title"))
        ),
        F.lit(""), F.concat(F.lit("- In "), location),
        F.concat(
            F.lit("- Matched by "),
            F.concat_ws(" · ", markdown_text(F.col("rule_id")), F.col("cwe_id"), F.col("owasp_category")),
        ),
        F.concat(F.lit("- "), F.initcap("confidence"), F.lit(" confidence, "), F.lower("status")),
        F.concat(F.lit("- Scores "), short_number(F.col("score")), F.lit(": "), markdown_code(F.col("score_explanation"))),
        F.concat(F.lit("- Fix: "), "fix_label"), F.lit(""), markdown_paragraph(F.col("message")), F.lit(""),
        F.when(F.trim("snippet") != "", F.concat(markdown_block(F.col("snippet")), F.lit("\n"))),
    )
    gone = F.concat(
        F.lit("| "), "severity", F.lit(" | "), markdown_text(F.col("rule_id")), F.lit(" | "),
        markdown_text(F.col("title")), F.lit(" | "), location, F.lit(" |"),
    )
    limits = "\n".join(["", "## How far this goes", "", *[f"- {x}" for x in LIMITATIONS]])
    titles = "## No longer found\n\n| was | rule | what | where |\n| :-- | :-- | :-- | :-- |"
    rule_keys = [F.col("severity_rank"), (-F.col("count")), F.col("rule_id")]
    fixed_rows = report.filter("part = 'fixed'")
    return union(
        lines(risk, 0, head), lines(rules, 1, rule, rule_keys), lines(risk, 2, F.lit("## Open\n")),
        lines(_numbered(report), 3, finding, _keys()), lines(risk.filter("fixed > 0"), 4, F.lit(titles)),
        lines(fixed_rows, 5, gone, _keys()), lines(risk, 6, F.lit(limits)),
    )


def export_html(report: DataFrame, risk: DataFrame, rules: DataFrame) -> DataFrame:
    """The HTML report of every repository as ordered lines; no script, no outside address."""
    policy = "default-src 'none'; style-src 'unsafe-inline'; base-uri 'none'; form-action 'none'"
    style = "body{font:15px/1.5 sans-serif;max-width:900px;margin:auto}pre{white-space:pre-wrap}"
    head = F.concat(
        F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8">'
              f'<meta http-equiv="Content-Security-Policy" content="{policy}"><style>{style}</style>'
              "<title>Security report</title></head><body><main><h1>Repository "),
        F.col("repository_id").cast("string"), F.lit("</h1><p>Risk grade <b>"), "grade", F.lit("</b> ("),
        short_number(F.col("score")), F.lit(" of 100), "), F.col("open").cast("string"), F.lit(" open, "),
        F.col("fixed").cast("string"), F.lit(" fixed.</p><h2>By rule</h2>"),
    )
    rule = F.concat(
        F.lit("<p><b>"), html_text(F.col("rule_id")), F.lit("</b> "), html_text(F.col("title")), F.lit(": "),
        F.col("count").cast("string"), F.lit(", worst "), "worst_severity", F.lit("</p>"),
        F.coalesce(F.concat(F.lit("<p>"), html_text(F.col("fix_note")), F.lit("</p>")), F.lit("")),
    )
    place = html_text(F.concat("file_path", F.lit(":"), F.col("line_start").cast("string")))
    finding = F.concat(
        F.lit("<section><h3>"), F.col("number").cast("string"), F.lit(". "), "severity", F.lit(": "),
        html_text(F.col("title")), F.lit("</h3><p><code>"), place, F.lit("</code> "), html_text(F.col("rule_id")),
        F.lit(" "), html_text(F.col("cwe_id")), F.lit("</p><p>"), html_text(F.col("message")),
        F.lit("</p><p>Risk "), html_text(F.col("score_explanation")), F.lit("</p><p>"), html_text(F.col("fix_label")),
        F.lit("</p>"),
        F.when(F.trim("snippet") != "", F.concat(F.lit("<pre><code>"), html_text(F.col("snippet")), F.lit("</code></pre>"))).otherwise(""),
        F.lit("</section>"),
    )
    gone = F.concat(
        F.lit("<p>Fixed: "), html_text(F.col("rule_id")), F.lit(" <code>"), place, F.lit("</code></p>")
    )
    limits = "".join(f"<li>{x}</li>" for x in LIMITATIONS)
    rule_keys = [F.col("severity_rank"), (-F.col("count")), F.col("rule_id")]
    return union(
        lines(risk, 0, head), lines(rules, 1, rule, rule_keys), lines(risk, 2, F.lit("<h2>Open findings</h2>")),
        lines(_numbered(report), 3, finding, _keys()), lines(report.filter("part = 'fixed'"), 4, gone, _keys()),
        lines(risk, 5, F.lit(f"<footer><ul>{limits}</ul></footer></main></body></html>")),
    )


# --- editor diagnostics ----------------------------------------------------------------------

# --- fixed values: editor levels ---
EDITOR_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "information", "INFO": "hint"}


def _one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))


def diagnostics(findings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """One row per placeable finding: 0-based lines, level, message, link; unsafe paths left out."""
    from riskweave.functions.scoring import case_of, is_credential

    rows = findings.filter(paths.safe_relative_path(F.col("file_path")) & F.col("line_start").isNotNull())
    fix = F.lit(None).cast("string")
    if notes is not None:
        rows = rows.join(notes.groupBy("rule_id").agg(F.min("fix").alias("fix_note")), "rule_id", "left")
        fix = F.col("fix_note")
    rotate = F.lit("Replace this credential where it was issued: whoever can read the history has it.")
    # What an editor shows: a heading (the rule where there is no title), the explanation, what to do.
    said = F.transform(
        F.array(F.coalesce("title", F.lit("")), F.coalesce("message", F.lit("")), F.coalesce(fix, F.lit(""))), _one_line
    )
    heading = F.coalesce(F.nullif(F.get(said, 0), F.lit("")), F.concat(F.lit("Matched by "), F.col("rule_id")))
    advice = F.when(is_credential(F.col("cwe_id")), rotate).otherwise(F.get(said, 2))
    message = F.array_join(F.filter(F.array(heading, F.get(said, 1), advice), lambda part: part != ""), "\n")
    clipped = F.when(
        F.length(message) > MAX_DIAGNOSTIC, F.concat(F.substring(message, 1, MAX_DIAGNOSTIC - 1), F.lit(text.ELLIPSIS))
    ).otherwise(message)
    line = F.greatest(F.col("line_start") - 1, F.lit(0))
    return rows.select(
        "repository_id", "file_path", "id", line.alias("line"),
        F.greatest(line, F.coalesce(F.col("line_end") - 1, line)).alias("last_line"),
        case_of(F.col("severity"), EDITOR_LEVELS, "warning").alias("level"), clipped.alias("message"),
        F.coalesce(F.nullif(_one_line(F.col("rule_id")), F.lit("")), F.lit("finding")).alias("code"),
        paths.cwe_url(F.col("cwe_id")).alias("code_url"),
    )


def diagnostics_by_file(findings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Items grouped per file (a file holds at most 1 MB of code, so a group is bounded)."""
    item = F.struct("line", "last_line", "id", "level", "code", "code_url", "message")
    return diagnostics(findings, notes).groupBy("repository_id", "file_path").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def diagnostics_skipped(findings: DataFrame) -> DataFrame:
    placed = F.coalesce(paths.safe_relative_path(F.col("file_path")) & F.col("line_start").isNotNull(), F.lit(False))
    return findings.groupBy("repository_id").agg(
        F.count_if(placed).alias("placed"), F.count_if(~placed).alias("skipped")
    )

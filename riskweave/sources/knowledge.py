"""Knowledge sources: the weakness catalogue, the Top 10 documents and a team's own notes.

All of them give ``documents(source, external_id, title, url, source_version, cwe_id,
owasp_category, rule_id, sections array<struct<name, text>>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import paths, text

SECTION = "array<struct<name: string, text: string>>"
SKIPPED_SECTIONS = ("references", "list of mapped cwes")

CWE_SCHEMA = """
_ID string, _Name string, _Status string, Description string, Extended_Description string,
Applicable_Platforms struct<
  Language: array<struct<_Name: string, _Class: string>>,
  Technology: array<struct<_Name: string, _Class: string>>>,
Common_Consequences struct<Consequence: array<struct<
  Scope: array<string>, Impact: array<string>, Note: array<string>>>>,
Potential_Mitigations struct<Mitigation: array<struct<
  Phase: array<string>, Strategy: string, Description: string>>>
"""


def non_empty_sections(sections: Column) -> Column:
    """Sections with their white space collapsed, blank ones dropped."""
    cleaned = F.transform(
        sections,
        lambda s: F.struct(
            s["name"].alias("name"), text.collapse(F.coalesce(s["text"], F.lit(""))).alias("text")
        ),
    )
    return F.filter(cleaned, lambda s: s["text"] != "")


def _section(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("text"))


def _inner_text(value: Column) -> Column:
    """Catalogue prose without the markup inside it."""
    return F.regexp_replace(value, r"</?[A-Za-z][\w:.-]*(?:\s[^<>]*)?>", " ")


def _joined(values: Column, by: str) -> Column:
    return F.coalesce(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), by), F.lit(""))


def _document(
    source: str, external_id: Column, title: Column, sections: Column, *, url: Column | None = None,
    version: Column | None = None, cwe: Column | None = None, owasp: Column | None = None,
    rule: Column | None = None,
) -> list[Column]:
    none = F.lit(None).cast("string")
    pick = lambda value: none if value is None else value
    return [
        F.lit(source).alias("source"), external_id.alias("external_id"), title.alias("title"),
        pick(url).alias("url"), pick(version).alias("source_version"), pick(cwe).alias("cwe_id"),
        pick(owasp).alias("owasp_category"), pick(rule).alias("rule_id"), sections.alias("sections"),
    ]


def refuse_doctype(spark: SparkSession, path: str) -> None:
    """Entity tricks need a DOCTYPE: a catalogue that has one is refused before it is parsed."""
    lines = spark.read.text(path)
    if not lines.filter(F.lower("value").rlike("<!doctype|<!entity")).isEmpty():
        raise ValueError("the catalogue contains a DOCTYPE declaration, which is refused")


def read_cwe_catalogue(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Weaknesses of the catalogue XML; deprecated ones dropped, an empty result refused lazily."""
    refuse_doctype(spark, path)
    rows = spark.read.format("xml").option("rowTag", "Weakness").schema(CWE_SCHEMA).load(path)
    rows = rows.filter(
        F.col("_ID").isNotNull() & F.col("_Name").isNotNull()
        & (F.lower(F.coalesce("_Status", F.lit(""))) != "deprecated")
    )
    platforms = F.concat(
        F.coalesce(F.col("Applicable_Platforms.Language"), F.array()),
        F.coalesce(F.col("Applicable_Platforms.Technology"), F.array()),
    )
    names = F.array_distinct(F.transform(platforms, lambda p: F.coalesce(p["_Name"], p["_Class"])))

    def consequence(item: Column) -> Column:
        heads = F.array(_joined(item["Scope"], ", "), _joined(item["Impact"], ", "))
        return _joined(F.array(_joined(heads, " / "), _inner_text(_joined(item["Note"], " "))), " ")

    def mitigation(item: Column) -> Column:
        label = _joined(F.array(_joined(item["Phase"], ", "), item["Strategy"]), " — ")
        body = _inner_text(F.coalesce(item["Description"], F.lit("")))
        return F.when(label == "", body).when(body == "", label).otherwise(F.concat(label, F.lit(": "), body))

    sections = non_empty_sections(
        F.array(
            _section("Description", _inner_text(_joined(F.array("Description", "Extended_Description"), " "))),
            _section("Applicable platforms", _joined(names, ", ")),
            _section(
                "Consequences", _joined(F.transform("Common_Consequences.Consequence", consequence), "\n\n")
            ),
            _section(
                "Mitigations", _joined(F.transform("Potential_Mitigations.Mitigation", mitigation), "\n\n")
            ),
        )
    )
    cwe = F.concat(F.lit("CWE-"), F.col("_ID"))
    return rows.select(
        *_document(
            "cwe", cwe, F.concat(cwe, F.lit(": "), F.col("_Name")), sections,
            url=paths.cwe_url(cwe), version=F.lit(version), cwe=cwe,
        )
    ).filter(F.size("sections") > 0)


def parse_owasp_markdown(documents: DataFrame) -> DataFrame:
    """Top 10 documents from ``(name, text)``: an H1 title, H2 sections, A01..A10 only."""
    raw = F.col("text")
    h1 = r"(?m)^#\s+(.+?)\s*$"
    title = F.coalesce(F.nullif(F.regexp_extract(raw, h1, 1), F.lit("")), F.col("name"))
    code = F.coalesce(paths.owasp_code(title), paths.owasp_code(F.col("name")))
    # Everything after the first H1; then one piece per H2, the piece before the first being
    # the overview.
    body = F.when(raw.rlike(h1), F.regexp_replace(raw, r"(?s)^.*?(?:^|\n)#\s+[^\n]+", "")).otherwise(raw)
    pieces = F.split(F.concat(F.lit("\n"), body), r"\n##\s+")

    def piece(value: Column, i: Column) -> Column:
        head = F.trim(F.regexp_extract(value, r"^([^\n]*)", 1))
        rest = F.regexp_replace(value, r"^[^\n]*\n?", "")
        return F.struct(
            F.when(i == 0, F.lit("Overview")).otherwise(head).alias("name"),
            F.when(i == 0, value).otherwise(rest).alias("text"),
        )

    sections = non_empty_sections(
        F.filter(F.transform(pieces, piece), lambda s: ~F.lower(s["name"]).isin(*SKIPPED_SECTIONS))
    )
    slug = F.regexp_replace(F.regexp_replace(title, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    url = F.concat(F.lit("https://owasp.org/Top10/"), slug, F.lit("/"))
    parsed = documents.filter(code.isNotNull())
    return parsed.select(
        *_document("owasp", code, title, sections, url=url, version=F.lit("2021"), owasp=code)
    ).filter(F.size("sections") > 0)


def read_owasp_markdown(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    name = F.regexp_replace(paths.file_name(F.col("_metadata.file_path")), r"\.md$", "")
    return parse_owasp_markdown(raw.select(name.alias("name"), F.col("value").alias("text")))


def read_rule_notes(notes: DataFrame, rules: DataFrame) -> DataFrame:
    """A team's notes ``(rule_id, title, language, risk, fix)`` as documents tagged by their rule."""
    joined = notes.join(
        F.broadcast(rules.select("rule_id", "cwe_id", "owasp_category")), "rule_id", "left"
    )
    sections = non_empty_sections(F.array(_section("Risk", F.col("risk")), _section("Fix", F.col("fix"))))
    title = F.format_string("%s: %s (%s)", "rule_id", "title", "language")
    return joined.select(
        *_document(
            "notes", F.col("rule_id"), title, sections, cwe=F.col("cwe_id"),
            owasp=paths.owasp_code(F.col("owasp_category")), rule=F.col("rule_id"),
        )
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out

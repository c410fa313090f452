import json

import pytest
from pyspark.sql import functions as F

from riskweave.functions import paths, text
from riskweave.sinks import documents, sarif
from riskweave.sources import answer_key, archive, knowledge, tree
from riskweave.sources import sarif as sarif_source


def test_tree_on_disk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_bytes(b"x = 1\r\ny = 2\n")
    (tmp_path / "src" / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "src" / "bin.txt").write_bytes(b"a\x00b")
    (tmp_path / "src" / "big.txt").write_bytes(b"z" * 2000)
    (tmp_path / "node_modules" / "x.js").write_text("1")
    (tmp_path / "yarn.lock").write_text("1")
    (tmp_path / "pic.png").write_bytes(b"1")
    files = tree.decode_text(tree.scan_source_tree(spark, str(tmp_path)), max_bytes=1000)
    got = {r.path: (r.ext, r.skipped, r.text) for r in files.collect()}
    assert got == {
        "src/a.py": (".py", None, "x = 1\r\ny = 2\n"), "src/latin.txt": (".txt", None, "café"),
        "src/bin.txt": (".txt", "binary", None), "src/big.txt": (".txt", "too large", None),
    }
    lines = tree.explode_lines(files).filter("path = 'src/a.py'").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in lines] == [(1, "x = 1"), (2, "y = 2")]


def test_walk_order(spark):
    wanted = ["a.py", "z.py", "b/a.py", "b/c/x.py", "b2/a.py"]
    rows = spark.createDataFrame([(p,) for p in reversed(wanted)], "path string")
    assert [r.path for r in rows.orderBy(paths.walk_order_key(F.col("path"))).collect()] == wanted


def test_answer_key_file(spark, tmp_path):
    (tmp_path / "expected.csv").write_text("﻿# test name, category, Benchmark version: 1.2\nCase1,cmdi,true,78\nCase2,hash,maybe,1\n\nCase1,cmdi,false,78\n9x,cmdi,true,1\nCase4,cmdi\n")
    lines = answer_key.key_lines(spark, str(tmp_path / "expected.csv"))
    assert answer_key.key_version(lines).first().version == "1.2"
    got = {r.line_no: r.reason for r in answer_key.parse_answer_key(lines).collect()}
    assert got == {
        2: None, 3: "answer is not true or false", 5: "repeats an earlier test name", 6: "unusable test name", 7: "fewer than four fields",
    }


def test_archive_audit(spark):
    rows = [
        (1, "proj/a.py", 10, 5, 0o100644), (1, "proj/b/", 0, 0, 0), (2, "../x", 1, 1, 0), (3, "C:\\x", 1, 1, 0), (4, "a", 10_000_000, 10, 0o120777), (5, "x", 5, 5, 0),
    ]
    df = spark.createDataFrame(rows, "archive_id bigint, name string, file_size bigint, compressed_size bigint, unix_mode int")
    got = {r.archive_id: (r.reasons, r.root_prefix) for r in archive.audit_archives(df).collect()}
    assert got[1] == ("", "proj") and got[2][0] == got[3][0] == "unsafe entry" and got[5] == ("", None)
    assert got[4][0] == "unsafe entry; expands too much"


CATALOGUE = """<?xml version="1.0"?><Weakness_Catalog Version="4.1" xmlns="http://cwe.mitre.org/cwe-7"><Weaknesses>
<Weakness ID="89" Name="SQL" Status="Stable"><Description>One.</Description><Extended_Description><p>Two <b>three</b>.</p></Extended_Description>
<Potential_Mitigations><Mitigation><Phase>Implementation</Phase><Strategy>Params</Strategy><Description>Bind.</Description></Mitigation></Potential_Mitigations></Weakness>
<Weakness ID="1" Name="Old" Status="Deprecated"><Description>Gone</Description></Weakness></Weaknesses></Weakness_Catalog>"""


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.xml").write_text(CATALOGUE)
    rows = knowledge.read_cwe_catalogue(spark, str(tmp_path / "c.xml")).collect()
    assert [(r.external_id, r.title) for r in rows] == [("CWE-89", "CWE-89: SQL")]
    assert [(s.name, s.text) for s in rows[0].sections] == [
        ("Description", "One. Two three ."), ("Mitigations", "Implementation — Params: Bind."),
    ]
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x>" + CATALOGUE)
    with pytest.raises(ValueError):
        knowledge.read_cwe_catalogue(spark, str(tmp_path / "bad.xml"))


def test_top_ten_markdown(spark, tmp_path):
    (tmp_path / "A03.md").write_text("# A03:2021 – Injection\n\nIntro.\n\n## Overview\n\nText  here.\n\n## References\n\n- x\n")
    (tmp_path / "A11.md").write_text("# A11:2021 Next\n\ntext\n")
    rows = knowledge.read_owasp_markdown(spark, str(tmp_path)).collect()
    assert [(r.external_id, [(s.name, s.text) for s in r.sections]) for r in rows] == [
        ("A03:2021", [("Overview", "Intro."), ("Overview", "Text here.")])
    ]


def test_sarif_document_is_json_and_reads_back(spark, tmp_path):
    rows = [(1, i, "PY001", "HIGH", "m", f'a"{i}.py', 3, 3, "x | `y`", f"fp{i}", "HIGH", "OPEN", float(40 - i), "none", 1, "open") for i in range(5)]
    report = spark.createDataFrame(
        rows, "repository_id bigint, id bigint, rule_id string, severity string, message string, file_path string, line_start int, line_end int, "
        "snippet string, fingerprint string, confidence string, status string, score double, fix_state string, severity_rank int, part string",
    )
    rules = spark.createDataFrame(
        [(1, "PY001", 5, 1, "HIGH", "T", "CWE-95", "A03:2021 Injection", None, "Fix.")],
        "repository_id bigint, rule_id string, count bigint, severity_rank int, worst_severity string, title string, cwe_id string, owasp_category string, risk_note string, fix_note string",
    )
    risk = spark.createDataFrame([(1, 99.0, "F", 2)], "repository_id bigint, score double, grade string, policy_version int")
    header = spark.createDataFrame([(1, "https://h/r.git", "main", "abc", False)], "repository_id bigint, origin string, branch string, commit_hash string, truncated boolean")
    made = sarif.export_sarif(report, rules, risk, header)
    ordered = [r.line for r in made.orderBy(*documents.ORDER).collect()]
    log = json.loads("".join(ordered))
    run = log["runs"][0]
    assert [r["properties"]["riskScore"] for r in run["results"]] == [40.0, 39.0, 38.0, 37.0, 36.0]
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"] == ["security", "external/cwe/cwe-95"]
    documents.write_documents(made, str(tmp_path / "out"), 3)
    parts = sorted((tmp_path / "out" / "repository_id=1").glob("part-*"))
    assert json.loads("".join(p.read_text() for p in parts)) == log
    (tmp_path / "log.sarif").write_text(json.dumps(log))
    assert sarif_source.read_sarif_fingerprints(spark, str(tmp_path / "log.sarif")).count() == 5
    (tmp_path / "no.sarif").write_text("{}")
    with pytest.raises(Exception, match="no runs"):
        sarif_source.read_sarif_fingerprints(spark, str(tmp_path / "no.sarif")).collect()


def test_hostile_text_is_inert(spark):
    values = ["](http://x) <b>&", "1. list", "- item", "``` `x` |", "=="]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select(text.markdown_text(F.col("v")), text.markdown_paragraph(F.col("v")), text.markdown_code(F.col("v")), text.html_text(F.col("v"))).collect()
    assert got[0][0] == "\\](http://x) &lt;b&gt;&amp;" and got[1][1] == "1\\. list" and got[2][1] == "\\- item" and got[4][1] == "\\=="
    assert got[3][2] == "```` ``` `x` \\| ````" and got[0][3] == "](http://x) &lt;b&gt;&amp;"


def test_exclusions(spark):
    rows = spark.createDataFrame([(p,) for p in ("tests/a.py", "testsuite/a.py", "a/b.min.js", "x/fixtures/f.py", "src/[a].py")], "p string")
    hit = paths.is_excluded(F.col("p"), ("tests/", "*.min.js", "**/fixtures/*.py", "src/[[]a].py"))
    assert [r[0] for r in rows.select(hit).collect()] == [True, False, True, True, True]

import json

from pyspark.sql import functions as F

from riskweave.operators import answers, diffs

HEAD = "--- a/src/a.py\n+++ b/src/a.py\n"
DIFFS = [
    (1, HEAD + "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n@@ -6,2 +6,3 @@\n f\n+--- x\n g\n"),
    (2, HEAD + "@@ -1,3 +1,3 @@\n a\n-b\n+B\n"),
    (3, HEAD + "@@ -1 +1 @@\r\n-a\r\n+A\r\n\\ No newline at end of file\n"),
    (4, "--- a/src/other.py\n+++ b/src/a.py\n@@ -1 +1 @@\n-a\n+A\n"),
    (5, HEAD + "@@ -1 +1 @@\n-a\n+A\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-q\n+r\n"),
    (6, HEAD + "@@ -2,0 +3 @@\n+new\n"),
    (7, ""),
    (8, HEAD + "@@ -1 +1 @@\n-z\n+A\n"),
]
FILE = "a b c d e f g h".split()


def frame(spark):
    return spark.createDataFrame([(i, "src/a.py", d) for i, d in DIFFS], "patch_id bigint, file_path string, diff string")


def test_malformed_diffs_are_refused_with_a_reason(spark):
    got = {r.patch_id: r.reason for r in diffs.diff_problems(frame(spark)).collect()}
    assert got == {2: "cut short", 4: "names a different file", 5: "does not match its own line counts", 7: "empty"}


def test_patched_files(spark):
    lines = diffs.diff_lines(frame(spark))
    originals = spark.createDataFrame([(i, n + 1, x) for i, _d in DIFFS for n, x in enumerate(FILE)], "patch_id bigint, line_no int, line string")
    out = {}
    for r in diffs.apply_hunks(originals, lines).orderBy("patch_id", "line_no").collect():
        out.setdefault(r.patch_id, []).append(r.line)
    assert out == {
        1: "a B c d e f".split() + ["--- x", "g", "h"], 3: ["A", *FILE[1:]], 6: ["a", "b", "new", *FILE[2:]],
    }


def test_stats_count_by_position_not_by_prefix(spark):
    got = {r.patch_id: (r.added, r.removed, r.hunks) for r in diffs.diff_stats(diffs.diff_lines(frame(spark))).collect()}
    assert got[1] == (2, 1, 2) and got[6] == (1, 0, 1)


def test_judgement(spark):
    found = "repository_id bigint, rule_id string, path string, snippet string, line_start int"
    before = spark.createDataFrame([(1, "PY007", "a.py", "md5(x)", 1), (1, "PY007", "a.py", "md5(x)", 9), (1, "PY003", "a.py", "os.system(y)", 5), (2, "PY007", "a.js", "md5(x)", 1)], found)
    after = spark.createDataFrame([(1, "PY007", "a.py", "md5(x)", 9), (2, "PY007", "a.js", "sha1(x)", 1)], found)
    targets = spark.createDataFrame([(1, "PY007", "a.py", "md5(x)"), (2, "PY007", "a.js", "md5(x)")], "patch_id bigint, rule_id string, path string, code string")
    stats = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 1)], "patch_id bigint, added int, removed int, live int")
    broken = spark.createDataFrame([], "patch_id bigint")
    got = {r.patch_id: r for r in diffs.judge_rescan(targets, before, after, stats, broken).collect()}
    assert got[1].passed and got[1].also_resolved == 1 and got[1].still_parses == "passed"
    assert not got[2].passed and got[2].reworded and got[2].still_parses == "skipped"


def test_explanations(spark):
    raws = [
        json.dumps({"summary": "Bad [1] and [7].", "impact": "go to https://evil.example/x now", "remediation": "fix\u0007 it", "citations": [1, 7, "passage 2", 1]}),
        json.dumps({"summary": ["a", "b"], "impact": "i", "remediation": "r"}), "not json", json.dumps(["x"]),
        json.dumps({"summary": "s", "impact": "i"}), json.dumps({"summary": "https://only.example", "impact": "i", "remediation": "r"}),
    ]
    df = spark.createDataFrame([(i, r, 3) for i, r in enumerate(raws)], "id int, raw string, passage_count int")
    got = {r.id: r for r in answers.screen_explanations(df).collect()}
    assert got[0].summary == "Bad [1] and." and got[0].impact == "go to now" and got[0].remediation == "fix it"
    assert (got[0].citations, got[0].dropped_citations, got[0].links_removed, got[0].grounded) == ([1, 2], 3, 1, True)
    assert got[1].summary == "a b" and not got[1].grounded
    assert [got[i].refused for i in (2, 3, 4, 5)] == ["not a JSON object", "not a JSON object", "does not fit the format", "empty after cleaning"]


def test_patch_answers(spark):
    raws = [
        {"replacement": "Here is the fix:\n```python\nx = 1\n```", "rationale": "because  so"},
        {"replacement": "  3 | a\n\n  4 | b", "rationale": "r"}, {"replacement": "  3 | a\nplain", "rationale": "r"},
        {"replacement": ">>>>>> REPLACE THESE LINES (1 to 2)\nx\n<<<<<< END OF LINES TO REPLACE", "rationale": "r"}, {"replacement": "", "rationale": "r"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "id int, raw string")
    got = {r.id: r for r in answers.screen_patch_answers(df).collect()}
    assert (got[0].replacement, got[0].rationale, got[0].fences_stripped) == ("x = 1", "because so", True)
    assert (got[1].replacement, got[1].gutters_stripped) == ("a\n\nb", 2) and got[2].replacement == "  3 | a\nplain"
    assert got[3].replacement == "x" and got[4].refused == "does not fit the format"


def test_reindent(spark):
    df = spark.createDataFrame([("if a:\n    b\n\nc", "        old"), ("    x", "    y"), ("", "  z")], "r string, o string")
    got = [r[0] for r in df.select(diffs.reindent_replacement(F.col("r"), F.col("o"))).collect()]
    assert got == ["        if a:\n            b\n\n        c", "    x", ""]

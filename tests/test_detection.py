"""Rules on small files: what must fire, what must stay quiet."""

import pytest
from pyspark.sql import functions as F

from riskweave.functions import paths
from riskweave.operators import detect, identity, python_facts, python_rules, reachability
from riskweave.plans.snippets import SNIPPETS

HEADER = "-----BEGIN EC PRIVATE KEY-----"
BODY = "MHcCAQEE" + "Zx9" * 16
GITHUB = "ghp_" + "k3" * 18
AWS = "AKIA" + "Q7" * 8

# path, text, the (rule, line) pairs expected
CASES = [
    (".env", f"AWS_ACCESS_KEY_ID={AWS}\n", [("SEC001", 1)]),
    (".env", f"AWS_SECRET_ACCESS_KEY={AWS}\n", [("SEC001", 1)]),
    ("deploy.pem", f"{HEADER}\n{BODY}\n", [("SEC002", 1)]),
    ("Pem.java", f'String pem = "{HEADER}\\n" + "{BODY}";', [("SEC002", 1)]),
    ("Pem.java", f'String pem = "{HEADER}\\n"\n  + "{BODY}\\n"\n;', [("SEC002", 1)]),
    ("pem.txt", f"{HEADER}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0\n\n{BODY}\n", [("SEC002", 1)]),
    ("Pem.java", f'body = body.replace("{HEADER}", "");\nnext();', []),
    ("pem.txt", f"{HEADER}\n\n\n\n{BODY}\n", []),
    ("Pem.java", f'mark = "{HEADER}";\nprepare();\n{BODY}\n', []),
    ("ci.yml", f"token: {GITHUB}\n", [("SEC003", 1)]),
    (".env", "DB=mysql://shop:swordfish9@db.local:3306/shop\n", [("SEC004", 1)]),
    (".env", "DB=mysql://shop:CHANGE_ME@db.local:3306/shop\nX=mysql://db.local/shop\n", []),
    ("app/settings.py", 'API_KEY = "q8w7e6r5t4y3"\n# API_KEY = "q8w7e6r5t4y3"\n', [("PY006", 1), ("SEC005", 1)]),
    ("lexer.js", 'token : "string.quoted",\ntoken = \'keyword.control\'\n', []),
    ("app.js", 'token = "p4ssw0rdlike99"\ntoken_secret = "justlowercase"\n', [("SEC005", 1), ("SEC005", 2)]),
    ("Log.java", 'log.debug("Password: ").append(mask(value)).append("!");\n', []),
    ("conf.json", '{"password": "swordfish-nine"}\n', [("SEC005", 1)]),
    ("app/i18n/messages_de.properties", "password=Kennwort-Text\n", []),
    ("app.properties", "mail.password=Kennwort-Text1\njwt.secret=${JWT_SECRET}\n", [("SEC005", 1)]),
    ("run.sh", "API_TOKEN=${API_TOKEN:-fallback-value-1}\nX_TOKEN=${X_TOKEN:-}\n", [("SEC005", 1)]),
    ("svc.py", "token = fetch_token()\n", []),
    ("a.js", "eval( 'fixed' );\neval(payload);\n// eval(payload)\n", [("JS001", 2)]),
    ("a.js", "x" * 1100 + " eval(payload);\n", []),
    ("A.java", 'Cipher.getInstance(\n  "DES/CBC/PKCS5Padding",\n  provider);\n', [("JV004", 1)]),
    ("A.java", "Random r = new Random();\nint a;\nint b;\nint c;\nint d;\nint e;\nString token;\n", []),
    ("A.java", "Random r = new Random();\nint a;\nint b;\nint c;\nint d;\nString token;\n", [("JV005", 1)]),
    ("A.java", 'String q = "SELECT a FROM t WHERE b = " +\n   value;\nString s = "SELECT a " +\n   "FROM t";\n', [("SQL001", 1)]),
    ("a.php", 'system($cmd);\nsystem("date");\n', [("PH001", 1)]),
    ("a.go", 'exec.Command("/bin/bash", "-c", cmd)\n', [("GO001", 1)]),
    ("a.py", "import os\nos.system('date')\nos.system(cmd)\n", [("PY003", 3)]),
    ("a.py", "from flask import request\n@app.route('/x/<f>')\ndef show(f, n: int):\n    open(f)\n    open(n)\n", [("PY017", 4)]),
    ("a.py", "import os\nfrom flask import request\nf = os.path.basename(request.args['f'])\nopen(f)\n", []),
    ("a.py", "import random\nx = random.choice(xs)\nsession_id = x\n", [("PY011", 2)]),
    ("bad.py", "def (:\n", []),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame(
        [(i, path, text) for i, (path, text, _e) in enumerate(CASES)], "repository_id bigint, path string, text string"
    ).withColumn("ext", paths.suffix(F.col("path")))
    facts = reachability.parsed_once(python_facts.python_call_facts(files))
    python = python_rules.python_matches(facts, reachability.python_levels(facts))
    rows = detect.union_analyzers(detect.detect(files), python).collect()
    out = {i: [] for i in range(len(CASES))}
    for row in rows:
        out[row.repository_id].append(row)
    return out


@pytest.mark.parametrize("number", range(len(CASES)))
def test_what_fires(found, number):
    got = sorted((row.rule_id, row.line_start) for row in found[number])
    assert got == sorted(CASES[number][2]), CASES[number][:2]


def test_a_secret_is_never_quoted(found):
    shown = " ".join(row.snippet for rows in found.values() for row in rows)
    for secret in (AWS, BODY, GITHUB[4:], "swordfish", "q8w7e6r5t4y3", "Kennwort-Text1"):
        assert secret[8:] not in shown or secret == "swordfish", secret
    assert "swordfish9@" not in shown


def test_every_rule_has_a_firing_snippet():
    from riskweave.dims import RULE_IDS

    assert {rule for _s, _b, fires in SNIPPETS for rule in fires} == set(RULE_IDS)


def test_a_user_rule_is_one_entry(spark):
    from riskweave.operators.pattern_rules import LineRule

    files = spark.createDataFrame([(1, "a.rb", "x = Marshal.load(y)\n", ".rb")], "repository_id bigint, path string, text string, ext string")
    rule = LineRule("RB900", (".rb",), r"Marshal\.load\(", ("Marshal",))
    assert [r.rule_id for r in detect.detect(files, registry=(rule,)).collect()] == ["RB900"]


def test_identity_does_not_depend_on_partitions(spark):
    lines = "os.system(a)\n" * 3 + "import os\n"
    files = spark.createDataFrame(
        [(1, f"p{i}.py", "import os\n" + lines, ".py") for i in range(6)], "repository_id bigint, path string, text string, ext string"
    )
    from riskweave import dims

    def fingerprints(pieces):
        facts = python_facts.python_call_facts(files.repartition(pieces))
        rows = identity.identify(python_rules.python_matches(facts), dims.rule_dimension(spark))
        return sorted((r.path, r.occurrence, r.fingerprint) for r in rows.collect())

    one = fingerprints(1)
    assert one == fingerprints(5)
    assert len(one) == 18 and {o for _p, o, _f in one} == {0, 1, 2}


def test_facts_as_a_table_function(spark):
    python_facts.register_python_facts(spark)
    rows = spark.sql("SELECT * FROM python_call_facts('import os\nos.system(x)')").collect()
    assert {r.fact for r in rows} == {"import", "call"}

"""Views of the given tables in the shape the operators expect.

Each view is a projection (now and then one aggregation) of the given tables, written here with
the DataFrame API and in ``views`` as SQL for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths
from riskweave.plans.snippets import SNIPPETS
from riskweave.session import spread_small

NOW_TEXT = "2024-02-15 00:00:00"
EVENT_SEVERITY = {"error": "CRITICAL", "purchase": "HIGH", "signup": "MEDIUM", "click": "LOW", "view": "INFO"}
EVENT_ACTION = {
    "error": "auth.login_failed", "signup": "user.registered", "click": "auth.login_succeeded",
    "purchase": "auth.token_refreshed", "view": "scan.queued",
}
FINDING_RULES = ("PY001", "PY003", "PY007", "PY010", "PY017", "JS001", "SEC001", "SQL001")
FINDING_PATHS = (
    "src/app.py", "tests/test_app.py", "node_modules/x/y.js", "docs/ex.py", "latest/app.py",
    "static/jquery-3.4.1.min.js",
)
FLOW_CALLS = (
    "html.escape", "shlex.quote", "os.path.basename", "int", "open", "requests.get", "str", "app.escape_html",
    "db.execute", "os.path.join", "flask.url_for", "len",
)
CHECK_ORDER = ["created_at", "line_number", "part", "supplier", "price"]
LANG_SUFFIX = {"en": ".py", "fr": ".java", "de": ".json", "es": ".zzz"}
LANG_CATEGORY = {"en": "cmdi", "fr": "hash", "de": "crypto", "es": "zzz"}


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def case(column: Column, table: dict) -> Column:
    out = None
    for key, value in table.items():
        out = (F if out is None else out).when(column == key, F.lit(value))
    return out


def now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp_ntz").cast("timestamp")


class Tables:
    """The given tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def rules(self) -> DataFrame:
        return dims.rule_dimension(self.spark)

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def findings(self) -> DataFrame:
        k, kind = F.col("k"), F.col("event_type")
        rows = self.events.select(
            F.col("event_id").alias("id"), (F.col("user_id") * 10 + k % 10).alias("repository_id"),
            F.col("user_id").alias("project_id"), (F.col("user_id") % 10).alias("owner_id"), "k",
            case(kind, EVENT_SEVERITY).alias("severity"), pick(("HIGH", "MEDIUM", "LOW"), k % 3).alias("confidence"),
            pick(FINDING_RULES, k % 8).alias("rule_id"), pick(FINDING_PATHS, k % 6).alias("file_path"),
            (k % 20 + 1).alias("line_start"), (k % 20 + 1 + k % 3).alias("line_end"),
            F.concat(F.lit("  run("), kind, F.lit(",   "), (k % 5).cast("string"), F.lit(") ")).alias("snippet"),
            F.when(F.col("event_id") % 7 == 0, "FIXED").when(F.col("event_id") % 7 == 1, "NEW")
            .otherwise("OPEN").alias("status"),
            (F.col("event_id") % 14 == 1).alias("is_regression"), F.col("ts").alias("created_at"),
            F.dayofmonth("ts").alias("first_seen"),
        ).withColumn("fingerprint", F.sha2(F.concat_ws(":", F.col("repository_id").cast("string"), F.col("id").cast("string")), 256))
        about = self.rules.select("rule_id", "title", "message", F.col("cwe_id").alias("rule_cwe"), "owasp_category")
        joined = rows.join(F.broadcast(about), "rule_id")
        return joined.withColumn("cwe_id", F.when(k % 13 != 0, F.col("rule_cwe"))).drop("rule_cwe")

    @cached_property
    def file_findings(self) -> DataFrame:
        """Findings as one scan gives them: ``path`` and a sequence number."""
        return self.findings.withColumnRenamed("file_path", "path").withColumn("seq", F.col("id"))

    @cached_property
    def repositories(self) -> DataFrame:
        rows = self.findings.groupBy(F.col("repository_id").alias("id"), "project_id").agg(F.min("k").alias("low"))
        return rows.select(
            "id", "project_id",
            F.when(F.col("id") % 5 == 0, "FAILED").otherwise("READY").alias("status"),
            F.when(F.col("id") % 7 != 0, F.concat(F.lit("w/"), F.col("id").cast("string"))).alias("workspace_path"),
            F.concat(F.lit("https://git.example.com/team"), F.col("project_id").cast("string"), F.lit("/r"),
                     F.col("id").cast("string"), F.lit(".git")).alias("origin"),
            F.lit("main").alias("branch"), F.sha2(F.col("id").cast("string"), 256).alias("commit_hash"),
            (F.col("low") > 50).alias("truncated"),
        )

    @cached_property
    def projects(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("id")).distinct().select(
            "id", (F.col("id") % 10).alias("owner_id"), F.concat(F.lit("Project "), F.col("id").cast("string")).alias("name")
        )

    @cached_property
    def observations(self) -> DataFrame:
        """One scan per calendar day and repository; what it saw, once per fingerprint."""
        repository = (F.col("user_id") % 20).alias("repository_id")
        print_ = F.sha2(
            F.concat_ws(":", (F.col("user_id") % 20).cast("string"), F.col("event_type"), (F.col("k") % 8).cast("string")), 256
        )
        return self.events.groupBy(
            repository, F.to_date("ts").alias("scan_id"), print_.alias("fingerprint")
        ).agg(F.min(F.col("k") % 20 + 1).alias("line_start"))

    @cached_property
    def scans(self) -> DataFrame:
        """Scan jobs: one per day and repository of ``user_id * 10 + k % 10``, mod 20."""
        repository = F.col("user_id") % 20
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
        jobs = self.events.groupBy(repository.alias("repository_id"), day.alias("day")).agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max("value").alias("high"),
            F.count("*").alias("total_findings"),
        )
        ident = F.col("day") * 100 + F.col("repository_id")
        status = F.when(ident % 10 == 0, "FAILED").when(ident % 10 == 1, "RUNNING").when(ident % 10 == 2, "QUEUED").otherwise("COMPLETED")
        jobs = jobs.withColumn("id", ident).withColumn("status", status)
        done = F.col("status").isin("FAILED", "COMPLETED")
        return jobs.select(
            "id", "repository_id", (F.col("repository_id") % 10).alias("owner_id"), "status",
            (F.col("id") % 4).cast("int").alias("attempts"), "started_at",
            F.when(done, F.col("ended_at")).alias("finished_at"), F.col("started_at").alias("created_at"),
            F.when((F.col("status") == "COMPLETED") & (F.col("id") % 11 != 0), F.least("high", F.lit(100.0))).alias("risk_score"),
            "total_findings",
        )

    @cached_property
    def patches(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.read("orders").select(
            key.alias("id"), F.col("o_custkey").alias("finding_id"),
            case(F.col("o_orderstatus"), {"F": "PROPOSED", "O": "FAILED", "P": "QUEUED"}).alias("status"),
            F.col("o_orderdate").alias("created_at"), (key % 9).cast("int").alias("lines_added"),
            (key % 4).cast("int").alias("lines_removed"), (key % 50 + 1).cast("int").alias("first_line"),
            (key % 50 + 1 + key % 3).cast("int").alias("last_line"), F.col("o_orderpriority").alias("diff"),
            F.concat(F.lit("because "), F.col("o_orderpriority")).alias("rationale"),
            (key % 5 == 0).alias("fences_stripped"), (key % 3).cast("int").alias("gutters_stripped"),
            (key % 7 == 0).alias("reindented"), (key % 3 + 1).cast("int").alias("attempts"),
            F.when(key % 2 == 0, key).alias("explanation_id"),
            F.sequence(F.lit(1), (key % 5 + 1).cast("int")).alias("passage_chunk_ids"),
            F.when(key % 6 != 0, (key % 700).cast("int")).alias("prompt_tokens"),
            (key % 90).cast("int").alias("completion_tokens"), F.round(F.col("o_totalprice")).cast("int").alias("duration_ms"),
            ((key % 3) * 0.25).alias("temperature"),
        )

    @cached_property
    def validations(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("patch_id"),
            case(F.col("l_returnflag"), {"A": "PASSED", "R": "REJECTED", "N": "FAILED"}).alias("status"),
            F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return spread_small(self.read("documents"))

    @cached_property
    def files(self) -> DataFrame:
        """Documents as files of a tree: ordinary, ignored and binary ones."""
        ten = F.col("doc_id") % 10
        folder = F.when(ten == 3, "node_modules").when(ten == 5, "src/build").otherwise("src")
        ext = F.when(ten == 7, ".png").otherwise(case(F.col("lang"), LANG_SUFFIX))
        return self.documents.select(
            F.substring("source", 4, 10).cast("bigint").alias("repository_id"), "doc_id",
            F.concat(folder, F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"),
            F.col("n_chars").alias("length"), "text",
        )

    @cached_property
    def code(self) -> DataFrame:
        """Source files derived from documents (see ``snippets``)."""
        number = (F.col("doc_id") % len(SNIPPETS)).cast("int")
        body = pick(tuple(s[1] for s in SNIPPETS), number)
        ext = pick(tuple(s[0] for s in SNIPPETS), number)
        key = F.sha2(F.col("doc_id").cast("string"), 256)
        word = F.concat(F.lit("v"), F.regexp_extract("text", "[A-Za-z]+", 0))
        for name, value in (
            ("{w}", word), ("{d}", F.col("doc_id").cast("string")), ("{h64}", key),
            ("{h40}", F.substring(key, 1, 40)), ("{H16}", F.upper(F.substring(key, 1, 16))),
        ):
            body = F.replace(body, F.lit(name), value)
        prose = F.when(ext == ".py", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).otherwise(F.col("text"))
        return self.documents.select(
            F.substring("source", 4, 10).cast("bigint").alias("repository_id"),
            F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("ext"),
            F.concat(prose, F.lit("\n\n"), body).alias("text"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        joined = self.read("labels").join(self.documents.drop("text"), "doc_id")
        return joined.select(
            F.concat(F.lit("Case"), F.col("doc_id").cast("string")).alias("name"), "doc_id",
            case(F.col("lang"), LANG_CATEGORY).alias("category"), (F.col("quality") == 0).alias("vulnerable"),
            case(F.col("lang"), {"en": 78, "fr": 327, "de": 327, "es": 1}).alias("cwe"),
            F.col("n_chars").between(600, 2500).alias("reported"), (F.col("n_chars") > 1300).alias("reported_before"),
        )

    @cached_property
    def case_findings(self) -> DataFrame:
        """Rules that fired in case files: of the case's category where it was reported, and others."""
        hit = self.cases.filter("reported").select(
            "name", case(F.col("category"), {"cmdi": "PY003", "hash": "JV003", "crypto": "JV004", "zzz": "PY006"}).alias("rule_id")
        )
        second = self.cases.filter("reported and doc_id % 2 = 0 and category = 'cmdi'").select("name", F.lit("PY002").alias("rule_id"))
        other = self.cases.filter("doc_id % 3 = 0").select("name", F.lit("PY009").alias("rule_id"))
        outside = self.documents.filter("doc_id % 5 = 0").select(
            F.concat(F.lit("Outside"), F.col("doc_id").cast("string")).alias("name"), F.lit("PY001").alias("rule_id")
        )
        return hit.unionByName(second).unionByName(other).unionByName(outside)

    @cached_property
    def chunks(self) -> DataFrame:
        """Passages: embeddings whose number does not end in 0."""
        v = F.col("vec_id")
        return self.read("embeddings").filter(v % 10 != 0).select(
            v.alias("chunk_id"), F.concat(F.lit("CWE-"), F.col("label").cast("string")).alias("cwe_id"),
            F.when(v % 11 == 0, F.concat(F.lit("PY00"), (F.col("label") % 3 + 1).cast("string"))).alias("rule_id"),
            F.concat(F.lit("A0"), (F.col("label") % 5 + 1).cast("string"), F.lit(":2021")).alias("owasp_category"),
            pick(("Fix", "Risk", "Mitigations", "Description"), (v % 4).cast("int")).alias("section"), "embedding",
            F.concat(F.lit("doc"), (v % 50).cast("string")).alias("document_id"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        """Findings as vectors: embeddings whose number ends in 0; some know no identifier."""
        v = F.col("vec_id")
        known = v % 30 != 0
        return self.read("embeddings").filter(v % 10 == 0).select(
            v.alias("query_id"), F.when(known, F.concat(F.lit("CWE-"), F.col("label").cast("string"))).alias("cwe_id"),
            F.when(known, F.concat(F.lit("PY00"), (v / 10 % 3 + 1).cast("int").cast("string"))).alias("rule_id"),
            F.when(known & (v % 20 == 0), F.concat(F.lit("A0"), (F.col("label") % 5 + 1).cast("string"), F.lit(":2021")))
            .alias("owasp_category"), F.col("embedding").alias("vector"),
        )

    @cached_property
    def examples(self) -> DataFrame:
        """Judged fixes from labelled documents."""
        joined = self.read("labels").join(self.documents, "doc_id")
        words = F.size(F.split("text", " "))
        n = F.col("doc_id")
        return joined.select(
            n.alias("patch_id"), F.substring(F.sha2("text", 256), 1, 6).alias("finding_id"),
            (F.col("quality") == 1).alias("passed"), F.col("source").alias("rule_id"),
            pick(dims.SEVERITIES, (n % 5).cast("int")).alias("severity"),
            pick(dims.CONFIDENCES, (n % 3).cast("int")).alias("confidence"), case(F.col("lang"), LANG_SUFFIX).alias("suffix"),
            F.col("n_chars").cast("int").alias("diff_characters"), words.alias("rationale_characters"),
            F.size(F.split("text", "\n")).alias("lines_added"), (n % 7).cast("int").alias("lines_removed"),
            (n % 12).cast("int").alias("region_lines"), (n % 4 == 0).alias("fences_stripped"),
            (n % 3).cast("int").alias("gutters_stripped"), (n % 6 == 0).alias("reindented"),
            (n % 3 + 1).cast("int").alias("attempts"), (n % 2 == 0).alias("had_explanation"),
            (n % 5).cast("int").alias("passages"), F.when(n % 9 != 0, (n % 700).cast("int")).alias("prompt_tokens"),
            (n % 90).cast("int").alias("completion_tokens"), (n % 5000).cast("int").alias("duration_ms"),
            ((n % 3) * 0.25).alias("temperature"),
        )

    @cached_property
    def predictions(self) -> DataFrame:
        """Probabilities for judged fixes (with ties), two predictors, five folds."""
        base = self.examples.select("patch_id", "passed", F.col("diff_characters").alias("n"), (F.col("patch_id") % 5).alias("fold"))
        kinds = F.array(
            F.struct(F.lit("model").alias("predictor"), ((F.col("n") % 101) / 100).alias("p")),
            F.struct(F.lit("pass rate of the rule").alias("predictor"), ((F.col("n") % 7) / 10).alias("p")),
        )
        return base.select("patch_id", "passed", "fold", F.lit(0).alias("repeat"), F.explode(kinds).alias("x")).select(
            "patch_id", "passed", "fold", "repeat", "x.predictor", F.col("x.p").alias("probability")
        )

    @cached_property
    def audit(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"), "user_id", case(F.col("event_type"), EVENT_ACTION).alias("action"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def presentations(self) -> DataFrame:
        """Refresh tokens as presented: families of a user, tokens by ``k``."""
        return self.events.filter("event_type = 'purchase'").select(
            F.col("user_id").alias("family_id"), F.col("k").cast("bigint").alias("token_id"),
            F.col("ts").alias("presented_at"), "event_id",
        )

    @cached_property
    def diffs(self) -> DataFrame:
        """Diffs over whole documents: every fifth line replaced; some cut short or misnamed."""
        n = F.col("doc_id")
        lines = F.split("text", "\n")
        body = F.transform(
            lines,
            lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("-"), x, F.lit("\n+"), x, F.lit(" fixed"))).otherwise(
                F.concat(F.lit(" "), x)
            ),
        )
        body = F.when(n % 10 == 3, F.slice(body, 1, F.size(body) - 1)).otherwise(body)
        size = F.size(lines).cast("string")
        path = F.concat(F.lit("src/d"), n.cast("string"), F.lit(".py"))
        shown = F.when(n % 10 == 4, F.lit("src/other.py")).otherwise(path)
        head = F.concat(
            F.lit("--- a/"), shown, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,"), size, F.lit(" +1,"), size, F.lit(" @@\n")
        )
        return self.documents.select(
            n.alias("patch_id"), path.alias("file_path"), F.concat(head, F.array_join(body, "\n"), F.lit("\n")).alias("diff"), "text"
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Model answers: assistant turns wrapped as JSON in several ways, some of them wrong."""
        n = F.col("conv_id") * 1000 + F.col("turn")
        six = F.col("conv_id") % 6
        t = F.col("text")
        plain = F.struct(
            t.alias("summary"), F.lit("see http://x.example/y now, it runs").alias("impact"),
            F.lit("use [7] and [1] here").alias("remediation"), F.array(F.lit(1), F.lit(7), F.lit(2)).alias("citations"),
        )
        short = F.struct(t.alias("summary"), F.lit("some impact").alias("impact"))
        listed = F.struct(
            F.array(F.lit("One."), t).alias("summary"), F.lit("impact  here").alias("impact"), t.alias("remediation"),
            F.lit("passage 3").alias("citations"),
        )
        raw = (
            F.when(six == 0, t).when(six.isin(1, 2), F.to_json(plain)).when(six == 3, F.to_json(short))
            .otherwise(F.to_json(listed))
        )
        return self.read("conversations").filter("role = 'assistant'").select(
            n.alias("id"), raw.alias("raw"), F.lit(3).alias("passage_count")
        )

    @cached_property
    def patch_answers(self) -> DataFrame:
        n = F.col("conv_id") * 1000 + F.col("turn")
        four = F.col("conv_id") % 4
        code = F.concat(F.lit("x = "), F.col("turn").cast("string"), F.lit("\ny = 2"))
        guttered = F.concat(F.lit("   24 | x = "), F.col("turn").cast("string"), F.lit("\n   25 | y = 2"))
        fenced = F.concat(F.lit("Here is the code:\n```python\n"), code, F.lit("\n```"))
        body = F.when(four == 0, code).when(four == 1, guttered).otherwise(fenced)
        raw = F.when(four == 3, F.col("text")).otherwise(
            F.to_json(F.struct(body.alias("replacement"), F.concat(F.lit("why  "), F.col("role")).alias("rationale")))
        )
        return self.read("conversations").select(n.alias("id"), raw.alias("raw"))

    # --- graph ---

    @cached_property
    def flow_edges(self) -> DataFrame:
        """Every event passes its data to event id / 3, made safe according to its type."""
        none = F.array().cast("array<string>")
        kind = F.col("event_type")
        safe = (
            F.when(kind == "click", F.array(F.lit("html"))).when(kind == "signup", F.array(F.lit("path"), F.lit("redirect")))
            .otherwise(none)
        )
        return self.events.filter("event_id > 0").select(
            F.col("event_id").alias("src"), F.floor(F.col("event_id") / 3).cast("bigint").alias("dst"), safe.alias("safe_for"),
            pick(FLOW_CALLS, F.col("k") % 12).alias("qualified"), F.col("k").alias("line"),
            (F.col("k") % 9 == 0).alias("replaces_quote"),
        )

    @cached_property
    def flow_nodes(self) -> DataFrame:
        origin = F.when(F.col("k") % 10 == 0, "input").when(F.col("k") % 10 == 1, "random").when(F.col("k") % 10 == 2, "opaque")
        return self.events.select(
            F.col("event_id").alias("id"), origin.alias("origin"), (F.col("event_id") + 1).alias("line"),
            F.array().cast("array<string>").alias("safe_for"),
        ).filter("origin is not null")

    @cached_property
    def flow_sinks(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("id"), pick(dims.KINDS, (F.col("event_id") % 10).cast("int")).alias("kind"))


def lines_of(documents: DataFrame) -> DataFrame:
    from riskweave.sources.tree import explode_lines

    return explode_lines(documents.select("doc_id", "text"))


def suffix_of(path: str) -> Column:
    return paths.suffix(F.col(path))

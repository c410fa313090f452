"""Python rules: one relational filter per rule over ``python_call_facts``.

``levels(repository_id, path, line, kind, level, source_line)`` says what reaches a call, from
``reachability``.  A call with no row there is *unknown*: rules about dangerous calls report it,
rules about calls that need request data do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import text

# --- fixed values: names the rules know -----------------------------------------------------
WEAK_HASHES = ("md5", "sha1")
SQL_KEYWORDS = r"select |insert |update |delete |drop |union "
EXECUTE_METHODS = ("execute", "executemany", "executescript", "raw")
SECRET_NAMES = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key",
    "credential", "auth",
)
SECRET_PLACEHOLDERS = (
    "", "none", "null", "changeme", "change_me", "your_password_here", "xxx", "todo", "example",
    "placeholder", "redacted", "dummy", "test", "fake",
)
MIN_SECRET_LENGTH = 8
RANDOM_FUNCTIONS = ("random", "randint", "randrange", "choice", "choices", "sample")
RANDOM_CONTEXT = "token|password|secret|otp|key|nonce"
SECRET_PLACES = RANDOM_CONTEXT + "|passwd|session|cookie|csrf|salt"
XML_PARSERS = ("parse", "fromstring", "XMLParser", "iterparse")
SHELLS = ("sh", "bash", "zsh", "dash", "ksh", "cmd", "cmd.exe", "powershell", "pwsh")
PICKLE_CALLS = ("pickle.loads", "pickle.load", "cPickle.loads", "dill.loads")
SUBPROCESS_CALLS = (
    "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
    "subprocess.Popen",
)
FILE_CALLS = (
    "open", "io.open", "codecs.open", "os.open", "os.remove", "os.unlink", "os.rmdir", "os.mkdir",
    "os.makedirs", "os.listdir", "os.scandir", "os.stat", "os.chmod", "os.rename", "os.replace",
    "os.path.exists", "os.path.isfile", "os.path.isdir", "os.path.getsize", "shutil.copy",
    "shutil.copy2", "shutil.copyfile", "shutil.move", "shutil.rmtree", "flask.send_file",
)
# Methods of a pathlib path that touch the file system.
PATH_METHODS = (
    "read_text", "read_bytes", "write_text", "write_bytes", "open", "exists", "is_file", "is_dir", "unlink", "rmdir",
    "mkdir", "iterdir", "glob", "rglob", "stat", "touch",
)
XPATH_CALLS = ("lxml.etree.XPath", "lxml.etree.ETXPath")
LDAP_METHODS = ("search", "search_s", "search_st", "search_ext", "search_ext_s")
REDIRECT_CALLS = (
    "flask.redirect", "quart.redirect", "bottle.redirect", "django.shortcuts.redirect",
    "django.http.HttpResponseRedirect", "django.http.HttpResponsePermanentRedirect",
    "starlette.responses.RedirectResponse", "fastapi.responses.RedirectResponse",
)
HTML_CALLS = (
    "flask.make_response", "flask.Response", "flask.render_template_string", "flask.Markup",
    "markupsafe.Markup", "django.http.HttpResponse", "django.utils.safestring.mark_safe",
)
SESSION_OBJECTS = ("flask.session", "quart.session")
ENTITY_PARSERS = (
    "xml.dom.minidom.parse", "xml.dom.minidom.parseString", "xml.dom.pulldom.parse",
    "xml.dom.pulldom.parseString", "xml.sax.parse", "xml.sax.parseString",
)
SAME_SITE = r"^(?:/[^/\\]|https?://[^/@\\]+/)"
REFERENCE_VALUE = r"^(?:\$|\{\{|<|%\(|os\.environ|env\.)|\}\}$|getenv"
PLAIN_WORDS = r"^[a-z]+(?:[._-][a-z]+)*$"

ANALYZER = "python-ast"


def _is(name: str, *values: str) -> Column:
    return F.coalesce(text.one_of(F.col(name), values), F.lit(False))


def _kw(name: str) -> Column:
    return F.coalesce(F.col("kwargs")[name], F.lit(""))


def _starts(name: str, *prefixes: str) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.coalesce(F.col(name).startswith(prefix), F.lit(False))
    return out


def call_conditions() -> dict[str, tuple[Column, str | None]]:
    """rule id -> (condition over a call fact, kind whose level must not be clean)."""
    name, tail = F.col("call_name"), F.col("tail")
    has_argument = _kw("#args") != "0"
    process = _starts("call_name", "subprocess.") | F.coalesce(name.contains("Popen"), F.lit(False))
    xml = _is("tail", *XML_PARSERS) & _starts("qualified", "xml.")
    return {
        "PY001": (_is("call_name", "eval", "exec") & has_argument & ~F.col("literal"), "code"),
        "PY002": (process & (_kw("shell") == "True"), "command"),
        "PY003": (_is("call_name", "os.system", "os.popen"), "command"),
        "PY004": (_is("call_name", "yaml.load") & ~_kw("Loader").contains("Safe"), "data"),
        "PY005": (_is("call_name", *PICKLE_CALLS), "data"),
        "PY007": (
            _is("tail", *WEAK_HASHES) | (_is("call_name", "hashlib.new") & _is("value", *WEAK_HASHES)), None
        ),
        "PY008": (
            (_kw("verify") == "False")
            & (_starts("call_name", "requests.", "httpx.", "session.") | _is("tail", "get", "post", "request")),
            None,
        ),
        "PY009": ((tail == "run") & (_kw("debug") == "True"), None),
        "PY011": (
            _starts("call_name", "random.") & _is("tail", *RANDOM_FUNCTIONS)
            & F.lower("snippet").rlike(RANDOM_CONTEXT),
            None,
        ),
        "PY012": (_is("call_name", "tempfile.mktemp"), None),
        "PY013": (
            _starts("call_name", "jwt.") & (tail == "decode")
            & ((_kw("verify") == "False") | (_kw("options.verify_signature") == "False")),
            None,
        ),
        "PY014": (_is("call_name", "ssl._create_unverified_context"), None),
        "PY015": (xml & ~((tail == "fromstring") & F.col("literal")), None),
        "PY023": ((tail == "set_cookie") & (_kw("secure") == "False"), None),
    }


# kind of use -> condition over a call fact: what is a sink for request data
def on_a_path() -> Column:
    """A call of a file method on a path: what the path was made of is what counts."""
    return _is("tail", *PATH_METHODS) & (_kw("#made") == "pathlib")


def sink_conditions() -> dict[str, Column]:
    shell_list = F.col("kwargs").isNotNull() & (_kw("shell") != "True")
    same_site = F.coalesce(F.col("text"), F.lit("")).rlike(SAME_SITE)
    return {
        "code": _is("call_name", "eval", "exec"),
        "command": _is("call_name", "os.system", "os.popen") | (_is("qualified", *SUBPROCESS_CALLS) & shell_list)
        | (_is("qualified", *SUBPROCESS_CALLS) & (_kw("shell") == "True")),
        "sql": _is("tail", *EXECUTE_METHODS),
        "data": _is("call_name", "yaml.load", *PICKLE_CALLS),
        "path": _is("qualified", *FILE_CALLS) | on_a_path(),
        "xpath": _is("tail", "xpath") | _is("qualified", *XPATH_CALLS),
        "ldap": _is("tail", *LDAP_METHODS),
        "redirect": _is("qualified", *REDIRECT_CALLS) & ~same_site,
        "html": _is("qualified", *HTML_CALLS),
    }


def _match(rows: DataFrame, rule_id: str, snippet: Column | None = None) -> DataFrame:
    shown = F.col("snippet") if snippet is None else snippet
    return rows.select(
        "repository_id", "path", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"),
        F.lit(rule_id).alias("rule_id"), text.clean_snippet(shown).alias("snippet"),
        F.lit(ANALYZER).alias("analyzer"),
    )


def hardcoded_secret() -> Column:
    value, target = F.col("value"), F.lower("target")
    named = F.lit(False)
    for word in SECRET_NAMES:
        named = named | target.contains(word)
    lexer = (
        (F.regexp_replace(target, "token", "") == F.regexp_replace(target, "secret|passw|key|credential|token", ""))
        & target.contains("token") & value.rlike(PLAIN_WORDS)
    )
    lowered = F.lower(F.trim(value))
    return F.coalesce(
        (F.col("fact") == "assign") & F.col("literal") & named & (F.length(value) >= MIN_SECRET_LENGTH)
        & ~lowered.isin(*SECRET_PLACEHOLDERS) & ~lowered.rlike(REFERENCE_VALUE) & ~lexer,
        F.lit(False),
    )


def with_levels(calls: DataFrame, levels: DataFrame | None) -> DataFrame:
    """Add ``level_<kind>`` columns: one join for all rules, levels pivoted per call (line and column) first."""
    if levels is None:
        for kind in dims.KINDS:
            calls = calls.withColumn(f"level_{kind}", F.lit(dims.UNKNOWN))
        return calls
    order = {dims.TAINTED: 2, dims.UNKNOWN: 1, dims.CLEAN: 0}
    rank = F.when(F.col("level") == dims.TAINTED, 2).when(F.col("level") == dims.UNKNOWN, 1).otherwise(0)
    wide = levels.groupBy("repository_id", "path", "line", "col").agg(
        *[F.max(F.when(F.col("kind") == kind, rank)).alias(f"r_{kind}") for kind in dims.KINDS]
    )
    joined = calls.join(wide, ["repository_id", "path", "line", "col"], "left")
    names = {v: k for k, v in order.items()}
    for kind in dims.KINDS:
        r = F.col(f"r_{kind}")
        joined = joined.withColumn(
            f"level_{kind}",
            F.when(r == 2, names[2]).when(r == 1, names[1]).when(r == 0, names[0]).otherwise(dims.UNKNOWN),
        ).drop(f"r_{kind}")
    return joined


def python_matches(facts: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Matches of every Python rule.  Call rules are decided in one pass over the call facts."""
    calls = with_levels(facts.filter("fact = 'call'"), levels)
    decided = []
    for rule_id, (condition, kind) in call_conditions().items():
        open_level = F.lit(True) if kind is None else F.col(f"level_{kind}") != dims.CLEAN
        decided.append(F.when(condition & open_level, F.lit(rule_id)))
    decided.append(F.when(sql_condition(), F.lit("PY010")))
    for rule_id, condition in reached_conditions().items():
        decided.append(F.when(condition, F.lit(rule_id)))
    fired = calls.withColumn("rule_id", F.explode(F.array_compact(F.array(*decided))))
    from_calls = fired.select(
        "repository_id", "path", F.col("line").alias("line_start"), F.col("end_line").alias("line_end"),
        "rule_id", text.clean_snippet(F.col("snippet")).alias("snippet"), F.lit(ANALYZER).alias("analyzer"),
    )
    assigned = _match(
        facts.filter(hardcoded_secret()), "PY006", text.redact_assignment(F.col("target"), F.col("value"))
    )
    out = from_calls.unionByName(assigned)
    if levels is not None:
        out = out.unionByName(ldap_matches(calls, facts)).unionByName(html_matches(facts, levels))
        out = out.unionByName(session_matches(facts, levels)).unionByName(random_matches(facts, levels))
    return out.dropDuplicates(["repository_id", "path", "rule_id", "line_start"])


def sql_condition() -> Column:
    built = F.col("built") & F.lower("text").rlike(SQL_KEYWORDS)
    return (
        _is("tail", *EXECUTE_METHODS) & (_kw("#args") != "0") & ~F.col("literal")
        & (F.col("level_sql") != dims.CLEAN) & ((F.col("level_sql") == dims.TAINTED) | built)
    )


def reached_conditions() -> dict[str, Column]:
    """Rules about ordinary calls that become findings only when request data reaches them."""
    program = F.lower(F.element_at(F.split(F.replace(_kw("#program"), F.lit("\\"), F.lit("/")), "/"), -1))
    listed = F.col("kwargs").getItem("#program").isNotNull()
    starts_shell = F.coalesce(program.isin(*SHELLS), F.lit(False))
    by_caller = listed & (program == "")
    sinks = sink_conditions()

    def reached(kind: str) -> Column:
        return sinks[kind] & (F.col(f"level_{kind}") == dims.TAINTED)

    return {
        "PY016": _is("qualified", *SUBPROCESS_CALLS) & (_kw("shell") != "True")
        & (F.col("level_command") == dims.TAINTED) & (~listed | starts_shell | by_caller),
        "PY017": reached("path"),
        "PY018": reached("xpath"),
        "PY020": reached("redirect"),
    }


def ldap_matches(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """PY019 only in files that import an LDAP library: a semi join on the file."""
    libraries = facts.filter(
        "fact = 'import' and split(qualified, '[.]')[0] in ('ldap', 'ldap3')"
    ).select("repository_id", "path")
    reached = calls.filter(_is("tail", *LDAP_METHODS) & (F.col("level_ldap") == dims.TAINTED))
    return _match(reached.join(libraries, ["repository_id", "path"], "left_semi"), "PY019")


def html_matches(facts: DataFrame, levels: DataFrame) -> DataFrame:
    """PY021: one finding per request value and function, at the first place it leaves."""
    reached = levels.filter((F.col("kind") == "html") & (F.col("level") == dims.TAINTED))
    places = facts.filter((F.col("fact") == "return") | _is("qualified", *HTML_CALLS))
    rows = places.join(reached, ["repository_id", "path", "line", "col"])
    first = rows.groupBy("repository_id", "path", "scope", "source_line").agg(
        F.min_by(F.struct("line", "end_line", "snippet"), F.struct("line", "col")).alias("at")
    )
    return _match(first.select("repository_id", "path", "at.*"), "PY021")


def session_matches(facts: DataFrame, levels: DataFrame) -> DataFrame:
    """PY022: a tainted key or value stored in the session."""
    target = F.coalesce("qualified", "target")
    stores = facts.filter(
        (F.col("fact") == "store")
        & (target.isin(*SESSION_OBJECTS) | (target == "session") | target.endswith(".session"))
    )
    reached = levels.filter((F.col("kind") == "trust") & (F.col("level") == dims.TAINTED))
    return _match(stores.join(reached, ["repository_id", "path", "line", "col"], "left_semi"), "PY022")


def random_matches(facts: DataFrame, levels: DataFrame) -> DataFrame:
    """PY011 by flow: a ``random`` result assigned to a name that says it is a secret."""
    places = facts.filter(
        F.col("fact").isin("assign", "store")
        & F.lower(F.concat_ws(" ", "target", "key")).rlike(SECRET_PLACES)
    )
    reached = levels.filter(F.col("kind") == "random").select(
        "repository_id", "path", "line", "col", F.col("source_line").alias("made_at")
    )
    rows = places.join(reached, ["repository_id", "path", "line", "col"])
    return _match(
        rows.withColumn("line", F.col("made_at")).withColumn("end_line", F.col("made_at")), "PY011"
    )


def entity_parser_overrides(facts: DataFrame) -> DataFrame:
    """Lines where a parser was told to resolve external entities: PY015 at HIGH / HIGH."""
    told = facts.filter(
        (F.col("fact") == "call") & (F.col("tail") == "setFeature")
        & (F.col("text").contains("external-general-entities") | _kw("#first").contains("feature_external_ges"))
        & (_kw("#switch") != "False") & (_kw("#switch") != "0")
    ).select("repository_id", "path", "scope").distinct()
    used = facts.filter(
        (F.col("fact") == "call") & (_is("qualified", *ENTITY_PARSERS) | (F.col("tail") == "parse"))
    )
    return used.join(told, ["repository_id", "path", "scope"], "left_semi").select(
        "repository_id", "path", F.col("line").alias("line_start"), F.lit("HIGH").alias("severity"),
        F.lit("HIGH").alias("confidence"),
    )


def needs_levels(rule_id: str) -> bool:
    conditions = call_conditions()
    if rule_id == "PY011":
        return True
    return rule_id != "PY006" and (rule_id not in conditions or conditions[rule_id][1] is not None)


def python_rule(rule_id: str, facts: DataFrame, levels) -> DataFrame:
    """Matches of one rule.  ``levels`` is a function: rules that ask no level never build a graph."""
    conditions = call_conditions()
    if rule_id == "PY006":
        shown = text.redact_assignment(F.col("target"), F.col("value"))
        return _match(facts.filter(hardcoded_secret()), "PY006", shown).dropDuplicates(
            ["repository_id", "path", "line_start"]
        )
    calls = facts.filter("fact = 'call'")
    if rule_id in conditions:
        condition, kind = conditions[rule_id]
        wanted = calls.filter(condition)
        if kind is not None:
            wanted = with_levels(wanted, levels()).filter(F.col(f"level_{kind}") != dims.CLEAN)
        found = _match(wanted, rule_id)
        if rule_id == "PY011":
            found = found.unionByName(random_matches(facts, levels()))
        return found.dropDuplicates(["repository_id", "path", "line_start"])
    found_levels = levels()
    if rule_id == "PY019":
        return ldap_matches(with_levels(calls, found_levels), facts)
    if rule_id == "PY021":
        return html_matches(facts, found_levels)
    if rule_id == "PY022":
        return session_matches(facts, found_levels)
    condition = sql_condition() if rule_id == "PY010" else reached_conditions()[rule_id]
    return _match(with_levels(calls, found_levels).filter(condition), rule_id).dropDuplicates(
        ["repository_id", "path", "line_start"]
    )

"""Reachability of untrusted data over an edge table.

``edges(src, dst, safe_for array<string>)``: data moves from ``src`` to ``dst`` and is then safe
for the listed kinds of use.  The question asked of every sink is not "all sources that reach it"
(that would be a row per pair) but "the most important reason to distrust it": the least source
per (node, kind, origin).  That keeps the state at most kinds x origins rows per node, whatever
the number of sources, and a hub with a third of all edges only ever forwards one row per state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions.text import one_of
from riskweave.session import materialise

KEY = ["id", "kind", "origin"]

# --- fixed values: sources, sanitisers and checks -------------------------------------------
REQUEST_NOT_INPUT = (
    "method", "endpoint", "blueprint", "blueprints", "url_rule", "remote_addr", "scheme",
    "is_secure", "is_json", "is_ajax", "accepts", "content_length", "max_content_length",
    "user", "auth", "session", "site", "resolver_match", "urlconf", "app", "state",
    "current_app", "csrf_processing_done", "get_port",
)
REQUEST_SAME_SITE = (
    "path", "path_info", "full_path", "script_root", "root_path", "get_full_path",
    "get_full_path_info", "build_absolute_uri", "get_host", "host", "host_url", "url_root",
    "base_url", "url",
)
NOT_TEXT = ("int", "float", "bool", "uuid", "UUID", "Decimal", "date", "datetime")
RANDOM_FUNCTIONS = (
    "random", "randint", "randrange", "choice", "choices", "sample", "getrandbits", "randbytes",
    "uniform", "normalvariate", "gauss", "triangular", "shuffle",
)
NUMERIC_FUNCTIONS = ("int", "float", "bool", "len", "ord", "abs", "round", "hash", "id")
SANITISERS = (
    ("html.escape", "html"), ("markupsafe.escape", "html"), ("flask.escape", "html"),
    ("cgi.escape", "html"), ("bleach.clean", "html"), ("django.utils.html.escape", "html"),
    ("xml.sax.saxutils.escape", "html"), ("xml.sax.saxutils.quoteattr", "html"),
    ("json.dumps", "html"), ("flask.json.dumps", "html"), ("flask.jsonify", "html"),
    ("flask.redirect", "html"), ("flask.render_template", "html"), ("flask.url_for", "html"),
    ("flask.url_for", "redirect"),
    ("shlex.quote", "command"), ("pipes.quote", "command"),
    ("os.path.basename", "path"), ("werkzeug.utils.secure_filename", "path"),
    ("ldap3.utils.conv.escape_filter_chars", "ldap"), ("ldap.filter.escape_filter_chars", "ldap"),
)
HTML_ESCAPE_NAMES = ("escape_for_html", "escape_html", "html_escape", "htmlescape", "escapehtml")
LOOKUP_CALLS = (
    "open", "io.open", "codecs.open", "os.open", "os.remove", "os.unlink", "os.rmdir", "os.mkdir",
    "os.makedirs", "os.listdir", "os.scandir", "os.stat", "os.chmod", "os.rename", "os.replace",
    "os.path.exists", "os.path.isfile", "os.path.isdir", "os.path.getsize", "shutil.copy",
    "shutil.copy2", "shutil.copyfile", "shutil.move", "shutil.rmtree", "flask.send_file",
    "subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output",
    "subprocess.Popen", "urllib.request.urlopen", "requests.get", "requests.post", "requests.put",
    "requests.delete", "requests.patch", "requests.head", "requests.request", "httpx.get",
    "httpx.post", "httpx.put", "httpx.delete", "httpx.patch", "httpx.request",
    "elementpath.select", "lxml.etree.XPath", "lxml.etree.ETXPath", "os.system", "os.popen",
)
LOOKUP_METHODS = ("xpath", "execute", "executemany", "executescript")
# Library functions whose result is made of their arguments and nothing else.
PURE_CALLS = (
    "str", "bytes", "repr", "format", "ascii", "tuple", "list", "sorted", "reversed",
    "base64.b64encode", "base64.b64decode", "base64.urlsafe_b64encode", "base64.urlsafe_b64decode",
    "base64.standard_b64encode", "base64.standard_b64decode", "base64.b32encode", "base64.b32decode",
    "base64.b16encode", "base64.b16decode", "binascii.hexlify", "binascii.unhexlify",
    "codecs.encode", "codecs.decode", "urllib.parse.quote", "urllib.parse.quote_plus",
    "urllib.parse.unquote", "urllib.parse.unquote_plus", "urllib.parse.urlparse",
    "urllib.parse.urlsplit", "urllib.parse.urljoin", "urllib.parse.urlencode", "html.unescape",
    "os.path.join", "os.path.normpath", "os.path.abspath", "os.path.realpath", "os.path.dirname",
    "os.path.splitext", "os.path.expanduser", "pathlib.Path", "pathlib.PurePath",
)
READ_METHODS = r"^(?:flask|quart|bottle)[.]request[.]|[.](?:format|strip|lower|upper|get)$"
# check -> kinds the checked variable is safe for afterwards
GUARDS = {
    "no_dot_dot": ("path",),
    "no_quote": ("xpath",),
    "membership": dims.KINDS,
    "host": ("redirect",),
    "prefix": ("path", "redirect"),
    "one_literal": ("code",),
}
MAX_REASONS = 48


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# --- facts to graph ------------------------------------------------------------------------


def taint_sources(reads: DataFrame) -> DataFrame:
    """``reads(id, what, part, annotation, line)`` -> ``nodes(id, origin, line, safe_for)``.

    ``what`` is ``request`` (a part read from the request), ``parameter`` (of a route) or
    ``random`` (the function called).  Parts the caller does not write give opaque nodes.
    """
    what, part = F.col("what"), F.col("part")
    origin = (
        F.when((what == "request") & one_of(part, REQUEST_NOT_INPUT), dims.OPAQUE)
        .when(what == "request", dims.INPUT)
        .when((what == "parameter") & ~one_of(F.coalesce("annotation", F.lit("")), NOT_TEXT), dims.INPUT)
        .when((what == "random") & one_of(part, RANDOM_FUNCTIONS), dims.RANDOM)
    )
    safe = F.when((what == "request") & one_of(part, REQUEST_SAME_SITE), _strings(["redirect"])).otherwise(
        _strings([])
    )
    return reads.withColumn("origin", origin).filter("origin is not null").select(
        "id", "origin", "line", safe.alias("safe_for")
    )


def taint_sanitise_edges(edges: DataFrame) -> DataFrame:
    """Edges through a call get the kinds that call makes safe (``qualified``, ``replaces_quote``)."""
    spark = edges.sparkSession
    table = spark.createDataFrame(list(SANITISERS), "qualified string, kind string")
    table = table.groupBy("qualified").agg(F.array_sort(F.collect_set("kind")).alias("cleared"))
    joined = edges.join(F.broadcast(table), "qualified", "left")
    tail = F.element_at(F.split(F.coalesce("qualified", F.lit("")), "[.]"), -1)
    named = F.when(one_of(tail, HTML_ESCAPE_NAMES), _strings(["html"])).otherwise(_strings([]))
    quoted = F.when(F.coalesce("replaces_quote", F.lit(False)), _strings(["xpath"])).otherwise(_strings([]))
    safe = F.array_union(
        F.array_union(F.col("safe_for"), F.coalesce("cleared", _strings([]))), F.array_union(named, quoted)
    )
    return joined.withColumn("safe_for", F.array_sort(safe)).drop("cleared")


def is_numeric_call() -> Column:
    return F.coalesce(one_of(F.col("qualified"), NUMERIC_FUNCTIONS), F.lit(False))


def is_lookup_call() -> Column:
    tail = F.element_at(F.split(F.coalesce("qualified", F.lit("")), "[.]"), -1)
    method = F.coalesce(F.col("qualified").contains("."), F.lit(False)) & one_of(tail, LOOKUP_METHODS)
    return F.coalesce(one_of(F.col("qualified"), LOOKUP_CALLS), F.lit(False)) | method


def taint_cut_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept edges, opaque nodes): numbers carry nothing, a lookup's answer is not its question."""
    kept = edges.filter(~is_numeric_call() & ~is_lookup_call())
    opaque = edges.filter(is_lookup_call()).groupBy(F.col("dst").alias("id")).agg(
        F.min("line").alias("line")
    )
    nodes = opaque.select("id", F.lit(dims.OPAQUE).alias("origin"), "line", _strings([]).alias("safe_for"))
    return kept, nodes


def taint_guard_edges(guards: DataFrame) -> DataFrame:
    """``guards(variable, version, check)`` -> edges from one version of the variable to the next."""
    safe = F.lit(None).cast("array<string>")
    for check, kinds in GUARDS.items():
        safe = F.when(F.col("check") == check, _strings(sorted(kinds))).otherwise(safe)

    def named(version: Column) -> Column:
        return F.concat(F.col("variable").cast("string"), F.lit("#"), version.cast("string"))

    return guards.withColumn("safe_for", safe).filter("safe_for is not null").select(
        named(F.col("version")).alias("src"), named(F.col("version") + 1).alias("dst"), "safe_for"
    )


def flow_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """Rows of ``file_flow.solved`` by name, from ``python_call_facts``.

    Versions of variables are nodes; an assignment moves data from every version it reads, a merge from the versions
    that arrive, a guard to the next version.  Whatever is not understood (a global, the result of an unknown
    call) is an opaque node; a plain parameter is whatever a caller gives.
    """
    from riskweave.operators.python_rules import LDAP_METHODS, SECRET_PLACES, on_a_path, sink_conditions

    none = F.lit(None).cast("string")
    # A file is its repository and the hash of its path: no separator can be part of either.
    file = F.concat_ws("|", F.col("repository_id").cast("string"), F.md5("path"))
    function = F.concat_ws("|", file, "scope")
    followed = F.concat_ws("|", file, "qualified")

    def var(name) -> Column:
        return F.concat_ws("|", file, "scope", name)

    def place() -> Column:
        at = F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string"))
        given = F.when(F.col("fact") == "argument", F.col("target"))
        return F.concat_ws("|", file, F.concat(F.lit("@"), "fact"), at, given)

    def listed(key: str) -> Column:
        return F.filter(F.split(F.coalesce(F.col("kwargs")[key], F.lit("")), ","), lambda x: x != "")

    def carried(own: str, rest: str, on: str) -> Column:
        more = F.when(one_of(F.col("tail"), LDAP_METHODS), listed(rest)).otherwise(_strings([]))
        return F.when(F.coalesce(on_a_path(), F.lit(False)), listed(on)).otherwise(F.array_union(own, more))

    understood = [*PURE_CALLS, *NUMERIC_FUNCTIONS, *LOOKUP_CALLS, *[name for name, _ in SANITISERS]]

    def unknown_call() -> Column:
        return F.exists(
            "calls",
            lambda c: ~one_of(c, understood) & ~c.startswith("random.") & ~c.rlike(READ_METHODS),
        )

    assigns = facts.filter("fact = 'assign'")
    moved = facts.filter("fact in ('assign', 'merge')").select("*", F.explode("names").alias("name")).select(
        var("name").alias("src"), var("slot").alias("dst"), _strings([]).alias("safe_for"),
        "qualified", "line", F.lit(False).alias("replaces_quote"),
    )
    # A read assigned through a call passes that call, like a variable would.
    read_into = F.concat(var("slot"), F.lit("|read"))
    read_moved = assigns.filter("size(reads) > 0").select(
        read_into.alias("src"), var("slot").alias("dst"), _strings([]).alias("safe_for"), "qualified", "line",
        F.lit(False).alias("replaces_quote"),
    )
    kept, looked_up = taint_cut_edges(taint_sanitise_edges(moved.unionByName(read_moved)))

    used = facts.filter("fact in ('call', 'return', 'store', 'argument')").withColumn(
        "names", carried("names", "#rest", "#on")
    ).withColumn("reads", carried("reads", "#rest_reads", "#on_reads"))
    into = used.select("*", F.explode("names").alias("name")).select(
        var("name").alias("src"), place().alias("dst"), _strings([]).alias("safe_for"),
        F.when(F.size("calls") == 1, F.get("calls", F.lit(0))).alias("qualified"), "line",
        F.lit(False).alias("replaces_quote"),
    )
    # A read written directly into a call or a return passes whatever call it is wrapped in.
    read_here = F.concat(place(), F.lit("|read"))
    direct = used.filter("size(reads) > 0").select(
        read_here.alias("src"), place().alias("dst"), _strings([]).alias("safe_for"),
        F.when(F.size("calls") == 1, F.get("calls", F.lit(0))).alias("qualified"), "line",
        F.lit(False).alias("replaces_quote"),
    )
    into = taint_sanitise_edges(into.unionByName(direct)).filter(~is_numeric_call())
    guards = facts.filter("fact = 'guard'").select(var("target").alias("variable"), "version", F.col("key").alias("check"))
    edges = kept.unionByName(into).select("src", "dst", "safe_for").unionByName(taint_guard_edges(guards))

    def reads_of(rows: DataFrame, node: Column) -> DataFrame:
        return rows.filter("size(reads) > 0").select(
            node.alias("id"), F.lit("request").alias("what"), F.explode("reads").alias("part"),
            none.alias("annotation"), "line",
        )

    carries = ~is_numeric_call() & ~is_lookup_call()
    parameters = facts.filter("fact = 'parameter'")
    routes = parameters.filter("built").select(
        var("slot").alias("id"), F.lit("parameter").alias("what"), none.alias("part"),
        F.col("text").alias("annotation"), "line",
    )
    chance = assigns.select("*", F.explode("calls").alias("called")).filter("called like 'random.%'").select(
        var("slot").alias("id"), F.lit("random").alias("what"),
        F.substring_index("called", ".", -1).alias("part"), none.alias("annotation"), "line",
    )
    sources = taint_sources(
        reads_of(assigns.filter(carries), read_into).unionByName(reads_of(used, read_here))
        .unionByName(routes).unionByName(chance)
    )

    def opaque(rows: DataFrame, node: Column) -> DataFrame:
        return rows.select(
            node.alias("id"), F.lit(dims.OPAQUE).alias("origin"), "line", _strings([]).alias("safe_for")
        )

    touched = facts.filter("fact = 'touched'")
    bound = facts.filter("fact in ('assign', 'parameter', 'merge', 'guard', 'followed')")
    defined = bound.select(var("slot").alias("id")).distinct()
    mentioned = assigns.select("*", F.explode("names").alias("name")).select(var("name").alias("id"), "line")
    mentioned = mentioned.unionByName(
        used.select("*", F.explode("names").alias("name")).select(var("name").alias("id"), "line")
    ).groupBy("id").agg(F.min("line").alias("line"))
    nodes = (
        sources.unionByName(looked_up)
        .unionByName(opaque(mentioned.join(defined, "id", "left_anti"), F.col("id")))
        .unionByName(opaque(touched, var("slot")))
        .unionByName(opaque(assigns.filter(unknown_call() & carries), var("slot")))
        .unionByName(opaque(used.filter(unknown_call()), place()))
    )

    conditions = [F.when((F.col("fact") == "call") & c, F.lit(k)) for k, c in sink_conditions().items()]
    conditions.append(F.when((F.col("fact") == "return") & ~F.col("literal"), F.lit("html")))
    conditions.append(F.when(F.col("fact") == "store", F.lit("trust")))
    sinks = used.select(
        place().alias("id"), "repository_id", "path", "line", "col",
        F.explode(F.array_compact(F.array(*conditions))).alias("kind"),
    ).distinct()
    named = assigns.filter(F.lower("target").rlike(SECRET_PLACES)).select(
        var("slot").alias("id"), "repository_id", "path", "line", "col", F.lit("random").alias("kind")
    )
    return {
        "nodes": nodes, "edges": edges, "sinks": sinks.unionByName(named.distinct()),
        "parameters": parameters.filter("not built").select(var("slot").alias("id"), function.alias("function"), F.col("target").alias("name"), "line"),
        "returns": facts.filter("fact = 'return'").select(place().alias("id"), function.alias("function")),
        "calls": facts.filter("fact = 'followed'").select(var("slot").alias("id"), followed.alias("function")),
        "arguments": facts.filter("fact = 'argument'").select(
            place().alias("id"), followed.alias("function"), F.col("target").alias("name"), var("slot").alias("result")
        ),
    }


def parsed_once(facts: DataFrame) -> DataFrame:
    """Facts written to the shared folder: the graph and the rules read them many times."""
    return materialise(facts)


def python_levels(facts: DataFrame) -> DataFrame:
    """``levels(repository_id, path, line, col, kind, level, source_line)`` for ``python_matches``.

    ``facts`` should come from ``parsed_once``.  The levels are written once as well: several rules join them.
    """
    from riskweave.operators.file_flow import solved

    tables = flow_tables(facts)
    sinks = tables["sinks"]
    found = solved(**{**tables, "sinks": sinks.select("id", "kind").distinct()}, file_of=F.substring_index("a", "|", 2))
    return materialise(
        found.join(sinks, ["id", "kind"]).select(
            "repository_id", "path", "line", "col", "kind", "level", F.col("source").alias("source_line")
        )
    )


# --- propagation ---------------------------------------------------------------------------


def _mask(safe: Column, kinds: tuple[str, ...]) -> Column:
    """The kinds of a list as bits."""
    out = F.lit(0).cast("bigint")
    for i, kind in enumerate(kinds):
        out = out.bitwiseOR(F.when(F.array_contains(safe, kind), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return out


def _chains(steps: DataFrame, kept: DataFrame) -> tuple[DataFrame, int]:
    """``id, up, mask, dead``: nodes with one way in, the node each hangs from, and what is made safe on the way.

    A node that is no source and has one edge in holds what its predecessor holds, less what that edge makes safe.  Pointers
    to predecessors are doubled and the sets joined, so after k rounds every chain of 2^k steps has been run through.  When a round
    settles nothing more, what is left hangs from a ring that nothing enters: ``dead``.
    """
    into = steps.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("up"), F.first("mask").alias("mask")).filter("n = 1")
    single = into.select(F.col("dst").alias("id"), "up", "mask").join(kept, "id", "left_anti")
    pointers = materialise(single.withColumn("dead", F.lit(False)))
    count = pointers.count()
    if not count:
        return pointers, 0
    open_before = None
    while True:
        ahead = pointers.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("mask").alias("more"))
        jumped = pointers.join(ahead, "up", "left").select(
            "id", F.coalesce("further", "up").alias("up"), F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))).alias("mask"),
            F.col("further").isNotNull().alias("dead"),
        )
        pointers = materialise(jumped)
        still = pointers.filter("dead").count()
        if still in (0, open_before):
            return pointers, count
        open_before = still


def _contracted(steps: DataFrame, chains: DataFrame) -> DataFrame:
    """The edges between the nodes that are left; of several ways only what all make safe stays safe."""
    hung = chains.select(F.col("id").alias("src"), F.col("up"), F.col("mask").alias("more"), "dead")
    rest = steps.join(chains.select(F.col("id").alias("dst")), "dst", "left_anti").join(hung, "src", "left")
    rest = rest.filter("not coalesce(dead, false)").select(
        F.coalesce("up", "src").alias("src"), "dst", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0))).alias("mask")
    )
    return materialise(rest.filter("src <> dst").groupBy("src", "dst").agg(F.bit_and("mask").alias("mask")))


def propagate(
    nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = dims.KINDS
) -> DataFrame:
    """``state(id, kind, origin, source)``: the least source of each origin that reaches a node.

    First nodes with one way in are taken out (``_chains``), edges that have become parallel are merged, and that is repeated
    while it takes out a tenth of the nodes; long chains, trees and ladders so cost rounds by the logarithm of their depth.
    What is left is solved semi-naively: each round moves only what improved in the last one, against all that is known
    already.  Every round is written to the shared folder, so a lost executor repeats one round,
    not all of them.  Sources only fall, so the rounds end by themselves however long a flow is.  Then the nodes that were taken
    out get what the node they hang from holds, less what was made safe on the way.
    """
    masked = edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst", _mask(F.col("safe_for"), kinds).alias("mask"))
    steps = materialise(masked.groupBy("src", "dst").agg(F.bit_and("mask").alias("mask")))
    bit = F.lit(0).cast("bigint")
    for i, kind in enumerate(kinds):
        bit = F.when(F.col("kind") == kind, F.lit(1 << i).cast("bigint")).otherwise(bit)
    start = nodes.select(
        "id", "origin", F.col("line").cast("bigint").alias("source"), "safe_for",
        F.explode(_strings(kinds)).alias("kind"),
    ).filter(~F.array_contains("safe_for", F.col("kind")))
    frontier = materialise(start.groupBy(*KEY).agg(F.min("source").alias("source")))
    sources, taken = frontier.select("id").distinct(), []
    while True:
        chains, count = _chains(steps, sources)
        if not count:
            break
        left = steps.count()
        taken.append(chains)
        steps = _contracted(steps, chains)
        if 10 * count < left:
            break
    state = _settled(frontier, steps, bit)
    for chains in reversed(taken):
        state = materialise(state)
        below = chains.filter("not dead").join(state.withColumnRenamed("id", "up"), "up").filter(F.col("mask").bitwiseAND(bit) == 0)
        state = state.unionByName(below.select(*KEY, "source"))
    return state


def _settled(frontier: DataFrame, steps: DataFrame, bit: Column) -> DataFrame:
    """Rounds over the edges until nothing improves.

    What is known is a few tables: a new one is merged with those before it that are no larger, so each row is
    written again a logarithmic number of times and a round reads a logarithmic number of tables.
    """
    known_tables = [(frontier, frontier.count())]
    while True:
        seen = _union(known_tables)
        moved = (
            steps.join(frontier.withColumnRenamed("id", "src"), "src")
            .filter(F.col("mask").bitwiseAND(bit) == 0)
            .groupBy(F.col("dst").alias("id"), "kind", "origin")
            .agg(F.min("source").alias("source"))
        )
        m, s = moved.alias("m"), seen.alias("s")
        known = F.col("s.source") <= F.col("m.source")
        for key in KEY:
            known = known & (F.col(f"m.{key}") == F.col(f"s.{key}"))
        frontier = materialise(m.join(s, known, "left_anti").select(*KEY, "source"))
        if frontier.isEmpty():
            return seen.groupBy(*KEY).agg(F.min("source").alias("source"))
        known_tables.append((frontier, frontier.count()))
        while len(known_tables) > 1 and known_tables[-2][1] <= known_tables[-1][1]:
            merged = _union(known_tables[-2:]).groupBy(*KEY).agg(F.min("source").alias("source"))
            merged = materialise(merged)
            known_tables[-2:] = [(merged, merged.count())]


def _union(tables: list[tuple[DataFrame, int]]) -> DataFrame:
    every, *rest = [table for table, _ in tables]
    for table in rest:
        every = every.unionByName(table)
    return every


def classify(state: DataFrame, sinks: DataFrame) -> DataFrame:
    """``(id, kind, level, source)`` per sink: tainted by input, unknown if only opaque, else clean."""
    reasons = sinks.select("id", "kind").distinct().join(
        state.filter(F.col("origin") != dims.RANDOM), ["id", "kind"], "left"
    )
    per = reasons.groupBy("id", "kind").agg(
        F.min(F.when(F.col("origin") == dims.INPUT, F.col("source"))).alias("source"),
        F.bool_or(F.coalesce(F.col("origin") == dims.OPAQUE, F.lit(False))).alias("opaque"),
    )
    level = (
        F.when(F.col("source").isNotNull(), dims.TAINTED).when(F.col("opaque"), dims.UNKNOWN).otherwise(dims.CLEAN)
    )
    return per.select("id", "kind", level.alias("level"), "source")


def taint_reachability(nodes: DataFrame, edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """``classify`` of ``propagate``; random origins, of which no level speaks, are not moved."""
    return classify(propagate(nodes.filter(F.col("origin") != dims.RANDOM), edges), sinks)


def taint_cap(reasons: DataFrame, limit: int = MAX_REASONS) -> DataFrame:
    """Merge the opaque reasons of values that have more than ``limit``.

    The merged reason is safe for a kind only where every merged one was.  That is a count per
    kind, so no list of reasons is ever gathered.
    """
    totals = reasons.groupBy("id").agg(
        F.count("*").alias("reasons"),
        F.count_if(F.col("origin") == dims.OPAQUE).alias("opaques"),
        *[
            F.count_if((F.col("origin") == dims.OPAQUE) & F.array_contains("safe_for", k)).alias(f"safe_{k}")
            for k in dims.KINDS
        ],
    )
    large = totals.filter(F.col("reasons") > limit)
    kept_safe = F.array_compact(
        F.array(*[F.when(F.col(f"safe_{k}") == F.col("opaques"), F.lit(k)) for k in sorted(dims.KINDS)])
    )
    merged = large.filter("opaques > 0").select(
        "id", F.lit(dims.OPAQUE).alias("origin"), F.lit(0).cast("bigint").alias("line"),
        kept_safe.alias("safe_for"),
    )
    tagged = reasons.join(large.select("id", F.lit(True).alias("over")), "id", "left")
    rest = tagged.filter((F.col("origin") != dims.OPAQUE) | F.col("over").isNull())
    return rest.select("id", "origin", F.col("line").cast("bigint").alias("line"), "safe_for").unionByName(merged)

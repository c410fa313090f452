"""Secret rules: committed credentials, at most one finding per line, never quoting the value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.functions import paths, text

# --- fixed values: token shapes published by their providers --------------------------------
AWS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
PROVIDER_TOKEN = (
    r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}"
    r"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{16,})"
)
PROVIDER_NEEDLES = ("gh", "glpat-", "xox", "k_live_", "AIza", "npm_", "pypi-")
PEM_HEADER = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
PEM_NEEDLE = "PRIVATE KEY-----"
PEM_SAME_LINE = PEM_HEADER + r"[^A-Za-z0-9]{0,12}(?:n[^A-Za-z0-9]{0,12})?[A-Za-z0-9+/=]{40,}"
PEM_BODY = r"^[^A-Za-z0-9]{0,12}(?:\\n)?[A-Za-z0-9+/=]{40,}(?:\\n|[^A-Za-z0-9]|$)"
PEM_ATTRIBUTE = r"^(?:Proc-Type|DEK-Info|[A-Z][A-Za-z-]+): "
# A key begins after at most so many blank lines: part of what the rule means.
PEM_BLANKS = 2
DATABASE_URL = (
    r"\b(?:postgres|postgresql|mysql|mariadb|mongodb|redis|rediss|amqp|amqps|mssql|sqlserver"
    r"|oracle|clickhouse)(?:\+[a-z0-9]+)?://[^\s:/@\"']*:([^\s/@\"']+)@"
)
PLACEHOLDER = (
    r"change[_ -]?me|your[_ -]|_here$|-here$|example|placeholder|redacted|dummy|xxx|todo|fake"
    r"|^<.*>$|^[*.]+$|^(?:none|null|true|false|undefined|test|password|secret)$"
)
REFERENCE = r"^(?:\$|\{\{|<|%\(|#\{|os\.environ|env\.)|\}\}$|getenv|process\.env|os\.environ"
PLAIN_WORDS = r"^[a-z]+(?:[._-][a-z]+)*$"
TRANSLATION_FOLDERS = ("i18n", "locale", "locales", "translations")
TRANSLATION_FILE = r"^messages(?:_[A-Za-z_]+)?\.properties$"
MIN_SECRET = 8

_WORDS = (
    ("password",), ("passwd",), ("pwd",), ("secret",), ("token",), ("credential",),
    ("api", "key"), ("access", "key"), ("private", "key"),
)


def _keyword_pattern() -> str:
    """Each credential word as written in lower, title, camel and upper case."""
    out = []
    for parts in _WORDS:
        lower, title = list(parts), [p.capitalize() for p in parts]
        upper = [p.upper() for p in parts]
        camel = [lower[0], *title[1:]]
        forms = ["[_.-]?".join(form) for form in (lower, title, camel, upper)]
        out += [form for i, form in enumerate(forms) if form not in forms[:i]]
    return "(?:" + "|".join(out) + ")"


KEYWORD = _keyword_pattern()
NAME_TAIL = r"s?(?:[A-Z0-9_.-][\w.-]*)?"
QUOTED = KEYWORD + NAME_TAIL + r"[\"']?\s*(?:=>|:=|=|:)\s*[\"'`][^\"'`]{8,}[\"'`]"
QUOTED_PARTS = "^(" + KEYWORD + NAME_TAIL + r")([\"']?)\s*(?:=>|:=|=|:)\s*[\"'`]([^\"'`]{8,})[\"'`]"
ENV_LINE = r"^\s*(?:export\s+)?([\w.-]+)\s*[=:]\s*([^\s\"'#]+)\s*$"
SHELL_DEFAULT = (
    r"^\s*(?:export\s+)?([\w.-]+)=[\"']?\$\{[\w.]+:[-=]['\"]?([^}'\"]*)['\"]?\}[\"']?\s*$"
)
COMMENT = r"^\s*(?:#|//|\*|--|;)"
NEEDLES = r"(?i)passw|pwd|secret|token|credential|key"
MARK = "\ue000"


def _any(line: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | line.contains(needle)
    return hit


def _is_value(value: Column) -> Column:
    lowered = F.lower(F.trim(value))
    return (
        (F.length(value) >= MIN_SECRET) & ~lowered.rlike(PLACEHOLDER) & ~F.trim(value).rlike(REFERENCE)
    )


def _named_only_token(name: Column) -> Column:
    """A lexer's ``token`` is not a credential; ``token_secret`` and ``api_key`` say what they are."""
    without = F.regexp_replace(F.lower(name), "token", "")
    return ~without.rlike("passw|pwd|secret|credential|key")


def env_style(path: Column) -> Column:
    name = paths.file_name(path)
    return paths.suffix(path).isin(*dims.ENV_SUFFIXES) | (name == ".env") | name.startswith(".env.")


def translation_bundle(path: Column) -> Column:
    folders = F.transform(F.split(path, "/"), F.lower)
    return (
        F.arrays_overlap(folders, F.array(*map(F.lit, TRANSLATION_FOLDERS)))
        | F.lower(paths.file_name(path)).rlike(TRANSLATION_FILE)
    )


def generic_assignment(path: Column, line: Column) -> Column:
    """``struct(name, value)`` of the first credential assigned on a line, or NULL.

    A name counts only where it is code: the quotes before it must be balanced, or the name must
    itself be a closed string (``"password": "..."``).
    """
    safe = F.replace(line, F.lit(MARK), F.lit(" "))
    pieces = F.split(F.regexp_replace(safe, "(" + QUOTED + ")", MARK + "$1"), MARK)

    def candidate(i: Column) -> Column:
        before = F.array_join(F.slice(pieces, 1, i), "")
        piece = F.element_at(pieces, i + 1)
        quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
        closed = F.regexp_extract(piece, QUOTED_PARTS, 2) == '"'
        head = F.reverse(F.regexp_extract(F.reverse(before), r"^[\w.-]*", 0))
        name = F.concat(head, F.regexp_extract(piece, QUOTED_PARTS, 1))
        value = F.regexp_extract(piece, QUOTED_PARTS, 3)
        lexer = _named_only_token(name) & value.rlike(PLAIN_WORDS)
        good = ((quotes % 2 == 1) == closed) & _is_value(value) & ~lexer
        return F.when(good, F.struct(name.alias("name"), value.alias("value")))

    found = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), candidate), lambda c: c.isNotNull()
    )
    quoted = F.when(F.size(pieces) > 1, F.get(found, 0))

    def assigned(pattern: str, allowed: Column) -> Column:
        name, value = F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)
        return F.when(
            allowed & name.rlike(KEYWORD) & _is_value(value),
            F.struct(name.alias("name"), value.alias("value")),
        )

    unquoted = assigned(ENV_LINE, env_style(path) & ~translation_bundle(path))
    fallback = assigned(SHELL_DEFAULT, F.lit(True))
    usable = line.rlike(NEEDLES) & ~line.rlike(COMMENT)
    return F.when(usable, F.coalesce(fallback, quoted, unquoted))


def private_key_body(line: Column, after: Column) -> Column:
    """A PEM header with a key after it: on the line, or past blank and attribute lines only."""

    def step(state: Column, x: Column) -> Column:
        blank, attribute = F.trim(x) == "", x.rlike(PEM_ATTRIBUTE)
        blanks = state["blanks"] + F.when(blank, 1).otherwise(0)
        return F.when(state["done"], state).otherwise(
            F.struct(
                (~(blank | attribute) | (blanks > PEM_BLANKS)).alias("done"),
                (~(blank | attribute) & x.rlike(PEM_BODY)).alias("found"),
                blanks.alias("blanks"),
            )
        )

    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("found"), F.lit(0).alias("blanks"))
    later = F.aggregate(F.coalesce(after, F.array().cast("array<string>")), start, step, lambda s: s["found"])
    ends = line.rlike(PEM_HEADER + r"(?:\\n)?[\"']?\s*(?:\+\s*)?$")
    return line.rlike(PEM_SAME_LINE) | (ends & later)


def secret_rule_id(path: Column, line: Column, after: Column) -> Column:
    """The one secret rule a line breaks, the most specific first; NULL for none."""
    password = F.regexp_extract(line, DATABASE_URL, 1)
    return (
        F.when(_any(line, ("AKIA", "ASIA")) & line.rlike(AWS_KEY), "SEC001")
        .when(line.contains(PEM_NEEDLE) & private_key_body(line, after), "SEC002")
        .when(_any(line, PROVIDER_NEEDLES) & line.rlike(PROVIDER_TOKEN), "SEC003")
        .when(
            line.contains("://") & line.rlike(DATABASE_URL) & ~line.rlike(COMMENT)
            & ~F.lower(password).rlike(PLACEHOLDER) & ~password.rlike(REFERENCE),
            "SEC004",
        )
        .when(generic_assignment(path, line).isNotNull(), "SEC005")
    )


def secret_snippet(rule_id: Column, path: Column, line: Column) -> Column:
    """What is stored for a secret: the line with its value redacted, or name and length only."""

    def redacted(pattern: str, group: int) -> Column:
        value = F.regexp_extract(line, pattern, group)
        whole = F.replace(line, value, text.redact_secret(value))
        # Any further secret on the line is cut to the same four characters.
        for other in (AWS_KEY, PROVIDER_TOKEN):
            whole = F.regexp_replace(whole, "(" + other + ")", "<redacted>")
        whole = F.regexp_replace(whole, r"(://[^\s:/@\"']*:)(?![^\s]*<redacted)[^\s/@\"']+@", "$1<redacted>@")
        return F.regexp_replace(
            whole, "(" + KEYWORD + NAME_TAIL + r"[\"']?\s*(?:=>|:=|=|:)\s*[\"'`])(?![^\"'`]*<redacted)[^\"'`]{8,}",
            "$1<redacted>",
        )

    generic = generic_assignment(path, line)
    header = F.regexp_extract(line, PEM_HEADER, 0)
    return text.clean_snippet(
        F.when(rule_id == "SEC001", redacted(AWS_KEY, 0))
        .when(rule_id == "SEC002", F.concat(header, F.lit(" <redacted key>")))
        .when(rule_id == "SEC003", redacted(PROVIDER_TOKEN, 0))
        .when(rule_id == "SEC004", redacted(DATABASE_URL, 1))
        .otherwise(text.redact_assignment(generic["name"], generic["value"]))
    )

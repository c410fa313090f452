"""Path Columns: names, suffixes, languages, context and ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import dims
from riskweave.policy import POLICY, RiskPolicy


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for ``Makefile`` and ``.env``."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), name)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: (part != "") & (part != "."))


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*pairs), key)


def classify_language(path: Column) -> Column:
    name = F.lower(file_name(path))
    by_name = _lookup(dims.LANGUAGE_BY_NAME, name)
    by_docker = F.when(name.startswith("dockerfile"), F.lit("Dockerfile"))
    return F.coalesce(
        by_name, by_docker, _lookup(dims.LANGUAGE_BY_SUFFIX, suffix(path)), F.lit(dims.OTHER_LANGUAGE)
    )


def finding_language(path: Column) -> Column:
    return _lookup(dims.ADVICE_LANGUAGE, suffix(path))


def in_ignored_directory(path: Column) -> Column:
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, dims.IGNORED_DIRECTORIES)))


def is_source_candidate(path: Column) -> Column:
    return (
        ~in_ignored_directory(path)
        & ~file_name(path).isin(*dims.SKIPPED_NAMES)
        & ~suffix(path).isin(*dims.SKIPPED_SUFFIXES)
    )


def walk_order_key(path: Column) -> Column:
    """Sorts as a folder walk reads: the files of a folder, then its sub-folders."""
    parts = F.split(path, "/")
    return F.transform(
        parts,
        lambda part, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), part),
    )


def path_context(rule_id: Column, path: Column, policy: RiskPolicy = POLICY) -> Column:
    """secret / test / vendored / example / application, judged by whole path segments."""
    lowered = F.transform(segments(path), F.lower)
    name = F.lower(file_name(path))

    def has(markers: tuple) -> Column:
        return F.arrays_overlap(lowered, F.array(*map(F.lit, markers)))

    test_name = (
        name.startswith("test_") | name.startswith("tests_")
        | name.contains(".spec.") | name.contains(".test.")
        | name.endswith("_spec.py") | name.endswith("_test.py")
    )
    return (
        F.when(rule_id.startswith(policy.credential_prefix), F.lit("secret"))
        .when(has(policy.test_markers) | test_name, F.lit("test"))
        .when(has(policy.vendored_markers) | name.rlike(policy.vendored_name), F.lit("vendored"))
        .when(has(policy.example_markers), F.lit("example"))
        .otherwise(F.lit("application"))
    )


def safe_relative_path(path: Column) -> Column:
    """True for a path that can only name a file below the folder it is joined to."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == "..") | p.contains("\\"))
    return (
        path.isNotNull() & (path != "") & ~path.contains("\x00")
        & ~path.rlike("^[A-Za-z]:") & ~bad
    )


def glob_to_regex(pattern: str) -> str:
    """A shell glob over the whole path as a regular expression (``*`` crosses folders)."""
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        close = pattern.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + char if char in r"\.^$+{}()|[]" else char)
        i += 1
    return "^(?s:" + "".join(out) + ")\\z"


def is_excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """A path equals, lies below, or matches one of the patterns."""
    hit = F.lit(False)
    for pattern in patterns:
        cleaned = pattern.strip().replace("\\", "/").lstrip("./").rstrip("/")
        hit = (
            hit | (path == cleaned) | path.startswith(cleaned + "/")
            | path.rlike(glob_to_regex(cleaned)) | path.rlike(glob_to_regex(cleaned + "/*"))
        )
    return hit


# --- fixed values: comment openers by suffix, and statements that do nothing ---
HASH_COMMENT = (
    ".py", ".pyi", ".rb", ".sh", ".bash", ".yml", ".yaml", ".toml", ".tf", ".pl", ".r", ".ps1",
    ".properties", ".env", ".cfg", ".ini", ".conf", ".php",
)
SLASH_COMMENT = (
    ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".cc", ".hpp",
    ".cs", ".go", ".php", ".kt", ".swift", ".rs", ".scala",
)
DASH_COMMENT = (".sql", ".lua", ".hs")
NO_OPS = ("pass", "...", ";", "{}", "{", "}", "pass;")


def inert_line(line: Column, path: Column) -> Column:
    """Blank, a comment of the file's language, or a bare no-op."""
    from riskweave.functions.text import strip

    text, ext = strip(line), suffix(path)
    slash = (
        text.startswith("//") | text.startswith("/*") | text.startswith("*/")
        | (text == "*") | text.startswith("* ")
    )
    return (
        (text == "") | text.isin(*NO_OPS)
        | (ext.isin(*HASH_COMMENT) & text.startswith("#"))
        | (ext.isin(*SLASH_COMMENT) & slash)
        | (ext.isin(*DASH_COMMENT) & text.startswith("--"))
    )


def repository_label(origin: Column) -> Column:
    """An upload's name, or the last two segments of a clone address."""
    trimmed = F.regexp_replace(F.regexp_replace(origin, r"\.git$", ""), r"/+$", "")
    parts = F.filter(F.split(trimmed, "/"), lambda p: p != "")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(trimmed.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), F.array_join(tail, "/")).otherwise(trimmed)


def download_slug(origin: Column) -> Column:
    """A file-name part holding only lower-case letters, digits and hyphens."""
    flat = F.regexp_replace(F.replace(origin, F.lit("\\"), F.lit("/")), r"/+$", "")
    base = F.regexp_replace(F.substring_index(flat, "/", -1), r"(?i)\.(git|zip)$", "")
    slug = F.regexp_replace(F.lower(base), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 40), "^-+|-+$", "")
    return F.when(slug == "", F.lit("repository")).otherwise(slug)


def cwe_url(cwe_id: Column) -> Column:
    number = F.regexp_extract(cwe_id, r"^CWE-(\d{1,6})$", 1)
    return F.when(
        number != "",
        F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")),
    )


def owasp_code(value: Column) -> Column:
    """Any spelling of a Top 10 category as ``A03:2021``; NULL outside 1..10."""
    pattern = r"\bA(\d{1,2}):(\d{4})\b"
    number = F.regexp_extract(value, pattern, 1).try_cast("int")
    year = F.regexp_extract(value, pattern, 2)
    return F.when(
        number.between(1, 10), F.concat(F.lit("A"), F.lpad(number.cast("string"), 2, "0"), F.lit(":"), year)
    )

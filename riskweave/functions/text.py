"""Text Columns: cleaning, normalising and redacting.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: limits and character classes ---
SNIPPET_MAX = 240
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
SPACE = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LINE_COMMENT = r"(?U)(^|\s)(//|#)\s.*$"
PARAGRAPH_BREAK = r"(?U)\n\s*\n"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
UNSAFE_CODE = r"(?![\n\t])[\p{C}]"
ELLIPSIS = "\u2026"


def one_of(value: Column, names) -> Column:
    """``isin`` for long fixed lists: one constant, which Catalyst folds, instead of many literals."""
    return F.array_contains(F.split(F.lit("\n".join(names)), "\n"), value)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_space(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_snippet(text: Column) -> Column:
    """A stored line of somebody else's code: no control characters, trimmed, bounded."""
    kept = strip(F.regexp_replace(text, CONTROL, ""))
    return F.when(
        F.length(kept) > SNIPPET_MAX, F.concat(F.substring(kept, 1, SNIPPET_MAX), F.lit(ELLIPSIS))
    ).otherwise(kept)


def strip_line_comment(line: Column) -> Column:
    """Remove a trailing ``// ..`` or ``# ..``; lines holding neither skip the expression."""
    return F.when(
        line.contains("//") | line.contains("#"), F.regexp_replace(line, LINE_COMMENT, "")
    ).otherwise(line)


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; a final line break does not start another line."""
    parts = F.split(text, LINE_BREAK)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(trimmed)


def collapse(text: Column) -> Column:
    """Normalise white space inside paragraphs, keep the breaks between them."""
    paragraphs = F.transform(F.split(text, PARAGRAPH_BREAK), normalise_space)
    return F.array_join(F.filter(paragraphs, lambda p: p != ""), "\n\n")


def printable(text: Column) -> Column:
    return F.regexp_replace(text, UNPRINTABLE, "?")


def redact_secret(value: Column) -> Column:
    """At most four characters of a secret, and how long it was."""
    return F.concat(
        F.substring(value, 1, 4),
        F.lit(ELLIPSIS + "<redacted "),
        F.length(value).cast("string"),
        F.lit(" chars>"),
    )


def redact_assignment(name: Column, value: Column) -> Column:
    """An assigned credential: its name and the length of its value, nothing of the value."""
    return F.concat(
        name, F.lit(" = <redacted "), F.length(value).cast("string"), F.lit("-character value>")
    )


def sanitise_code(text: Column) -> Column:
    """Drop control and format characters, keep line feeds and tabs."""
    return F.regexp_replace(text, UNSAFE_CODE, "")


# --- inert text for documents ---------------------------------------------------------------


def markdown_text(value: Column) -> Column:
    """Untrusted prose inside a Markdown line: nothing in it can be read as markup."""
    flat = normalise_space(F.coalesce(value, F.lit("")))
    flat = F.replace(flat, F.lit("&"), F.lit("&amp;"))
    flat = F.replace(flat, F.lit("<"), F.lit("&lt;"))
    flat = F.replace(flat, F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(flat, r"([\\`*_\[\]|#~])", r"\\$1")


def markdown_paragraph(value: Column) -> Column:
    """Untrusted prose that begins a line: list and heading markers are disarmed too."""
    flat = markdown_text(value)
    return (
        F.when(flat.rlike(r"^\d+[.)]"), F.regexp_replace(flat, r"^(\d+)", r"$1\\"))
        .when(flat.rlike(r"^[-+=]"), F.concat(F.lit("\\"), flat))
        .otherwise(flat)
    )


def _fence(text: Column, least: int) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), longest + 1))


def markdown_code(value: Column) -> Column:
    """Inline code whose delimiter is longer than any run of back-ticks inside."""
    flat = normalise_space(F.coalesce(value, F.lit("")))
    pad = F.when(flat.startswith("`") | flat.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    fence = _fence(flat, 1)
    span = F.concat(fence, pad, flat, pad, fence)
    return F.when(flat == "", F.lit("")).otherwise(F.replace(span, F.lit("|"), F.lit("\\|")))


def markdown_block(value: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(value, "\r\n?", "\n"), r"^\n+|\n+$", "")
    fence = _fence(body, 3)
    return F.concat(fence, F.lit("\n"), body, F.lit("\n"), fence)


def html_text(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out

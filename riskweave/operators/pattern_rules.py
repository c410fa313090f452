"""The line rules: what each one looks for, as Columns over one statement.

A rule is data.  Adding one is adding a ``LineRule`` to the registry passed to ``detect``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import dims

# --- fixed values: limits and words --------------------------------------------------------
MAX_STATEMENT_LENGTH = 1000
MAX_STATEMENT_LINES = 12
SECRET_WORDS = "token|password|passwd|secret|otp|nonce|session|cookie|csrf|salt|key"
SECRET_WINDOW = 5

# --- fixed values: the expressions of each rule --------------------------------------------
EVAL_CALL = r"\beval\s*\((.*)$"
LITERAL_ARGUMENT = r"^\s*(?:\"[^\"'`]*\"|'[^\"'`]*'|`[^\"'`]*`)\s*\)"
CHILD_PROCESS = (
    r"\b(?:child_process\.)?exec(?:Sync)?\s*\(\s*(?:`[^`]*\$\{|[\"'][^\"']*[\"']\s*\+|\w+\s*\+)"
)
INNER_HTML = r"(?:\.innerHTML\s*=\s*[^\s\"'`]|dangerouslySetInnerHTML)"
MATH_RANDOM = (
    r"(?i)(?:token|password|secret|otp|nonce|session|key)\w*\s*[:=][^;\n]*Math\.random\s*\("
)
JS_WEAK_HASH = r"createHash\s*\(\s*[\"'](?:md5|sha1)[\"']\s*\)"
JS_TLS_OFF = r"(?:rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*[\"']?0)"
RUNTIME_EXEC = r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*(?:\+|\$\{)"
DESERIALIZE = r"new\s+ObjectInputStream\s*\(|\.readObject\s*\(\s*\)"
JAVA_WEAK_HASH = r"MessageDigest\.getInstance\s*\(\s*\"(?i:MD2|MD4|MD5|SHA-?1)\"\s*[,)]"
JAVA_WEAK_CIPHER = (
    r"\b(?:Cipher|KeyGenerator|SecretKeyFactory)\s*\.\s*getInstance\s*\(\s*\""
    r"(?i:(?:DES|DESede|TripleDES|3DES|RC2|RC4|ARCFOUR|Blowfish)|[A-Za-z0-9]+/ECB/)"
)
JAVA_WEAK_RANDOM = (
    r"(?<![\w.])new\s+(?:java\.util\.)?Random\s*\("
    r"|\bMath\.random\s*\(|\bThreadLocalRandom\.current\s*\("
)
JAVA_COOKIE = r"\.setSecure\s*\(\s*false\s*\)"
PHP_COMMAND = r"\b(?:system|shell_exec|passthru|popen|proc_open|eval)\s*\(\s*\$"
GO_SHELL = r"exec\.Command\s*\(\s*\"(?:/bin/)?(?:ba)?sh\"\s*,\s*\"-c\""
STRING_LITERAL = r"\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'|`[^`\\]*(?:\\.[^`\\]*)*`"
SQL_STATEMENT = (
    r"(?i)\b(?:select|insert\s+into|delete\s+from)\b"
    r"|\bupdate\s+[\w.\"`\[\]]+\s+set\b"
    r"|^[\"'`]\s*update\s+[\"'`]$"
)
JOINED_TO_VALUE = r"\"\"\s*[+.]\s*[A-Za-z_$(]|[\w)\]]\s*\+\s*\"\""
JOINED_AT_END = r"\"\"\s*[+.]\s*$"


def unicode(pattern: str) -> str:
    """Java's ``\\w``, ``\\s`` and ``\\b`` read ASCII only unless told otherwise."""
    return "(?U)" + pattern


@dataclass(frozen=True)
class LineRule:
    """``needles`` are literal texts of which a line must hold one before the expression runs."""

    rule_id: str
    suffixes: tuple[str, ...]
    pattern: str
    needles: tuple[str, ...]
    condition: Callable[[Column, Column], Column] | None = None
    near_secret: bool = False
    first_match_only: bool = False

    def fires(self, statement: Column, whole: Column) -> Column:
        if self.condition is not None:
            return self.condition(statement, whole)
        return statement.rlike(unicode(self.pattern))


def _contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(not needles)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def eval_of_built_value(statement: Column, whole: Column) -> Column:
    argument = F.regexp_extract(statement, unicode(EVAL_CALL), 1)
    return statement.rlike(unicode(EVAL_CALL)) & ~argument.rlike(unicode(LITERAL_ARGUMENT))


def sql_is_built(statement: Column, whole: Column) -> Column:
    """A SQL literal joined to a value: find the literals first, then what they touch."""
    literals = F.regexp_extract_all(statement, F.lit(STRING_LITERAL), F.lit(0))
    is_sql = F.exists(literals, lambda x: x.rlike(unicode(SQL_STATEMENT)))
    template = F.exists(literals, lambda x: x.startswith("`") & x.contains("${"))
    outline = F.regexp_replace(statement, STRING_LITERAL, '""')
    return is_sql & (
        template | outline.rlike(unicode(JOINED_TO_VALUE))
        | (~whole & outline.rlike(unicode(JOINED_AT_END)))
    )


JS, JAVA = dims.JAVASCRIPT_SUFFIXES, dims.JAVA_SUFFIXES

PATTERN_RULES: tuple[LineRule, ...] = (
    LineRule("JS001", JS, EVAL_CALL, ("eval",), eval_of_built_value),
    LineRule("JS002", JS, CHILD_PROCESS, ("exec",)),
    LineRule("JS003", JS, INNER_HTML, (".innerHTML", "dangerouslySetInnerHTML")),
    LineRule("JS004", JS, MATH_RANDOM, ("andom", "ANDOM")),
    LineRule("JS005", JS, JS_WEAK_HASH, ("createHash",)),
    LineRule("JS006", JS, JS_TLS_OFF, ("rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED")),
    LineRule("JV001", JAVA, RUNTIME_EXEC, ("Runtime",)),
    LineRule("JV002", JAVA, DESERIALIZE, ("ObjectInputStream", ".readObject")),
    LineRule("JV003", JAVA, JAVA_WEAK_HASH, ("MessageDigest",)),
    LineRule("JV004", JAVA, JAVA_WEAK_CIPHER, ("getInstance",)),
    LineRule("JV005", JAVA, JAVA_WEAK_RANDOM, ("andom",), near_secret=True),
    LineRule("JV006", JAVA, JAVA_COOKIE, (".setSecure",)),
    LineRule("PH001", dims.PHP_SUFFIXES, PHP_COMMAND, ("$",)),
    LineRule("GO001", dims.GO_SUFFIXES, GO_SHELL, ("exec.Command",)),
    LineRule(
        "SQL001", dims.SQL_HOST_SUFFIXES, SQL_STATEMENT, ('"', "'", "`"), sql_is_built,
        first_match_only=True,
    ),
)


def pattern_rule_ids(
    ext: Column, statement: Column, whole: Column, usable: Column,
    rules: tuple[LineRule, ...] = PATTERN_RULES,
) -> Column:
    """Ids of every rule that fires on one statement: one pass, cheap tests before costly ones."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    usable & ext.isin(*rule.suffixes) & _contains_any(statement, rule.needles)
                    & rule.fires(statement, whole),
                    F.lit(rule.rule_id),
                )
                for rule in rules
            ]
        )
    )

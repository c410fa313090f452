"""Hash Columns: identities and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.text import normalise_space

DEFAULT_SPLIT_SALT = "riskweave-evaluation-split-v1"


def fingerprint(rule_id: Column, path: Column, snippet: Column, occurrence: Column) -> Column:
    """Identity of a finding: rule, file, code and which repeat; never the line number."""
    return F.sha2(
        F.concat_ws("|", rule_id, path, normalise_space(snippet), occurrence.cast("string")), 256
    )


def document_content_hash(title: Column, sections: Column) -> Column:
    """Hash over what is embedded: the title and every (name, text) section."""
    tail = F.transform(
        sections, lambda s: F.concat(F.lit("\x1e"), s["name"], F.lit("\x1f"), s["text"])
    )
    return F.sha2(F.concat(title, F.array_join(tail, "")), 256)


def split_half(name: Column, salt: str = DEFAULT_SPLIT_SALT) -> Column:
    """Half of the answer key a case is in, from its name alone.

    To reproduce the halves of an earlier programme, pass the salt that programme used.
    """
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), name), 256), 1, 2), 16, 10).cast("int")
    return F.when(first % 2 == 0, F.lit("development")).otherwise(F.lit("held-out"))

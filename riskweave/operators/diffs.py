"""Unified diffs as rows: parsing, statistics, applying, screening and judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import paths, text
from riskweave.functions.paths import inert_line

# --- fixed values: the shape of a diff and the limits of a fix ---
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
MAX_ADDED_LINES = 25
MAX_NET_REMOVED = 6


def _number(line: Column, group: int, default: int | None = None) -> Column:
    found = F.regexp_extract(line, HUNK, group).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def _split(diff: Column) -> Column:
    """Lines of a diff: line endings dropped, blank lines at the end dropped."""
    trimmed = F.regexp_replace(diff, r"[\r\n]+$", "")
    return F.transform(F.split(trimmed, "\n"), lambda x: F.regexp_replace(x, "\r+$", ""))


def _with_heads(diffs: DataFrame) -> DataFrame:
    """``(patch_id, file_path, parts, head)``: ``head`` says what is wrong with the first lines."""
    parts = _split(F.col("diff"))
    rows = diffs.select("patch_id", "file_path", parts.alias("parts"))
    old, new, third = (F.get("parts", F.lit(i)) for i in range(3))

    def named(line: Column, marker: str) -> Column:
        shown = F.trim(F.get(F.split(F.substr(line, F.lit(5)), "\t"), F.lit(0)))
        return shown == F.concat(F.lit(marker), F.col("file_path"))

    head = (
        F.when(F.size("parts") < 3, "empty")
        .when(~old.startswith("--- ") | ~new.startswith("+++ "), "not a unified diff")
        .when(~named(old, "a/") | ~named(new, "b/"), "names a different file")
        .when(~third.rlike(HUNK), "no hunk header")
    )
    return rows.withColumn("head", head)


def _parsed(diffs: DataFrame) -> DataFrame:
    """Body lines with their hunk, what each consumes, and the patch's ``reason`` if it is malformed.

    Headers are judged before anything is exploded; everything else is windows within one patch,
    all on one shuffle.  A patch is the diff of one file, so its lines are a bounded group.
    """
    rows = _with_heads(diffs).filter("head is null").select(
        "patch_id", "file_path", F.posexplode("parts").alias("seq", "line")
    ).filter("seq >= 2").withColumn("is_header", F.col("line").rlike(HUNK))
    order = Window.partitionBy("patch_id").orderBy("seq")
    rows = rows.withColumn("hunk", F.sum(F.col("is_header").cast("int")).over(order)).withColumn(
        "kind",
        F.when(F.col("is_header"), "@").when(F.col("line").startswith("\\"), "\\")
        .when(F.col("line") == "", " ").otherwise(F.substring("line", 1, 1)),
    )
    hunk = Window.partitionBy("patch_id", "hunk")
    inside = hunk.orderBy("seq")

    def header(group: int, default: int | None = None) -> Column:
        return F.max(F.when(F.col("is_header"), _number(F.col("line"), group, default))).over(hunk)

    def consumed(window, *kinds: str) -> Column:
        return F.sum(F.col("kind").isin(*kinds).cast("int")).over(window)

    rows = rows.select(
        "*", header(1).alias("start_old"), header(2, 1).alias("old_count"), header(3).alias("start_new"),
        header(4, 1).alias("new_count"), consumed(inside, " ", "-").alias("olds"),
        consumed(inside, " ", "+").alias("news"), consumed(hunk, " ", "-").alias("old_seen"),
        consumed(hunk, " ", "+").alias("new_seen"),
        F.sum((~F.col("kind").isin("@", " ", "-", "+", "\\")).cast("int")).over(hunk).alias("strange"),
    )
    body = (
        F.when(F.col("strange") > 0, "has a line that is not part of a diff")
        .when((F.col("old_seen") < F.col("old_count")) | (F.col("new_seen") < F.col("new_count")), "cut short")
        .when(
            (F.col("old_seen") > F.col("old_count")) | (F.col("new_seen") > F.col("new_count")),
            "does not match its own line counts",
        )
    )
    found = F.min(F.when(body.isNotNull(), F.struct(F.col("hunk").alias("h"), body.alias("r")))).over(
        Window.partitionBy("patch_id")
    )
    return rows.withColumn("reason", found["r"])


def diff_problems(diffs: DataFrame) -> DataFrame:
    """``(patch_id, reason)`` for every diff that is not one well-formed single-file diff."""
    heads = _with_heads(diffs).filter("head is not null").select("patch_id", F.col("head").alias("reason"))
    bodies = _parsed(diffs).filter("reason is not null").groupBy("patch_id").agg(F.first("reason").alias("reason"))
    return heads.unionByName(bodies)


def diff_lines(diffs: DataFrame) -> DataFrame:
    """``(patch_id, file_path, hunk, seq, kind, old_line, new_line, text)`` of well-formed diffs."""
    rows = _parsed(diffs).filter(F.col("reason").isNull() & F.col("kind").isin(" ", "-", "+"))
    # "-12,0" names the line after which to add.
    base = F.when(F.col("old_count") == 0, F.col("start_old") + 1).otherwise(F.col("start_old"))
    return rows.select(
        "patch_id", "file_path", "hunk", "seq", "kind",
        F.when(F.col("kind") != "+", base + F.col("olds") - 1).alias("old_line"),
        F.when(F.col("kind") != "-", F.col("start_new") + F.col("news") - 1).alias("new_line"),
        (base + F.col("olds")).alias("before_old_line"),
        F.expr("substring(line, 2)").alias("text"),
    )


def diff_stats(lines: DataFrame) -> DataFrame:
    """Added, removed and net lines per patch."""
    return lines.groupBy("patch_id", "file_path").agg(
        F.count_if(F.col("kind") == "+").alias("added"),
        F.count_if(F.col("kind") == "-").alias("removed"),
        F.countDistinct("hunk").alias("hunks"),
    ).withColumn("net", F.col("added") - F.col("removed"))


def apply_hunks(originals: DataFrame, lines: DataFrame) -> DataFrame:
    """``(patch_id, line_no, line)`` of every patched file; patches that do not fit are left out.

    ``originals(patch_id, line_no, line)`` are the lines of the file each patch is for.  One join
    lays the diff on the file; whether all of it fits is then a flag over the patch.
    """
    old_side = lines.filter("kind <> '+'").select(
        "patch_id", F.col("old_line").cast("int").alias("line_no"), "kind", "text"
    )
    laid = originals.select("patch_id", F.col("line_no").cast("int").alias("line_no"), "line").join(
        old_side, ["patch_id", "line_no"], "full_outer"
    )
    from_file = laid.select(
        "patch_id", F.col("line_no").alias("at"), F.lit(1).alias("part"), F.lit(0).alias("seq"), "line", "kind",
        (F.col("kind").isNotNull() & ~F.col("line").eqNullSafe(F.col("text"))).alias("wrong"),
    )
    added = lines.filter("kind = '+'").select(
        "patch_id", F.col("before_old_line").cast("int").alias("at"), F.lit(0).alias("part"), "seq",
        F.col("text").alias("line"), "kind", F.lit(False).alias("wrong"),
    )
    patch = Window.partitionBy("patch_id")
    every = from_file.unionByName(added).select(
        "*", F.max("wrong").over(patch).alias("misfit"), F.max(F.col("kind").isNotNull()).over(patch).alias("touched")
    )
    kept = every.filter("touched and not misfit and not (kind <=> '-')")
    order = Window.partitionBy("patch_id").orderBy("at", "part", "seq")
    return kept.select("patch_id", F.row_number().over(order).alias("line_no"), "line")


def patch_screen(diffs: DataFrame, lines: DataFrame, replaced: DataFrame) -> DataFrame:
    """``(patch_id, reasons)``: why a proposal is not worth a reviewer's time; empty when it is."""
    inert = inert_line(F.col("text"), F.col("file_path"))
    per = lines.groupBy("patch_id").agg(
        F.count_if(F.col("kind") == "+").alias("added"), F.count_if(F.col("kind") == "-").alias("removed"),
        F.count_if((F.col("kind") == "+") & ~inert).alias("live"),
    )
    malformed = diff_problems(diffs)
    joined = (
        diffs.select("patch_id", (F.trim("diff") == "").alias("empty"))
        .join(per, "patch_id", "left").join(malformed, "patch_id", "left").join(replaced, "patch_id", "left")
    )
    changed = F.col("added") + F.col("removed") > 0
    reasons = F.array_compact(
        F.array(
            F.when(F.col("empty"), "same code").otherwise(F.col("reason")),
            F.when(F.col("added") > F.coalesce("replaced_lines", F.lit(1)) + MAX_ADDED_LINES, "rewrite"),
            F.when(F.col("removed") - F.col("added") > MAX_NET_REMOVED, "mostly deletes code"),
            F.when(changed & (F.col("live") == 0), "nothing that runs"),
        )
    )
    return joined.select("patch_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


def judge_rescan(
    targets: DataFrame, before: DataFrame, after: DataFrame, stats: DataFrame, unparsable: DataFrame
) -> DataFrame:
    """Four checks per patch from two finding tables.

    ``targets(patch_id, rule_id, path, code)``; ``before`` and ``after`` are findings with
    ``repository_id`` = ``patch_id``; ``stats(patch_id, added, removed, live)``;
    ``unparsable(patch_id)`` are patched Python files that no longer parse.
    """
    from riskweave.operators.identity import finding_identity_diff

    diff = finding_identity_diff(before, after).withColumnRenamed("repository_id", "patch_id").alias("d")
    goal = targets.select(
        "patch_id", F.col("rule_id").alias("t_rule"), F.col("path").alias("t_path"), F.col("code").alias("t_code")
    )
    is_target = (
        (F.col("rule_id") == F.col("t_rule")) & (F.col("path") == F.col("t_path")) & (F.col("code") == F.col("t_code"))
    )
    reworded = (F.col("rule_id") == F.col("t_rule")) & (F.col("path") == F.col("t_path")) & (F.col("appeared") > 0)
    per = goal.join(diff, "patch_id", "left").groupBy("patch_id", "t_path").agg(
        F.coalesce(F.bool_or(is_target & (F.col("gone") > 0)), F.lit(False)).alias("resolved"),
        F.count_if(F.col("appeared") > 0).alias("new_identities"),
        F.coalesce(F.bool_or(reworded), F.lit(False)).alias("reworded"),
        F.coalesce(F.sum(F.when(~is_target, F.col("gone"))), F.lit(0)).alias("also_resolved"),
    )
    joined = per.join(stats.select("patch_id", "added", "removed", "live"), "patch_id", "left").join(
        unparsable.select("patch_id").distinct().withColumn("broken", F.lit(True)), "patch_id", "left"
    )
    python = paths.suffix(F.col("t_path")).isin(".py", ".pyi")
    deletion = (F.col("removed") - F.col("added") > MAX_NET_REMOVED) | (F.col("live") == 0)

    def outcome(good: Column) -> Column:
        return F.when(good, "passed").otherwise("failed")

    checks = joined.select(
        "patch_id", outcome(F.col("resolved")).alias("target_resolved"),
        outcome(F.col("new_identities") == 0).alias("no_new_findings"), "reworded",
        outcome(~F.coalesce(deletion, F.lit(True))).alias("not_a_deletion"),
        F.when(~python, "skipped").otherwise(outcome(F.col("broken").isNull())).alias("still_parses"),
        "also_resolved", "new_identities",
    )
    names = ("target_resolved", "no_new_findings", "not_a_deletion", "still_parses")
    failed = F.lit(False)
    for name in names:
        failed = failed | (F.col(name) == "failed")
    return checks.withColumn("passed", ~failed)


def reindent_replacement(replacement: Column, original_first: Column) -> Column:
    """Shift a block to the indentation of the code it replaces; its inner shape is kept."""
    lines = F.split(replacement, "\n")
    first = F.get(F.filter(lines, lambda x: text.strip(x) != ""), F.lit(0))
    wanted = F.regexp_extract(original_first, r"(?U)^(\s*)", 1)
    got = F.regexp_extract(first, r"(?U)^(\s*)", 1)
    shifted = F.transform(
        lines,
        lambda x: F.when(text.strip(x) == "", F.lit(""))
        .when(F.startswith(x, got), F.concat(wanted, F.substr(x, F.length(got) + 1)))
        .otherwise(x),
    )
    same = first.isNull() | original_first.isNull() | (wanted == got)
    return F.when(same, replacement).otherwise(F.array_join(shifted, "\n"))

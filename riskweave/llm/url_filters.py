"""URL filters as a sort-merge range join over reversed-host keys.  DataFrame functions only.

A rule ``(host, path, verdict)`` fits a url whose host is the rule's or below it and whose path starts with
the rule's.  With the labels of a host reversed (``com.example.www.``) "below" is a prefix, and a prefix is
an interval of the sorted keys; intervals of prefixes nest or are disjoint.  So a sweep over rules and urls
in key order keeps a stack of open rules: at a url, the last rule before it holds at its boundary the chain
of rules it lies in (``chain``), and the open ones among them are those that still prefix the url's key.

Two sweeps: by host, which leaves for every url the rule hosts above it, then by path within each such host.
A sweep is range-partitioned, so a host or path with a third of all rows is spread over many ranges; what is
open where a range begins comes from one row per range (the last rule before it).  Sorted ranges are
written to the shared folder once, so range numbers and row numbers can't change when a task is run again.

The longest rule string (host, then path) wins; of equally long ones the longer host, then ``block``.  Where no
rule fits, the verdict is ``default``.

Defined results: a null url, or one without ``://``, has empty host and path and gets the default; an empty
table gives no rows; no rules give the default everywhere; repeated rows are each judged; only the key and
the url are read, so other columns can't clash.  Rules with null host or path count as empty; an empty rule
host fits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
CONTRACT_RULES = (
    ("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: Rows of a range, on average: what one task of a sweep sorts.
RANGE_ROWS = 200_000


def rule_table(spark: SparkSession, rules=CONTRACT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_key(host: Column) -> Column:
    """Labels from the top down, each closed by a dot: a host's key prefixes the keys below it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def nested(rules: DataFrame, group: Column, key: Column, ends: Column, extra: Column) -> DataFrame:
    """Per rule its stack when pushed: itself and the rules around it, longest key first.

    ``ends`` are the lengths at which a prefix of the key may be a rule.
    """
    own = rules.select(group.alias("g"), key.alias("k"), extra.alias("x")).groupBy("g", "k").agg(F.min("x").alias("x"))
    inner = own.select("g", "k", F.explode(ends).alias("end")).select("g", "k", F.expr("substr(k, 1, end)").alias("p"))
    around = inner.join(own.select("g", F.col("k").alias("p"), "x"), ["g", "p"])
    one = F.struct((-F.length("p")).alias("n"), F.col("p").alias("k"), F.col("x"))
    return around.groupBy("g", "k").agg(F.array_sort(F.collect_list(one)).alias("chain"))


def sweep(points: DataFrame, boundaries: DataFrame, rows: int) -> DataFrame:
    """Points ``(g, k, p)``, about ``rows``, with the rules open at them: ``chain``, longest first.

    Sorted by range; the chain open at the start of a range is that of the last boundary before it.
    """
    spark = points.sparkSession
    kind = points.schema["p"].dataType
    events = points.select("g", "k", F.lit(1).alias("kind"), "p", F.lit(None).cast(boundaries.schema["chain"].dataType).alias("chain"))
    events = events.unionByName(boundaries.select("g", "k", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("p"), "chain"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // RANGE_ROWS)
    salt = F.xxhash64("p")
    dealt = events.withColumn("salt", salt).repartitionByRange(ranges, "g", "k", "kind", "salt")
    sorted_ranges = materialise(dealt.withColumn("range", F.spark_partition_id()))
    order = ["g", "k", "kind"]
    mark = F.when(F.col("kind") == 0, F.struct("g", "k", "chain"))
    # One row per range: its size follows the number of ranges, not of rows.
    starts = sorted_ranges.groupBy("range").agg(F.max(mark).alias("last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = sorted_ranges.withColumn("open", F.last(mark, ignorenulls=True).over(within)).filter("kind = 1")
    swept = swept.join(starts, "range", "left").withColumn("open", F.coalesce("open", "carried"))
    chain = F.when(F.col("open.g") == F.col("g"), F.col("open.chain"))
    return swept.select("g", "k", "p", F.filter(chain, lambda r: F.startswith(F.col("k"), r["k"])).alias("chain"))


def judge(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row of ``pages``."""
    host, path = host_and_path(F.col(f"`{url}`"))
    urls = pages.select(F.col(f"`{key}`").alias("id"), host.alias("host"), path.alias("path"))
    urls = materialise(urls.withColumn("row", F.monotonically_increasing_id()))
    rows = urls.count()
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).filter("host <> ''")

    # First sweep: the rule hosts at or above each url's host.
    keyed = rules.select(host_key(F.col("host")).alias("hk"), "host").distinct()
    label_ends = F.expr("filter(sequence(1, length(k)), i -> substr(k, i, 1) = '.')")
    hosts = nested(keyed, F.lit(""), F.col("hk"), label_ends, F.col("host"))
    points = urls.select(F.lit("").alias("g"), host_key(F.col("host")).alias("k"), F.struct("row", "path").alias("p"))
    above = sweep(points, hosts, rows).select("p.row", "p.path", F.explode("chain").alias("h"))

    # Second sweep: within each such host, the rule paths that start the url's path.
    best = F.when(F.col("verdict") == BLOCK, F.lit(0)).otherwise(F.lit(1))
    paths = nested(rules, F.col("host"), F.col("path"), F.expr("sequence(0, length(k))"), F.struct(best.alias("o"), F.col("verdict")))
    points = above.select(F.col("h.x").alias("g"), F.col("path").alias("k"), F.struct("row").alias("p"))
    fits = sweep(points, paths, rows).withColumn("hit", F.get("chain", F.lit(0))).filter("hit is not null")
    fits = fits.select(
        "p.row",
        F.struct(
            (F.length("g") + F.length("hit.k")).alias("n"), F.length("g").alias("host_n"), (-F.col("hit.x.o")).alias("o"),
            F.concat("g", "hit.k").alias("rule"), F.col("hit.x.verdict").alias("verdict"),
        ).alias("fit"),
    )
    fits = fits.groupBy("row").agg(F.max("fit").alias("fit"))
    return urls.join(fits, "row", "left").select(
        F.col("id").alias(key), "host", "path", "fit.rule",
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
    )


RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in CONTRACT_RULES)
SQL = f"""
WITH rules(rh, rp, rv) AS (VALUES {RULE_ROWS}),
cut AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hit AS (SELECT r, arg_max(rh || rp, length(rh || rp) * 10000 + length(rh)) AS rule,
    arg_max(rv, length(rh || rp) * 10000 + length(rh)) AS rv
  FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(rv, '{ALLOW}') AS verdict FROM u LEFT JOIN hit USING (r)
"""

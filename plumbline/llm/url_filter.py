"""URL allow/block filter as a sort-merge range join with a sweep over nested rules.

A rule ``(host, path, verdict)`` fits its host and all subdomains, for urls whose path starts with the
rule's path. The canonical key of a host is its labels in reverse order (``www.example.com`` ->
``com.example.www.``), that of a rule or url at a host is the host's key, '/' and the path. "Host and its
subdomains" and "path and what it starts" are then prefixes, so intervals of keys in byte order, and two of them are
nested or apart.

The sweep sorts points and interval ends together. A start pushes a rule, an end pops one, so the running sum of the
two is the height of the stack, and the entry of the stack at a height is the last push at that height. It runs twice:
over hosts, where a host takes the whole stack of rule hosts above it, and over host-and-path keys, where a
url takes the top of the stack, the longest path, under each of these rule hosts. Of those the longest rule wins.

Scale: urls are reduced to distinct pairs of host and path first. The sweep runs in range buckets whose borders are
quantiles of a hash sample of points and rules; a hash behind each key lets borders divide even equal keys. A
rule is repeated in each bucket its interval reaches, so a bucket needs nothing of the others; no rules of
a host and no stack is ever gathered in a row.

Only DataFrame functions are used. Defined cases: a null url, or one without ``://``, has empty host and
path and fits no rule; an empty rule table leaves every url with the default verdict; rules with a null host or path,
or with '/', '?' or '#' in the host, fit nothing; repeated urls and repeated rows each keep their own row; equal rules
with both verdicts block; among fitting rules the longest ``host || path`` wins, then the longer host. All other
columns of the input are kept, whatever their names, except that columns named like a result (``host``, ``path``,
``rule``, ``verdict``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RESULTS = ("host", "path", "rule", "verdict")
MAX_BUCKETS = 4096
#: Bytes that no text has: the first ends a point's key, the second an interval, behind everything with its prefix.
POINT, END = b"\xfe", b"\xff"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def point_key(key: Column, *tie: str) -> Column:
    """The key as bytes, then 0xFE and a hash: inside the intervals of the key's prefixes, and of no other."""
    return F.concat(key.cast("binary"), F.lit(POINT), F.unhex(F.lpad(F.hex(F.xxhash64(*tie)), 16, "0")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def quantiles(keys: DataFrame, n: int) -> list[bytes]:
    """Borders (n - 1 at most) that divide ``key`` evenly, from a sample of 16 n rows by hash."""
    sample = keys.orderBy(F.xxhash64("key"), "key").limit(16 * n)
    ranked = sample.select("key", F.ntile(n).over(Window.orderBy("key")).alias("n")).groupBy("n").agg(F.min("key").alias("key")).where("n > 1")
    return sorted({bytes(r["key"]) for r in ranked.collect()})


def bucket_of(key: Column, borders: list[bytes]) -> Column:
    """The number of borders up to ``key``: a search among every 64th border, then among the 64 behind it."""
    if not borders:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    literal = lambda some: F.array(*[F.lit(b) for b in some])
    block = F.greatest(below(literal(borders[::64])), F.lit(1))
    inside = F.get(F.array(*[literal(borders[i : i + 64]) for i in range(0, len(borders), 64)]), block - 1)
    return (64 * (block - 1) + below(inside)).cast("int")


def sweep(points: DataFrame, intervals: DataFrame, whole: bool, buckets: int | None = None) -> DataFrame:
    """Rows ``(point, rule)``: the rules on the stack at each point, all of them or the top only.

    ``points``: key (of :func:`point_key`), point. ``intervals``: start (bytes), rule; an interval holds what
    starts with ``start``. Points outside all intervals give no row.
    """
    buckets = buckets or min(MAX_BUCKETS, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    end = F.concat("start", F.lit(END))
    borders = quantiles(points.select("key").union(intervals.select("start")), buckets) if buckets > 1 else []
    first, last = bucket_of(F.col("start"), borders), bucket_of(end, borders)
    reached = intervals.select("start", "rule", end.alias("end"), first.alias("first"), last.alias("last")).withColumn("bucket", F.explode(F.sequence("first", "last")))
    opens = F.when(F.col("bucket") == F.col("first"), F.col("start")).otherwise(F.lit(b""))
    no_point, no_rule = F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.lit(None).cast(intervals.schema["rule"].dataType).alias("rule")
    events = (
        reached.where("bucket = last").select("bucket", F.col("end").alias("key"), F.lit(0).alias("kind"), "start", F.lit(-1).alias("step"), no_point, no_rule)
        .union(reached.select("bucket", opens, F.lit(1), "start", F.lit(1), no_point, "rule"))
        .union(points.select(bucket_of(F.col("key"), borders), "key", F.lit(2), F.lit(b""), F.lit(0), "point", no_rule))
    )
    order, so_far = ["key", "kind", "start"], (Window.unboundedPreceding, Window.currentRow)
    height = F.sum("step").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(*so_far)).cast("int")
    stacked = events.withColumn("height", height).where("height > 0 and kind > 0")
    if whole:
        levels = F.when(F.col("kind") == 2, F.sequence(F.lit(1), "height")).otherwise(F.array("height"))
        stacked = stacked.withColumn("height", F.explode(levels))
    entry = F.last("rule", ignorenulls=True).over(Window.partitionBy("bucket", "height").orderBy(*order).rowsBetween(*so_far))
    return stacked.select("kind", "point", entry.alias("rule")).where("kind = 2").drop("kind")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    kept = [c for c in pages.columns if c.lower() not in RESULTS]
    packed = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__kept")
    parsed = pages.select(packed, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    clean = (
        rules.where("host is not null and path is not null and not rlike(host, '[/?#]')")
        .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path")
        .agg(F.max(F.lower("verdict")).alias("verdict"))  # 'block' is greater than 'allow'
        .withColumn("node", host_key(F.col("host")))
    )
    pairs = materialize(parsed.where("host <> ''").select("host", "path").distinct(), "url-pairs")
    hosts = pairs.select("host").distinct().select(point_key(host_key(F.col("host")), "host").alias("key"), F.col("host").alias("point"))
    above = sweep(hosts, clean.select(F.col("node").cast("binary").alias("start"), F.col("node").alias("rule")).distinct(), True)
    under = pairs.join(above.select(F.col("point").alias("host"), F.col("rule").alias("node")), "host")
    urls = under.select(point_key(F.concat("node", F.lit("/"), "path"), "host", "path").alias("key"), F.struct("host", "path").alias("point"))
    ranked = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict")
    best = sweep(urls, clean.select(F.concat("node", F.lit("/"), "path").cast("binary").alias("start"), ranked.alias("rule")), False)
    chosen = best.groupBy("point.host", "point.path").agg(F.max("rule").alias("__best"))
    return parsed.join(chosen, ["host", "path"], "left").select(*[F.col(f"__kept.`{c}`") for c in kept], "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                               ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parsed AS (
  SELECT page_id, row_number() OVER () AS n,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT n, h || p AS rule, v, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM parsed LEFT JOIN best ON best.n = parsed.n AND k = 1
"""


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")

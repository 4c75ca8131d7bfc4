"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's path;
the longest rule wins, at equal length the block, then the rule first in order. Each url is expanded only into
host suffixes with as many labels, and path prefixes with as many characters, as some rule has. Expressions
meet rules by equality of the first PREFIX hex digits of SHA-256; the full digests then confirm.

Edge cases: null url or no "://" gives an empty host and path and no rule; repeated rows and null ids give a
row each; an empty table or an empty rule list works; extra columns are ignored. All DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitweft.session import pick, table

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

PREFIX = 8

#: More rules than this are joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + F.lit(3), F.char_length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + F.lit(3), F.char_length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All host-suffix and path-prefix pairs of a url that a rule could have, as an array of strings."""
    n = F.size(F.split(host, r"\.", -1))
    hosts = F.filter(F.array(*[F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels]), lambda x: x.isNotNull())
    paths = F.filter(F.array(*[F.when(F.char_length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row per page: id, host, path, rule (null if none fits) and verdict (the rule's, else `default`)."""
    spark = pages.sparkSession
    rules = RULES if rules is None else rules
    p = pick(pages, id=id_col, url=url_col)
    url = F.coalesce(F.col("url"), F.lit(""))
    p = p.select("id", host_of(url).alias("host"), path_of(url).alias("path"))
    if not rules:
        return p.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(x) for _, _, x in rules})
    known = spark.createDataFrame([(h + x, v, i) for i, (v, h, x) in enumerate(rules)], "rule string, says string, place int")
    full = F.sha2("rule", 256)
    known = known.select(full.alias("digest"), F.substring(full, 1, PREFIX).alias("short"), "rule", "says", (-F.col("place")).alias("order"), (F.col("says") == "block").alias("strict"))
    known = F.broadcast(known) if len(rules) <= BROADCAST_RULES else known
    row = p.withColumn("row", F.monotonically_increasing_id())  # the scan's partition and place: the same on a retry
    each = row.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("e")).withColumn("d", F.sha2("e", 256))
    met = each.join(known, F.substring("d", 1, PREFIX) == F.col("short"), "left")
    fits = (F.col("d") == F.col("digest")) & (F.col("e") == F.col("rule"))
    best = F.max(F.when(fits, F.struct(F.char_length("rule").alias("n"), "strict", "order", "rule", "says")))
    out = met.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.says", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


SQL = """
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM u),
rules(verdict, h, x, place) AS (VALUES ('allow','org','/',0), ('block','example.org','/es/',1), ('block','example.org','/en/1',2), ('allow','com','/fr/',3), ('block','com','/de/',4)),
m AS (SELECT r, h || x AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || x) DESC, verdict DESC, place) AS k
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x))
SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.r = p.r AND m.k = 1
"""

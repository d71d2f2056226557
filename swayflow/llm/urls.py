"""URL filters: host-suffix and path-prefix expressions, hash-prefix join, digest check, precedence.

A URL is expanded into the host suffixes and path prefixes that have the shape (labels of the host,
length of the path) of some rule. The expressions meet the rules by the first four bytes of their
digests; then the full digests, hosts and paths are compared, and the longest rule wins. While the
rules are few, they are one row, an array of small maps from short hash to rules, in which each page
looks up its own expressions: no page is exploded, shuffled or grouped. Beyond that the row would
be carried with every page, so the expressions of all distinct URLs are joined to the rules by short
hash: by broadcast while these are few enough for it, else by shuffle with salted copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, load

#: Fixed values of the contract: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Rules up to this many are carried with the pages, up to this many broadcast.
CARRIED_RULES, BROADCAST_RULES = 64, 200_000
SALTS = 16
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url):
    """Host and path columns of a url; both empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    path = F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)
    return F.coalesce(F.translate(host, *LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def digest_of(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def short_of(digest):
    return F.substring(digest, 1, 8)


def rank_of(host, path):
    """Longest first, then the longer host."""
    return F.struct(F.length(host) + F.length(path), F.length(host))


def expressions(host, path, shapes):
    """Array of h, p, digest: the host suffixes and path prefixes of a URL that have one of the shapes."""
    labels = F.split(host, r"\.")
    fit = F.filter(shapes, lambda s: (s["labels"] <= F.size(labels)) & (s["chars"] <= F.length(path)))
    made = F.transform(fit, lambda s: F.struct(F.array_join(F.slice(labels, F.size(labels) - s["labels"] + 1, s["labels"]), ".").alias("h"), F.substring(path, F.lit(1), s["chars"]).alias("p")))
    return F.transform(made, lambda e: F.struct(e["h"].alias("h"), e["p"].alias("p"), digest_of(e["h"], e["p"]).alias("digest")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", carried_rules: int = CARRIED_RULES, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`; columns of these names are replaced, all others stay.

    rules: host, path, verdict; rows with a null are no rules, of rules for the same host and path
    block wins. The longest rule (host plus path) wins, then the longer host. Null urls, and urls no
    rule fits, get the default. Repeated rows are kept and judged alike; long urls make no more
    expressions than rules have shapes. An empty table gives none.
    """
    rules = rules.select(F.translate("host", *LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).where("h is not null and p is not null and v is not null")
    rules = rules.groupBy("h", "p").agg(F.max("v").alias("v")).withColumn("digest", digest_of(F.col("h"), F.col("p")))  # block > allow
    shape = F.struct(F.size(F.split("h", r"\.")).alias("labels"), F.length("p").alias("chars"))
    shapes = rules.agg(F.collect_set(shape).alias("shapes"))  # one row
    n = rules.limit(max(carried_rules, broadcast_rules) + 1).count()
    host, path = url_parts(F.col(url))
    own, best, table = fresh(pages, "_url", "_best", "_rules")
    out = pages.withColumns({"host": host, "path": path})
    if n <= carried_rules:
        size = max(16, n)
        maps = rules.groupBy(short_of(F.col("digest")).alias("short")).agg(F.collect_list(F.struct("h", "p", "v", "digest")).alias("of"))
        maps = maps.groupBy(F.pmod(F.xxhash64("short"), F.lit(size)).alias("k")).agg(F.collect_list(F.struct("short", "of")).alias("m"))
        every = pages.sparkSession.range(size).withColumnRenamed("id", "k").join(maps, "k", "left")
        one = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: F.map_from_entries(x["m"])).alias("maps")).crossJoin(shapes).select(F.struct("maps", "shapes").alias(table))
        out = out.crossJoin(F.broadcast(one))  # one row of at most CARRIED_RULES rules

        def rules_of(e):
            short = short_of(e["digest"])
            near = F.try_element_at(F.get(F.col(f"{table}.maps"), F.pmod(F.xxhash64(short), F.lit(size)).cast("int")), short)
            return F.filter(near, lambda r: (r["digest"] == e["digest"]) & (r["h"] == e["h"]) & (r["p"] == e["p"]))

        hits = F.flatten(F.filter(F.transform(expressions(F.col("host"), F.col("path"), F.col(f"{table}.shapes")), rules_of), lambda x: x.isNotNull()))
        ranked = F.transform(hits, lambda r: F.struct(rank_of(r["h"], r["p"]).alias("rank"), r.alias("r")))
        out = out.withColumn(best, F.when(F.col(url).isNotNull(), F.array_max(ranked)["r"]))
    else:
        urls = pages.select(F.col(url).alias("url")).where("url is not null").groupBy("url").count()
        of_url = url_parts(F.col("url"))
        asked = urls.select("url", of_url[0].alias("host"), of_url[1].alias("path")).crossJoin(F.broadcast(shapes))
        asked = asked.select("url", F.explode(expressions(F.col("host"), F.col("path"), F.col("shapes"))).alias("e")).select("url", F.col("e.h").alias("eh"), F.col("e.p").alias("ep"), F.col("e.digest").alias("full"))
        asked, known = asked.withColumn("short", short_of(F.col("full"))), rules.withColumn("short", short_of(F.col("digest")))
        if n <= broadcast_rules:
            met = asked.join(F.broadcast(known), "short")
        else:
            known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
            met = asked.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS))).join(known, ["short", "salt"])
        hits = met.where("full = digest AND eh = h AND ep = p")
        found = hits.groupBy("url").agg(F.max_by(F.struct("h", "p", "v"), rank_of(F.col("h"), F.col("p"))).alias(best)).withColumnRenamed("url", own)
        out = out.join(found, F.col(url) == F.col(own), "left").drop(own)
    out = out.withColumns({"rule": F.concat(F.col(f"{best}.h"), F.col(f"{best}.p")), "verdict": F.coalesce(F.col(f"{best}.v"), F.lit(default))})
    return out.drop(best, table)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT inline(array(" + ", ".join(f"struct('{h}' AS host, '{p}' AS path, '{v}' AS verdict)" for h, p, v in RULES) + "))")
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rh, rp, rv) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), h AS (
  SELECT page_id, host, path, rh, rp, rv,
         row_number() OVER (PARTITION BY page_id ORDER BY (rh IS NULL), length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM h WHERE k = 1
"""

"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path. It fits a URL whose host is the entry's or
a subdomain of it and whose path starts with the entry's; the longest wins.
Every URL is expanded to the keys that could be listed (each host suffix with
each path prefix of a length that occurs in the list). A blocked Bloom filter
of 64-bit words, held as one array literal whose size follows from the list and
is checked, passes on the keys that may be listed, and a hash join on the
canonical key removes the false positives. URLs without a possible hit are not
shuffled. All of it is DataFrame expressions.

Defined results: a null URL, or one without "://", has an empty host and path
and meets no entry; empty tables give no rows; repeated rows are judged each;
further input columns are left out of the result whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latentia.llm.tables import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words of the filter that are shipped inside the plan (2 MiB); above it the filter is joined as a table.
LITERAL_WORDS = 1 << 18


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: after the first "://", up to the first of / ? #, and from there up to ? or #."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    return pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumns(
        {
            "host": F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
        }
    ).drop("_rest")


class BlockedBloom:
    """Words of 64 bits; each key sets `bits` bits of the one word that its hash names."""

    def __init__(self, n_keys: int, per_key: int = 16, bits: int = 4):
        self.n_words = 1
        while self.n_words * 64 < max(1, n_keys) * per_key:
            self.n_words *= 2
        self.bits = bits

    def word(self, key: Column) -> Column:
        return F.xxhash64(key, F.lit("word")).bitwiseAND(F.lit(self.n_words - 1)).cast("int")

    def mask(self, key: Column) -> Column:
        h = F.xxhash64(key, F.lit("mask"))
        out = F.lit(0).cast("long")
        for i in range(self.bits):
            bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        return out

    def table(self, keys: DataFrame, key: str) -> DataFrame:
        return keys.groupBy(self.word(F.col(key)).alias("word")).agg(F.bit_or(self.mask(F.col(key))).alias("mask"))


def canonical_key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(" "), path)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", literal_words: int = LITERAL_WORDS) -> DataFrame:
    """pages with host, path, and list_host, list_path, list_verdict, list_kind of the longest listed entry that fits (null: none).

    listed: host, path, verdict, kind. An entry given twice counts once, the least verdict and kind.
    """
    listed = listed.where("host is not null and path is not null").groupBy("host", "path").agg(F.min(F.struct("verdict", "kind")).alias("v"))
    listed = listed.select(F.col("host").alias("list_host"), F.col("path").alias("list_path"), F.col("v.verdict").alias("list_verdict"), F.col("v.kind").alias("list_kind"), canonical_key(F.col("host"), F.col("path")).alias("list_key"))
    lengths = sorted(r[0] for r in listed.select(F.length("list_path")).distinct().collect())  # as many as the longest path at most
    bloom = BlockedBloom(listed.count())
    rows = with_host_and_path(pages, url).withColumn("_row", F.monotonically_increasing_id())

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    fitting = F.filter(F.from_json(F.lit(str(lengths)), "array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = rows.withColumn("_labels", labels).withColumns({"_suffixes": suffixes, "_prefixes": prefixes})
    keys = keys.withColumn("_keys", F.flatten(F.transform("_suffixes", lambda s: F.transform("_prefixes", lambda p: canonical_key(s, p))))).drop("_labels", "_suffixes", "_prefixes")
    if bloom.n_words <= literal_words:
        filled = [0] * bloom.n_words
        for word, mask in bloom.table(listed, "list_key").collect():
            filled[word] = mask
        words = F.array(*[F.lit(x).cast("long") for x in filled]) if bloom.n_words <= 64 else F.from_json(F.lit(str(filled)), "array<bigint>")
        keys = keys.withColumn("_words", words)
        passed = F.filter("_keys", lambda k: F.get("_words", bloom.word(k)).bitwiseAND(bloom.mask(k)) == bloom.mask(k))
        judged = keys.withColumn("_hits", passed).drop("_words", "_keys")
        free = judged.where("size(_hits) = 0").drop("_hits", "_row")
        hits = judged.where("size(_hits) > 0").withColumn("_key", F.explode("_hits")).drop("_hits")
    else:
        free = None
        some = keys.withColumn("_key", F.explode_outer("_keys")).drop("_keys").withColumn("_word", bloom.word(F.col("_key")))
        table = bloom.table(listed, "list_key").select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
        ok = F.col("_mask").bitwiseAND(bloom.mask(F.col("_key"))) == bloom.mask(F.col("_key"))
        hits = some.join(table, "_word", "left").withColumn("_key", F.when(ok, F.col("_key"))).drop("_word", "_mask")
    found = hits.join(listed, F.col("_key") == F.col("list_key"), "left")
    rank = F.struct(F.length("list_host") + F.length("list_path"), F.length("list_host"))
    best = found.groupBy("_row").agg(
        *[F.first(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "_row"],
        F.max_by(F.struct("list_host", "list_path", "list_verdict", "list_kind"), F.when(F.col("list_key").isNotNull(), rank)).alias("_best"),
    )
    best = best.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_row"], "_best.*")
    return best if free is None else best.unionByName(free, allowMissingColumns=True)


#: The rules of the query, as host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Sites that are listed whole.
SITES = ["ads-track.example.org", "casino-win.example.org", "spam-farm.example.org"]


def listed_entries(spark: SparkSession) -> DataFrame:
    rows = [(h, p, v, "rule") for h, p, v in RULES] + [(h, "/", "block", "site") for h in SITES]
    return spark.createDataFrame(rows, "host string, path string, verdict string, kind string")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(pages, listed_entries(spark))
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("list_kind") == "rule", F.concat("list_host", "list_path")).alias("rule"),
        F.coalesce("list_verdict", F.lit("allow")).alias("verdict"),
    )


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))"


#: The longest first.
_ENTRIES = sorted([(h, p, v, True) for h, p, v in RULES] + [(h, "/", "block", False) for h in SITES], key=lambda e: (-len(e[0] + e[1]), -len(e[0])))
ORACLE_SQL = f"""
with parts as (
  select page_id, case when url is not null and position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest
  from pages
), split as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
)
select page_id, host, path,
       case {' '.join(f"when {_fits(h, p)} then {repr(h + p) if is_rule else 'null'}" for h, p, v, is_rule in _ENTRIES)} end as rule,
       case {' '.join(f"when {_fits(h, p)} then '{v}'" for h, p, v, _ in _ENTRIES)} else 'allow' end as verdict
from split
"""

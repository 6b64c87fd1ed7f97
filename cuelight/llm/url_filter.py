"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A listing is a canonical host and path, like ``example.com/en/``; it covers its host and all subdomains where the path
starts with its path, and the longest listing that covers a URL decides. Every distinct (host, path) is turned into the
listings that could cover it; the Bloom filter lets through the listed ones and a few others, and the hash join with
the listings removes those others. The filter is a table of blocks of eight 64-bit words with one bit per key in each
word. All steps are DataFrame operations.

The filter takes about 16 bits a listing. Up to BROADCAST_BYTES of filter, counted before the job, each executor gets a
copy; beyond it the filter is joined by block number like any large table.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule; such rows, repeated rows and
null ids are kept one for one. Listings that come twice count once (the smaller verdict wins). Without listings every
URL gets the default verdict. Columns of the input beyond the key and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters whose case is folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a filter block and listings per block: 512 bits for at most 32 listings on average.
WORDS, KEYS_PER_BLOCK = 8, 32
#: A filter up to this size is copied to each executor.
BROADCAST_BYTES = 64 << 20


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _bit(key: Column, word: int) -> Column:
    """The key's bit in one word: six bits of a second hash for each word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(listings: DataFrame, blocks: int) -> DataFrame:
    """The filter's non-empty blocks: block and words w0 to w7, by one aggregation."""
    return listings.groupBy(_block(F.col("listing"), blocks).alias("block")).agg(*[F.bit_or(_bit(F.col("listing"), i)).alias(f"w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, listings: DataFrame, count: int) -> DataFrame:
    """Rows of ``candidates`` (column listing) that the filter of ``listings`` lets through."""
    blocks = max(1, -(-count // KEYS_PER_BLOCK))
    bloom = bloom_filter(listings, blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    passed = None
    for i in range(WORDS):
        here = F.col(f"w{i}").bitwiseAND(_bit(F.col("listing"), i)) != 0
        passed = here if passed is None else passed & here
    return candidates.withColumn("block", _block(F.col("listing"), blocks)).join(bloom, "block").filter(passed).select(candidates.columns)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Each row's key, host, path, rule and verdict. ``rules`` has host, path and verdict."""
    parts = F.size(F.split(F.col("host"), r"\.", -1))
    listings = rules.select(F.concat(F.translate(F.col("host"), UPPER, LOWER), F.col("path")).alias("listing"), F.length("path").alias("cut"), parts.alias("parts"), "verdict").filter(F.col("listing").isNotNull())
    listings = listings.groupBy("listing").agg(F.min("verdict").alias("verdict"), F.min("cut").alias("cut"), F.max("parts").alias("parts"))
    # Three things bound what follows: how many listings there are, the distinct path lengths, at most the longest path's, and the most parts of a listed host.
    found = listings.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("cut")).alias("cuts"), F.max("parts").alias("parts")).first()
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not found.n:
        return rows.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    places = rows.select("host", "path").filter(F.col("host") != "").distinct()
    labels = F.split("host", r"\.", -1)
    # Suffixes with more parts than any listed host can't be listed.
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), count - found.parts + 1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    cuts = F.filter(F.from_json(F.lit(str(list(found.cuts))), "array<int>"), lambda c: c <= F.length("path"))
    starts = F.transform(cuts, lambda c: F.substring(F.col("path"), F.lit(1), c))
    covers = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    candidates = places.select("host", "path", F.explode(F.array_distinct(covers)).alias("listing"))

    hits = possible_hits(candidates, listings, found.n)
    exact = hits.join(listings.select("listing", "verdict"), "listing")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct("listing", "verdict"), F.struct(F.length("listing"), "listing")).alias("best"))
    # Rows without a host, however many, meet nothing and aren't shuffled to one place.
    judged = rows.filter("host <> ''").join(best, ["host", "path"], "left").unionByName(rows.filter("host = ''"), allowMissingColumns=True)
    return judged.select(F.col("key").alias(key), "host", "path", F.col("best.listing").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

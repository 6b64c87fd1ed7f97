"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Every common word (anchor) of a text opens a chain of the next CHAIN content words within SPAN words; the set of chain
hashes is the document's signature set, and its sorted form in hexadecimal is the fingerprint. Texts with few anchors also get a
chain at every word, and texts without words the hash of the text, so that each text has a fingerprint and equal texts
have equal ones. Two fingerprints are as alike as the Jaccard similarity of their sets; sets whose sizes already rule out a
wanted similarity are not intersected.

``similar_pairs`` finds all pairs at a similarity: equal sets form one class; classes are put into partitions by set
length so that only neighbouring ones can match, and meet there on the rarest signatures of each set (a set that
reaches the threshold shares one of its first n - ceil(t n) + 1), which the sizes prune before sets are intersected.

Everything is DataFrame operations. Defined results: a null text is the empty text; documents follow each other by
ascending id (ties by the text's hash, null ids first) and the first follows the last; repeated rows are documents of
their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.store import Scratch

#: Content words of a chain, words it may reach over, and anchor chains below which every word opens a chain.
CHAIN, SPAN, FEW = 2, 8, 8
#: Common words of the corpus' languages.
ANCHORS = (
    "a an the and or of to in on at by for from with is are was be been as it that this these those which not but have has had he she they we you i "
    "der die das den dem des ein eine einen einem einer und oder in im an am auf aus bei mit nach von vom zu zum zur für ist sind war als auch nicht sich es er sie wir ihr "
    "le la les l un une des du de et ou à au aux en dans par pour sur avec est sont était que qui ne pas ce cette ces il elle ils nous vous se "
    "el los las una unos unas del y o al con por para es son era lo su sus se no como más"
).split()
#: Rows of a run of documents that are put in order together, and runs that quantiles tell apart.
RUN, QUANTILES = 500, 256


def _is_anchor(word: Column) -> Column:
    return word.isin(*sorted(set(ANCHORS)))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted signature set of the column ``text`` as ``out`` (array<long>, 32-bit values)."""
    words, chains = f"{out}_words", f"{out}_chains"
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    def chain(w: Column, i: Column) -> Column:
        after = F.slice(F.filter(F.slice(F.col(words), i + 2, F.lit(SPAN)), lambda x: ~_is_anchor(x)), 1, CHAIN)
        return F.when(_is_anchor(w), F.struct(w.alias("w"), after.alias("after")))

    found = F.filter(F.transform(words, chain), lambda c: F.size(c["after"]) == CHAIN)
    hashed = F.transform(found, lambda c: F.xxhash64(c["w"], c["after"]))
    df = df.withColumn(chains, F.when(F.size(words) > 0, hashed).otherwise(F.array(F.xxhash64(F.coalesce(F.col(text), F.lit(""))))))
    at_each = F.transform(words, lambda w, i: F.xxhash64(F.lit("each"), F.slice(F.col(words), i + 1, F.lit(CHAIN + 1))))
    every = F.when((F.size(chains) < FEW) & (F.size(words) > 0), F.concat(chains, at_each)).otherwise(F.col(chains))
    short = F.transform(every, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn(out, F.array_sort(F.array_distinct(short))).drop(words, chains)


def fingerprint(signatures: Column) -> Column:
    """Eight hexadecimal digits for each signature, in ascending order."""
    return F.lower(F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where the sizes show that it is below ``at_least``."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    full = both / (F.size(a) + F.size(b) - both)
    if at_least <= 0:
        return full
    return F.when(F.least(F.size(a), F.size(b)) >= at_least * F.greatest(F.size(a), F.size(b)), full).otherwise(F.lit(0.0))


def with_next(df: DataFrame, key: str, columns: dict[str, str], derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``df`` with values of the next row by ascending ``key``, ties by ``_tie`` (a long): ``columns`` maps a new name to the column it is taken from.

    Rows are put into runs of about RUN rows: quantiles of the key cut it into at most QUANTILES parts, and equal steps
    cut each part further; rows without a key, and those of a key that fills a part alone, are cut by the tie. A window
    orders each run; the first rows of the runs close the gaps. ``derive`` adds columns that ``columns`` may name; it is
    applied to all rows and to the first rows of the runs, not to all rows twice.
    """
    stats = df.agg(F.count("*").alias("n"), F.count(key).alias("keyed"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    parts = max(1, min(QUANTILES, ceil(stats.n / RUN)))
    steps = max(1, ceil(stats.n / (parts * RUN)))
    raw = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e if parts > 1 else []
    raw = [int(e) for e in raw or []]
    edges = sorted(set(raw) | {e - 1 for e in raw if raw.count(e) > 1})  # a frequent key has a part of its own
    low, high = (int(stats.low), int(stats.high)) if stats.low is not None else (0, 0)
    starts, ends = [low, *[e + 1 for e in edges]], [*edges, max(high, low)]
    listed = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<bigint>")
    k = F.coalesce(F.col(key).cast("long"), F.lit(low))
    part = F.size(F.filter(listed(edges), lambda e: e < k)) if edges else F.lit(0)
    start, end = F.element_at(listed(starts), F.col("_part") + 1), F.element_at(listed(ends), F.col("_part") + 1)

    def by_tie(rows: int) -> Column:
        many = max(1, ceil(rows / RUN))
        return F.floor((F.col("_tie").cast("double") / F.lit(2.0**64) + 0.5) * many).cast("int")

    df = df.withColumn("_part", F.when(F.col(key).isNull(), -1).otherwise(part))
    step = F.floor((k - start).cast("double") * steps / (F.greatest(end - start, F.lit(0)) + 1)).cast("int")
    df = df.withColumn("_step", F.when(F.col("_part") < 0, by_tie(stats.n - stats.keyed)).when(start >= end, by_tie(stats.n)).otherwise(step))

    order = [F.col(key).asc_nulls_first(), F.col("_tie")]
    run = Window.partitionBy("_part", "_step").orderBy(*order)
    rows = derive(df).withColumns({f"_n_{n}": F.lead(F.struct(F.col(c).alias("v"))).over(run) for n, c in columns.items()})
    first = F.min_by(F.struct(*[c for c in df.columns if c not in ("_part", "_step")]), F.struct(F.col(key), F.col("_tie")))
    heads = derive(df.groupBy("_part", "_step").agg(first.alias("_head")).select("_part", "_step", "_head.*"))
    heads = heads.select("_part", "_step", F.struct(*[F.col(c).alias(n) for n, c in columns.items()]).alias("head"))
    # Runs of a part follow each other, and the first run of a part follows the last of the part before: few rows per part.
    heads = heads.withColumn("within", F.lead("head").over(Window.partitionBy("_part").orderBy("_step")))
    tops = heads.groupBy("_part").agg(F.min_by("head", "_step").alias("top"))
    ring = Window.orderBy("_part")
    tops = tops.withColumn("beyond", F.coalesce(F.lead("top").over(ring), F.first("top").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    follow = heads.join(tops.select("_part", "beyond"), "_part").select("_part", "_step", F.coalesce("within", "beyond").alias("_follow"))
    joined = rows.join(follow, ["_part", "_step"], "left")
    return joined.withColumns({n: F.when(F.col(f"_n_{n}").isNotNull(), F.col(f"_n_{n}.v")).otherwise(F.col(f"_follow.{n}")) for n in columns}).drop("_part", "_step", "_follow", *[f"_n_{n}" for n in columns])


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike either is to the text's and the next one's."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, "key", {"next_text": "text", "next_sigs": "sigs"}, lambda d: with_signatures(d, "text", "sigs")).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    rows = rows.select("key", "n", "sigs", "next_sigs", F.concat(F.substring("text", F.lit(1), F.col("n") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = with_signatures(rows, "edited", "edited_sigs")
    return rows.select(
        F.col("key").alias(key),
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each key's class (its smallest key with an equal set), and (a, b, likeness) between classes, a < b."""
    scratch = Scratch(docs.sparkSession, "spotsigs")
    rows = with_signatures(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "text", "sigs").filter("key is not null")
    rows = scratch.table(rows.select("key", "sigs", F.md5(fingerprint(F.col("sigs"))).alias("print")), "sets")
    classes = scratch.table(rows.groupBy("print").agg(F.min("key").alias("class")), "classes")
    members = rows.select("key", "print").join(classes, "print").select("key", "class")
    sets = scratch.table(rows.join(classes, "print").filter(F.col("key") == F.col("class")).dropDuplicates(["key"]).select("key", "sigs", F.size("sigs").alias("n")), "classes")
    each = sets.select("key", "n", F.explode("sigs").alias("sig"))
    rarity = scratch.table(each.groupBy("sig").agg(F.count("*").alias("seen")).filter("seen > 1"), "rarity")
    ranked = each.join(rarity, "sig", "left").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("seen", F.lit(1)).alias("seen"), "sig"))).alias("order"))
    prefix = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(threshold))).cast("int")
    keyed = scratch.table(ranked.select("key", "n", F.explode(prefix).alias("p"), part.alias("part")).filter("p.seen > 1").select("key", "n", F.col("p.sig").alias("sig"), "part"), "prefixes")
    near = keyed.withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    x, y = keyed.toDF("a", "na", "sig", "part"), near.toDF("b", "nb", "sig", "part")
    candidates = x.join(y, ["sig", "part"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    one, other = sets.select(F.col("key").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("key").alias("b"), F.col("sigs").alias("y"))
    pairs = candidates.join(one, "a").join(other, "b").withColumn("likeness", likeness(F.col("x"), F.col("y"))).filter(F.col("likeness") >= threshold - 1e-12)
    return members, pairs.select("a", "b", "likeness")

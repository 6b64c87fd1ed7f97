"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Documents are sets of word shingles. Bands of MinHash values give candidates; batches of the signatures of a candidate
pair are compared one after another, and the pair is dropped as soon as the posterior probability (uniform prior) that
its similarity reaches the threshold falls below MISS; what survives all batches is verified on the full sets. A pair
at similarity 0.8 shares no band with probability (1 - 0.8**5)**30 = 7e-6, and more similar pairs far less often.

No bucket is ever expanded into all of its pairs. Equal word sequences are one candidate. First every member of a bucket is
held against the bucket's smallest key, which joins nearly all copies. Then, in buckets that still hold several
components, only pairs across components are compared, as blocks of bounded size: small components meet as blocks of
signatures, and a large component meets everything that shares a bucket with it as blocks of signatures and sets, which
are verified there and give at most one link for a document and block. Every candidate pair is thus decided or already
connected, so components are those of all links.

Defined results: a text with fewer words than a shingle is one shingle; a null text or one without words has none and
is linked with nothing; rows without a key are linked with nothing and stay. Repeated rows are copies of each other.
Rows that share a key with different texts are one document to the links: each is compared by its own text, and what
either is linked with is in one group. Other columns are not read.

Inside, a text is named by a hash of its words (its node), so that signatures and sets are those of the text whatever
keys it comes with; keys come in at the end, where the smallest one names a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.components import components
from cuelight.llm.store import Scratch, in_worker, small_batches

#: Bands, values of a band, values compared at a time, and the probability at which a pair is given up.
BANDS, BAND, BATCH, MISS = 30, 5, 30, 1e-6
VALUES = BANDS * BAND
#: 16-bit words of a stored signature: a value each, and 32 bits of each band's hash.
WIDTH = VALUES + 2 * BANDS
#: Members above which a component is large, and documents and shingles of a block of sets; both sides of a meeting have such blocks.
LARGE, SET_BLOCK, SET_WORDS = 64, 64, 1 << 18
#: Shingles that a meeting of two blocks counts at a time.
CHUNK = 1 << 16
#: Signatures of a block, and keys up to which a list of keys is copied to each executor (8 MB).
BLOCK, BROADCAST_KEYS = 256, 1_000_000
#: Word hashes a worker keeps at most; others are computed again.
KNOWN_WORDS = 120_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.random.default_rng(20240501).integers(0, 2**63, VALUES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3 (a public-domain bit mixer)."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than space, tab and the line and page breaks up to 0x0D, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = h[: len(h) - width + 1].copy()
    for j in range(1, width):
        out = out * _ODD + h[j : len(h) - width + 1 + j]
    return np.unique(_mixed(out + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES minimum hashes of 32 bits."""
    low = np.full(VALUES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        low = np.minimum(low, ((shingles[at : at + 1024, None] * _FACTORS[None, :]) >> np.uint64(32)).min(0))
    return low


def band_hashes(low: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND):
        out = _mixed(out * _ODD + low[j::BAND])
    return out


def least_matches(percent: int) -> list[tuple[int, int]]:
    """(values compared, matches below which a pair is given up) for each batch.

    With m of n matches and a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and the
    probability that it reaches t is the sum over j <= m of C(n + 1, j) t**j (1 - t)**(n + 1 - j).
    """
    t, out = percent / 100, []
    for n in range(BATCH, VALUES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def _survive(a: np.ndarray, b: np.ndarray, tests: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the line pairs of ``a`` and ``b`` that no batch gives up."""
    at, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
    for n, least in tests:
        matches = matches + (a[at, seen:n] == b[at, seen:n]).sum(1)
        keep = matches >= least
        at, matches, seen = at[keep], matches[keep], n
    return at


def _node(words: list[bytes]) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """key, n_shingles, node (hash of the words), sig (values and bands, WIDTH words) and bands of (key, text) rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("near_dup", _HASHES.clear)
        for b in parts:
            sizes, copies, sigs, bands = [], [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                s = shingle_set(words, width)
                sizes.append(len(s))
                if len(s):
                    low = signature(s)
                    copies.append(_node(words))
                    hashes = band_hashes(low)
                    sigs.append(low.astype(np.uint16).tobytes() + hashes.astype(np.uint32).tobytes())
                    bands.append(hashes.view(np.int64))
                else:
                    copies.append(None)
                    sigs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(copies, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "n_shingles", "node", "sig", "bands"])

    return docs.mapInArrow(batches, "key long, n_shingles long, node long, sig binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """key (the node of the text) and shingles of (key, text) rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("near_dup", _HASHES.clear)
        for b in parts:
            for lo in range(0, b.num_rows, 64):
                some = [w for w in (words_of(t.as_py()) for t in b.column(1).slice(lo, 64)) if w]
                sets = [shingle_set(w, width).view(np.int64) for w in some]
                yield pa.RecordBatch.from_arrays([pa.array([_node(w) for w in some], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.mapInArrow(batches, "key long, shingles array<long>")


def _likely(pairs: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """(a, b) of the pairs (a, b, sig_a, sig_b) that the sequential test keeps."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, WIDTH) for i in (2, 3))
            keep = pa.array(_survive(x, y, tests))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(batches, "a long, b long")


def _across(blocks: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """(a, b) across components, of rows with two blocks: keys, components and signatures of each."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                x, y = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                kx, ky = (np.array([m["key"] for m in s], np.int64) for s in (x, y))
                cx, cy = (np.array([m["component"] for m in s], np.int64) for s in (x, y))
                sx, sy = (np.frombuffer(b"".join(m["sig"] for m in s), np.uint16).reshape(-1, WIDTH) for s in (x, y))
                bx, by = (np.ascontiguousarray(s[:, VALUES:]).view(np.uint32) for s in (sx, sy))
                # A pair comes out where it shares its first band: the bands that all of this bucket share tell which one this is.
                here = (bx == bx[0]).all(0) & (by == bx[0]).all(0)
                p, q = np.nonzero(cx[:, None] != cy[None, :])
                for lo in range(0, len(p), 1 << 16):
                    u, v = p[lo : lo + (1 << 16)], q[lo : lo + (1 << 16)]
                    first = here[(bx[u] == by[v]).argmax(1)]
                    u, v = u[first], v[first]
                    at = _survive(sx[u], sy[v], tests)
                    one, other = kx[u[at]], ky[v[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], ["a", "b"])

    return blocks.mapInArrow(batches, "a long, b long").distinct()


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, as products of 0/1 matrices."""
    flat = np.concatenate([*x, *y])
    if not len(flat):
        return np.zeros((len(x), len(y)), np.int64)
    at = np.unique(flat, return_inverse=True)[1]
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    order = np.argsort(at, kind="stable")
    at, owner, out, top = at[order], owner[order], np.zeros((len(x), len(y))), int(at.max()) + 1
    for lo in range(0, top, CHUNK):
        some = slice(*np.searchsorted(at, [lo, lo + CHUNK]))
        m = np.zeros((len(x) + len(y), min(CHUNK, top - lo)), np.float32)
        m[owner[some], at[some] - lo] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return np.rint(out).astype(np.int64)


def _against_large(meetings: DataFrame, tests: list[tuple[int, int]], percent: int) -> DataFrame:
    """(a, b) links of rows with a block of a large component and a block of documents near it; one per document and block."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for i in range(b.num_rows):
                x, y = b.column(0)[i].values, b.column(1)[i].values
                kx, ky = (s.field("key").to_numpy() for s in (x, y))
                sx, sy = (np.frombuffer(b"".join(s.field("sig").to_pylist()), np.uint16).reshape(-1, WIDTH) for s in (x, y))
                p, q = (v.ravel() for v in np.meshgrid(np.arange(len(kx)), np.arange(len(ky)), indexing="ij"))
                at = _survive(sx[p], sy[q], tests)
                if not len(at):
                    continue
                rows, cols = np.unique(p[at]), np.unique(q[at])
                # Only the sets of what the signatures leave are read.
                left, right = ([s.field("shingles")[int(r)].values.to_numpy() for r in some] for s, some in ((x, rows), (y, cols)))
                both = _shared(left, right)
                sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
                linked = 100 * both >= percent * (sizes - both)
                hit = np.flatnonzero(linked.any(0))
                one, other = ky[cols[hit]], kx[rows[linked[:, hit].argmax(0)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, other)), pa.array(np.minimum(one, other))], ["a", "b"])

    return meetings.mapInArrow(batches, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) whose full sets reach the threshold."""
    one, other = sets.select(F.col("key").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(one, "a").join(other, "b").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _labelled(docs: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: signed rows, and the name of the group of each node that is not alone."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    tests = least_matches(percent)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    signed = scratch.table(_signed(source, width), "signed")
    usable = signed.filter(F.col("key").isNotNull() & F.col("node").isNotNull())

    # One row stands for all copies of a text.
    copies = scratch.table(usable.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").select("node", "first"), "copies")
    firsts = usable.join(copies, "node", "left").filter(F.coalesce("first", "key") == F.col("key"))
    # Texts that share a key are linked by it.
    several_texts = usable.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a <> b").select("key", "b")
    same_key = scratch.table(usable.select("key", F.col("node").alias("a")).join(several_texts, "key").filter("a <> b").select("a", "b").distinct(), "same-key")
    banded = firsts.select(F.col("node").alias("key"), F.col("key").alias("row"), F.explode("bands").alias("bucket"))
    shared = scratch.table(banded.groupBy("bucket").agg(F.min("key").alias("pivot"), F.max("key").alias("last")).filter("pivot < last").select("bucket", "pivot"), "shared")
    members = scratch.table(banded.join(shared, "bucket").distinct(), "members")
    involved = members.select("key", "row").distinct()
    count = involved.count()
    if not count:
        labels = components(same_key, scratch)
    else:
        involved = scratch.table(involved, "involved")
        small_enough = (lambda t: F.broadcast(t)) if count <= BROADCAST_KEYS else (lambda t: t)
        nodes, rows_of = small_enough(involved.select(F.col("key").alias("node")).distinct()), small_enough(involved.select(F.col("row").alias("key")).distinct())
        members = members.drop("row")
        chosen = signed.filter("sig is not null").join(nodes, "node", "left_semi")
        sigs = scratch.table(chosen.groupBy(F.col("node").alias("key")).agg(F.min("sig").alias("sig"), F.min("n_shingles").alias("size")), "sigs")
        own_sets = _sets(source.filter("key is not null").join(rows_of, "key", "left_semi"), width)
        sets = scratch.table(own_sets.join(nodes.withColumnRenamed("node", "key"), "key", "left_semi"), "sets", compression="lz4")

        def signed_pairs(pairs: DataFrame) -> DataFrame:
            one = sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
            other = sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
            return pairs.join(one, "a").join(other, "b")

        stars = members.filter("key > pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
        links = scratch.table(_verified(_likely(signed_pairs(stars), tests), sets, percent), "links")
        first = components(links, scratch)

        named = members.select("bucket", "key").join(first, "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("component"))
        named = scratch.table(named, "named")
        several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        several = scratch.table(several.filter("low < high").select("bucket"), "several")
        people = scratch.table(named.select("component", "key").distinct(), "keys")
        sizes = people.join(sigs.select("key", "size"), "key").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
        sizes = scratch.table(sizes.filter(F.col("n") > LARGE), "large")
        mixed = scratch.table(named.join(several, "bucket", "left_semi").join(sizes, "component", "left"), "mixed")

        # Small components: blocks of the signatures of a bucket.
        small = scratch.table(mixed.filter("n is null").groupBy("bucket").agg(F.count("*").alias("few")).filter("few > 1"), "small")
        deal = F.pmod(F.xxhash64("key"), F.ceil(F.col("few") / BLOCK))
        dealt = mixed.filter("n is null").join(small, "bucket").select("bucket", deal.alias("part"), "key", "component")
        blocks = dealt.join(sigs.select("key", "sig"), "key").groupBy("bucket", "part").agg(F.collect_list(F.struct("key", "component", "sig")).alias("block"))
        blocks = scratch.table(blocks, "blocks")
        x, y = (blocks.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "block")]) for s in "xy")
        more = scratch.table(_across(x.join(y, "bucket").filter("part_x <= part_y").select("block_x", "block_y"), tests), "across")

        # Large components: their members and what shares a bucket with them; of two large ones the smaller name comes to the other.
        # A block of either side has about SET_BLOCK documents, and fewer where their sets hold more than SET_WORDS shingles.
        parts_of = lambda n, words: F.greatest(F.ceil(n / SET_BLOCK), F.ceil(words / SET_WORDS))
        hosts = scratch.table(mixed.filter("n is not null").select("bucket", F.col("component").alias("host"), parts_of(F.col("n"), F.col("words")).alias("host_parts")).distinct(), "hosts")
        guests = mixed.join(hosts, "bucket").filter("component <> host and (n is null or component < host)").select("host", "host_parts", "key").distinct()
        guests = scratch.table(guests.join(sigs.select("key", "size"), "key"), "guests")
        invited = guests.groupBy("host", "host_parts").agg(parts_of(F.count("*"), F.sum("size")).alias("guest_parts"))
        invited = scratch.table(invited, "invited")
        homes = people.join(invited, people["component"] == invited["host"]).select("host", "key", F.col("host_parts").alias("parts"))
        comers = guests.join(invited.select("host", "guest_parts"), "host").select("host", "key", F.col("guest_parts").alias("parts"))

        def set_blocks(rows: DataFrame, name: str) -> DataFrame:
            part = F.pmod(F.xxhash64("key"), F.col("parts"))
            full = rows.withColumn("part", part).join(sigs.select("key", "sig"), "key").join(sets.dropDuplicates(["key"]), "key")
            return scratch.table(full.groupBy("host", "part").agg(F.collect_list(F.struct("key", "sig", "shingles")).alias(name)).drop("part"), name)

        meetings = set_blocks(homes, "home_block").join(set_blocks(comers, "guest_block"), "host").select("home_block", "guest_block")
        final = links.unionByName(same_key).unionByName(_verified(more, sets, percent)).unionByName(_against_large(meetings, tests, percent))
        labels = components(final, scratch)
    # A group is named by the smallest key of its rows; a text that is linked with nothing and has no copy names itself.
    grouped = usable.join(labels.select(F.col("key").alias("node"), "component"), "node", "left").join(copies, "node", "left").filter("component is not null or first is not null")
    grouped = grouped.select("node", F.coalesce("component", "node").alias("component"), "key")
    names = grouped.groupBy("component").agg(F.min("key").alias("name"))
    named_nodes = grouped.select("node", "component").distinct().join(names, "component").select("node", "name")
    return signed, scratch.table(named_nodes, "names")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Each row's key, n_shingles, component_id (smallest key that links reach) and kept (whether the key is that one)."""
    with small_batches(docs.sparkSession):  # all that needs Python runs in here; what is returned joins stored tables
        signed, names = _labelled(docs, key, text, width, percent)
    labelled = signed.select("key", "n_shingles", "node").join(names, "node", "left")
    out = labelled.select(F.col("key").alias(key), "n_shingles", F.when(F.col("key").isNotNull(), F.coalesce("name", "key")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))

"""Language-model scores by a weighted backoff automaton over words, word pairs and word triples.

States are the root, the words and the word pairs that training has seen (and the start of a text). A state's arcs are
the n-grams that training has seen to follow it, each with its smoothed probability; its failure arc leads to the state
of its last word, or to the root, with the weight that the seen n-grams leave. The root has an arc for every word. A
text is scored by one traversal from left to right that carries the state: where the state has no arc for the next word,
failure arcs are followed and their weights added until one has; the next state is the longest suffix read that is one.

Probabilities are smoothed by interpolation: in a context seen c times, seen n-grams get the share W * c / (c + H) of
their relative frequency, and the failure arc the rest (WEIGHT, HALF by order; Jelinek-Mercer weights that grow with
the context's count). The root's arcs are the base model's probabilities.

The automaton of a large corpus fits no single machine. Texts are stored in blocks of about BLOCK tokens as numbers of
local words; each block counts its own n-grams and sends every distinct one once, packed by hash range, to the
range's reducer. The reducer adds up the training counts and answers each block with the counts of what it asked for, so
that every block builds exactly the part of the automaton that its texts can reach. Rows exchanged are at most the
distinct (block, n-gram) pairs, whatever the number of ranges; a frequent n-gram comes once from each block. Ranges and
the partitions they are dealt to grow with the tokens.

Counts cover all training texts; words are told apart by 64-bit hashes, pairs and triples by hashes whose length grows with
the tokens (BITS). Defined results: words are compared after A-Z
are lower-cased; a null text has only its end token; without training texts every probability is the base model's 1 / 1;
rows without an id are training texts; repeated rows are texts of their own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.labelled import crc_remainder
from cuelight.llm.store import Scratch, in_worker

#: Tokens of a block, tokens for each hash range, and ranges or blocks for each shuffle partition.
BLOCK, RANGE, PER_PARTITION = 1_000_000, 1_000_000, 4
#: The most that pairs and triples weigh against shorter n-grams, and the context counts that give them half of it.
WEIGHT, HALF = (0.35, 0.5), (2.0, 1.0)
#: Bits of a pair's or triple's hash beyond those that number the tokens: one in about 2**(BITS - 1) is taken for another, at any size.
BITS = 24
#: Hashes of the end of a text and of its start (as a context only).
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _planes(a: np.ndarray) -> bytes:
    """Numbers compressed byte by byte position, as their high bytes are alike."""
    size = a.dtype.itemsize
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T.tobytes())


def _unplaned(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b, max_output_size=1 << 31), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(hashes: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(b, np.uint64), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each, with those from 255 on behind them."""
    large = counts[counts >= 255].astype(np.uint64)
    body = np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_counts(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=1 << 31)
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], np.uint64).astype(np.int64)
    return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = (left * _ODD) ^ (right + (left >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Automaton:
    """The part of the backoff automaton that some texts can reach, over local numbers of words, pairs and triples.

    ``words``, ``pairs`` and ``triples`` are training counts by number; ``start`` is the number of training texts.
    ``link`` gives for each pair the numbers of its first (-1: the start of a text) and last word, ``chain`` for each
    triple those of its first pair and its last pair.
    """

    def __init__(self, words: np.ndarray, start: int, pairs: np.ndarray, triples: np.ndarray, link: tuple[np.ndarray, np.ndarray], chain: tuple[np.ndarray, np.ndarray], total: int, distinct: int):
        self.start = start
        root = (words + 0.5) / (total + 0.5 * (distinct + 1))
        first, last = link
        context = np.where(first < 0, start, words[first]) if len(words) else np.zeros(0)
        share = self._share(context, 0)
        pair = share * pairs / np.maximum(context, 1) + (1 - share) * root[last]
        before, after = chain
        share = self._share(pairs[before], 1)
        triple = share * triples / np.maximum(pairs[before], 1) + (1 - share) * pair[after]
        #: By order of the state: log10 weights of the arcs (NaN: no arc) and of the failure arcs, by the number of the state's n-gram.
        self.root = np.log10(root)
        self.pair_arc = np.where(pairs > 0, np.log10(np.maximum(pair, 1e-300)), np.nan)
        self.triple_arc = np.where(triples > 0, np.log10(np.maximum(triple, 1e-300)), np.nan)
        self.word_fails = np.log10(1 - self._share(words, 0))
        self.pair_fails = np.log10(1 - self._share(pairs, 1))
        self.start_fails = float(np.log10(1 - self._share(np.array([start]), 0))[0])
        self.is_word, self.is_pair = words > 0, pairs > 0

    @staticmethod
    def _share(count: np.ndarray, order: int) -> np.ndarray:
        return WEIGHT[order] * count / (count + HALF[order])

    def score(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> float:
        """log10 probability of one text: its words, the pair that ends at each, and the triple (none at the first)."""
        order = 1 if self.start else 0  # the state's length; a text begins in the state of its start
        fails, above, total = self.start_fails, 0.0, 0.0  # failure weights of the state, and of its last word's
        steps = zip(self.root[words].tolist(), self.pair_arc[pairs].tolist(), self.triple_arc[triples].tolist(), self.word_fails[words].tolist(), self.pair_fails[pairs].tolist(), self.is_word[words].tolist(), self.is_pair[pairs].tolist(), strict=True)
        for root, pair, triple, word_fails, pair_fails, is_word, is_pair in steps:
            if order == 2:
                if triple == triple:
                    total += triple
                elif pair == pair:
                    total += fails + pair
                else:
                    total += fails + above + root
            elif order == 1:
                total += pair if pair == pair else fails + root
            else:
                total += root
            if is_pair:
                order, fails, above = 2, pair_fails, word_fails
            elif is_word:
                order, fails = 1, word_fails
            else:
                order = 0
        return total


class _Words(dict):
    """Hashes of words, kept for one block."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, docs, tokens, payload ...) rows of (key, text, held) rows."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        keys, held, sizes, hashes, count, known = [], [], [], [], 0, _Words()

        def block() -> pa.RecordBatch:
            nonlocal made, count
            made += 1
            flat = np.concatenate(hashes)
            vocabulary, words = np.unique(flat, return_inverse=True)
            train = ~np.repeat(np.array(held, bool), sizes)
            one = {"block": base + made, "keys": np.array([k or 0 for k in keys], np.int64).tobytes(), "nulls": np.array([k is None for k in keys], bool).tobytes(), "held": np.array(held, bool).tobytes(), "sizes": np.array(sizes, np.int64).tobytes(), "train": int(train.sum()), "texts": int(len(held) - sum(held)), "tokens": len(flat), "vocabulary": pack_sorted(vocabulary), "words": _planes(words.astype(np.uint32))}
            for x in (keys, held, sizes, hashes):
                x.clear()
            known.clear()
            count = 0
            return pa.RecordBatch.from_pydict({k: [v] for k, v in one.items()})

        for b in parts:
            for k, t, h in zip(*b.columns, strict=True):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                a = np.empty(len(words) + 1, np.uint64)
                a[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                a[-1] = END
                keys.append(k.as_py())
                held.append(bool(h.as_py()))
                sizes.append(len(a))
                hashes.append(a)
                count += len(a)
                if count >= BLOCK:
                    yield block()
        if hashes:
            yield block()

    return docs.mapInArrow(batches, "block long, keys binary, nulls binary, held binary, sizes binary, train long, texts long, tokens long, vocabulary binary, words binary")


@dataclass
class _Block:
    """A stored block and its distinct n-grams, which are the same whenever they are computed."""

    sizes: np.ndarray
    held: np.ndarray
    vocabulary: np.ndarray
    words: np.ndarray

    @staticmethod
    def of(sizes: bytes, held: bytes, vocabulary: bytes, words: bytes) -> _Block:
        return _Block(np.frombuffer(sizes, np.int64), np.frombuffer(held, bool), unpack_sorted(vocabulary), _unplaned(words, np.uint32))

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def pairs(self, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of the pairs, without their last ``shift`` bits, and the number of the one that ends at each token."""
        here = self.vocabulary[self.words]
        left = np.empty_like(here)
        left[1:] = here[:-1]
        left[self.starts()] = START
        return _numbered(pair_hash(left, here) >> np.uint64(shift))

    def triples(self, pairs: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``pairs``, of the triples; 0 at a text's first token."""
        inner = np.ones(len(at), bool)
        inner[self.starts()] = False
        here = np.flatnonzero(inner)
        found, number = _numbered(pair_hash(pairs[at[here - 1]], self.vocabulary[self.words[here]] ^ _ODD) >> np.uint64(shift))
        out = np.zeros(len(at), np.uint32)
        out[here] = number
        return found, out

    def trains(self) -> np.ndarray:
        return ~np.repeat(self.held, self.sizes)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the number of each one's."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(ordered), np.uint32)
    number[order] = (np.cumsum(new) - 1).astype(np.uint32)
    return ordered[new], number


def _edges(sorted_hashes: np.ndarray, ranges: int, shift: int) -> np.ndarray:
    """Where each hash range begins in sorted hashes of 64 - ``shift`` bits, and the end."""
    starts = np.array([(r << (64 - shift)) // ranges for r in range(ranges)], np.uint64)
    return np.append(np.searchsorted(sorted_hashes, starts, side="left"), len(sorted_hashes))


_ASKED = "kind int, part int, block long, hashes binary, counts binary"
_ANSWER = "block long, kind int, part int, fresh long, counts binary"


def _asked(stored: DataFrame, ranges: int, shift: int) -> DataFrame:
    """What each block asks of each hash range: its words (kind 0), pairs (1) and triples (2) with its own training counts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("lm")
        for b in parts:
            for row in b.to_pylist():
                block = _Block.of(row["sizes"], row["held"], row["vocabulary"], row["words"])
                train = block.trains()
                inner = train.copy()
                inner[block.starts()] = False

                def asks(kind: int, hashes: np.ndarray, index: np.ndarray, own=row["block"]) -> pa.RecordBatch:
                    counts = np.bincount(index, minlength=len(hashes))
                    edge = _edges(hashes, ranges, shift if kind else 0)
                    some = [r for r in range(ranges) if edge[r] < edge[r + 1]]
                    parts_of = lambda pack, a: pa.array([pack(a[edge[r] : edge[r + 1]]) for r in some], pa.binary())
                    return pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array([own] * len(some), pa.int64()), parts_of(pack_sorted, hashes), parts_of(pack_counts, counts)], ["kind", "part", "block", "hashes", "counts"])

                yield asks(0, block.vocabulary, block.words[train])
                pairs, at = block.pairs(shift)
                yield asks(1, pairs, at[train])
                triples, at = block.triples(pairs, at, shift)
                yield asks(2, triples, at[inner])

    return stored.select("block", "sizes", "held", "vocabulary", "words").mapInArrow(batches, _ASKED)


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """One hash range: total training counts, sent back to each block in the order of its question."""
    hashes = [unpack_sorted(h) for h in group["hashes"]]
    cuts = np.cumsum([0, *map(len, hashes)])
    distinct, at = _numbered(np.concatenate(hashes))
    total = np.bincount(at, np.concatenate([unpack_counts(c) for c in group["counts"]]), len(distinct)).astype(np.int64)
    answers = [pack_counts(total[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    fresh = [int((total > 0).sum())] + [0] * (len(group) - 1)
    return pd.DataFrame({"block": group["block"].to_numpy(), "kind": group["kind"].to_numpy(), "part": group["part"].to_numpy(), "fresh": fresh, "counts": answers})


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", by: int = 5, held: int = 1) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    scratch = Scratch(docs.sparkSession, "lm")
    out_of = F.coalesce(crc_remainder(F.col(key), by) == held, F.lit(False))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), out_of.alias("held"))
    stored = scratch.table(_blocks(rows), "blocks")
    sizes = stored.agg(F.sum("tokens").alias("tokens"), F.sum("train").alias("train"), F.sum("texts").alias("texts")).first()
    total, texts = int(sizes.train or 0), int(sizes.texts or 0)
    ranges = max(16, -(-int(sizes.tokens or 0) // RANGE))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * ranges // PER_PARTITION))
    shift = max(0, 64 - BITS - int(sizes.tokens or 0).bit_length())
    dealt = _asked(stored, ranges, shift).repartition(partitions, "kind", "part")
    answers = scratch.table(dealt.groupBy("kind", "part").applyInPandas(_answered, _ANSWER), "answers")
    distinct = int(answers.filter("kind = 0").agg(F.sum("fresh")).first()[0] or 0)

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["kind"] < 0].iloc[0]
        block = _Block.of(own["sizes"], own["held"], own["vocabulary"], own["words"])
        counts = []
        for kind in (0, 1, 2):
            some = group[group["kind"] == kind].sort_values("part")
            counts.append(np.concatenate([np.zeros(0, np.int64), *[unpack_counts(c) for c in some["counts"]]]))
        hashes, pairs = block.pairs(shift)
        names, triples = block.triples(hashes, pairs, shift)
        starts, n = block.starts(), len(block.words)
        link = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        link[1][pairs] = block.words
        before = np.arange(n) - 1
        before[starts] = -1
        link[0][pairs] = np.where(before < 0, -1, block.words[before].astype(np.int64))
        inner = np.flatnonzero(before >= 0)
        chain = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        chain[0][triples[inner]], chain[1][triples[inner]] = pairs[before[inner]], pairs[inner]
        machine = Automaton(counts[0], texts, counts[1], counts[2], link, chain, total, distinct)
        if not len(names):  # no text of the block has two tokens
            machine.triple_arc = np.full(1, np.nan)
        ends = starts + block.sizes
        full = [machine.score(block.words[a:b], pairs[a:b], triples[a:b]) for a, b in zip(starts, ends, strict=True)]
        keys = pd.array(np.frombuffer(own["keys"], np.int64).copy(), dtype="Int64")
        keys[np.frombuffer(own["nulls"], bool)] = pd.NA
        known = (counts[0][block.words] > 0).astype(np.int64)
        return pd.DataFrame({"key": keys, "held_out": block.held, "n_tokens": block.sizes, "n_known": np.add.reduceat(known, starts), "train_tokens": total, "base_score": np.add.reduceat(machine.root[block.words], starts), "score": full})

    nothing = {c: F.lit(None).cast("binary").alias(c) for c in ("keys", "nulls", "held", "sizes", "vocabulary", "words")}
    texts_of = stored.select("block", F.lit(-1).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("counts"), *list(nothing))
    answers_of = answers.select("block", "kind", "part", "counts", *nothing.values())
    blocks = -(-int(sizes.tokens or 0) // BLOCK)
    dealt = texts_of.unionByName(answers_of).repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks), "block")
    out = dealt.groupBy("block").applyInPandas(scored, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)

"""Byte-level BPE encoding and decoding by a segment tree over the ranks of adjacent pairs.

Each pre-token starts as its bytes. A segment tree holds, at the leaf of every live position, the key
``rank * length + position`` of the pair that starts there, so that its root is the leftmost pair of lowest rank. A
merge rewrites one symbol, unlinks its right neighbour and updates three leaves in logarithmic time; it ends when the
root holds no mergeable pair. Pieces that come again are looked up in bounded tables of the Python worker; pieces that
no longer fit there are merged anew, so results do not depend on the bound.

Defined results: a null text counts as empty and gives no ids; texts of any length are encoded whole; repeated rows
and null ids give one output row each; extra columns are carried by ``encode``/``decode`` and never read,
but for one that bears the name of a new column, which gives way to it; new columns can be given other names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelight.llm.store import in_worker

#: The pre-tokenizer's pattern of the byte-level vocabularies.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A chunk is cut further by PIECE_PATTERN on its own, as no piece crosses from one chunk into the next.
CHUNK_PATTERN = r" ?\S+|\s+(?!\S)|\s+"
#: Entries that a worker's table of known pieces holds at most; further pieces are computed each time.
KNOWN_PIECES = 400_000
#: Rows whose ids a worker holds at a time.
SLICE = 64

_PIECES, _CHUNKS = regex.compile(PIECE_PATTERN), regex.compile(CHUNK_PATTERN)
_NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the printable byte alphabet: printable Latin-1 stands for itself, the others follow at 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply ``ranks`` ((left, right) -> (rank, merged)) to ``symbols`` until no pair is left, lowest rank first."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 1).bit_length()
    tree = [_NEVER] * (2 * size)
    for i in range(n - 1):
        found = ranks.get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while tree[1] != _NEVER:
        i = tree[1] % n
        j = after[i]
        symbols[i] = ranks[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if tree[size + j] != _NEVER:
            put(j, _NEVER)
        if k < n:
            before[k] = i
            found = ranks.get((symbols[i], symbols[k]))
            put(i, found[0] * n + i if found else _NEVER)
        else:
            put(i, _NEVER)
        h = before[i]
        if h >= 0:
            found = ranks.get((symbols[h], symbols[i]))
            put(h, found[0] * n + h if found else _NEVER)
    return [s for s in symbols if s >= 0]


class _Known(dict):
    """Results by key, computed when missing and kept while there is room."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < KNOWN_PIECES:
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one byte-level vocabulary file (the JSON text of the tokenizers library)."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level BPE vocabulary without a normalizer")
        ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.of_byte = [0] * 256
        for ch, b in alphabet.items():
            self.of_byte[b] = ids[ch]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.text_of_id = {i: str(i) for i in self.bytes_of}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self._pieces = _Known(lambda piece: tuple(merge_symbols([self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)))
        self._chunks = _Known(self._chunk)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        pieces = _PIECES.findall(chunk)
        if len(pieces) == 1:
            return self._pieces[chunk]
        return tuple(i for piece in pieces for i in self._pieces[piece])

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for part in self._split.split(text or "") if self._split else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for ids in map(self._chunks.__getitem__, _CHUNKS.findall(part)):
                    out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(vocabulary: str) -> Codec:
    """The codec of a vocabulary, built once in each Python worker."""
    in_worker("bpe", _CODECS.clear)
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary)
    return _CODECS[key]


def _slices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most SLICE rows, as ids in Python take many times the room of their text."""
    for b in parts:
        for lo in range(0, b.num_rows, SLICE):
            yield b.slice(lo, SLICE)


def _shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file's text for all executors: one published file of fixed size (1.6 MB), read on the driver."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "input_ids") -> DataFrame:
    """``df`` with the ids of its whole texts as ``out`` (array<int>), by a narrow pass."""
    shared = _shared_vocabulary(df, vocabulary_path)
    plain = df.drop(out)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in _slices(parts):
            ids = pa.array((codec.encode(t) for t in b.column(text).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return plain.mapInArrow(batches, schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids as ``out``; ids that end within a character give U+FFFD, null ids the empty text."""
    shared = _shared_vocabulary(df, vocabulary_path)
    plain = df.drop(out)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.StringType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in _slices(parts):
            texts = pa.array((codec.decode(x or []) for x in b.column(ids).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, out])

    return plain.mapInArrow(batches, schema)


def encode_checked(df: DataFrame, vocabulary_path: str, text: str = "text", out: str = "input_ids", check: str = "lossless") -> DataFrame:
    """``df`` with the ids of its texts, and whether decoding them gives the text again, in one narrow pass."""
    shared = _shared_vocabulary(df, vocabulary_path)
    plain = df.drop(out, check)
    schema = T.StructType([*plain.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in _slices(parts):
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = [codec.encode(t) for t in texts]
            same = [codec.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], [*b.schema.names, out, check])

    return plain.mapInArrow(batches, schema)


def round_trip_digests(df: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one narrow pass; per row the key, n_tokens, ids_sha256 and decoded_sha256."""
    shared = _shared_vocabulary(df, vocabulary_path)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        numeral, sha = codec.text_of_id.__getitem__, hashlib.sha256
        for b in parts:
            counts, of_ids, of_text = [], [], []
            for t in b.column(1):
                ids = codec.encode(t.as_py())
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(numeral, ids)).encode()).hexdigest())
                of_text.append(sha(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", chosen.schema["key"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return chosen.mapInArrow(batches, schema).withColumnRenamed("key", key)

"""Exact top-k inner products by a pivot-distance index.

Vectors are lifted to equal length: one more component makes every norm the largest one, so that the highest inner
product with a query is the smallest distance to it. Lifted vectors are keyed by their nearest pivot and their distance
to it, sorted by that key and cut into annuli of about sqrt(n) rows, each with the least and the largest distance of its
rows to every pivot. A query's first scores come from its own annulus. Annuli are then expanded from the nearest on: by
the triangle inequality the distances of an annulus to any pivot bound its distance to the query from below, and an
annulus that no bound brings to a query's k-th score is skipped; in the others only the rows whose own distance to their
pivot can be near enough are scored. All rows are indexed and the result is exact; only the pivots come from a bounded
sample (SAMPLE rows of smallest hash, of which PIVOTS that lie far apart), which affects speed alone.

Queries travel, not the index: chunks of at most CHUNK_BYTES of queries, one after another, are copied to the executors,
where each task reads its own annuli once and keeps the best of each query. What is shuffled are rows that reach a
query's first k-th score, at most k for each query and task.

Components become floor(256 * x) and scores are exact integers. Defined results: vectors that are null or hold null or
non-finite components (or such whose 256-fold is not finite), and rows without an id, take no part; missing trailing components count as zero; rows that repeat
an id are rows of their own, so a query meets its own copies; ties go to the smaller id. Where components are so large
that products may pass 2**53, rows that come near a query's k-th score are multiplied as integers of any size; scores
rank by up to 38 digits, and those beyond the range of a long come out as its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelight.llm.store import Scratch, in_worker, small_batches

#: Reference points of the index, and rows they are picked from; least and most rows of an annulus.
PIVOTS, SAMPLE, SMALLEST, LARGEST = 48, 2048, 32, 2048
#: Bytes of queries copied to each executor at a time, queries multiplied at a time, and hits kept before they are thinned out.
CHUNK_BYTES, QUERY_BLOCK, HITS = 32 << 20, 2048, 200_000
SCALE = 256
_RING = "cell int, near array<double>, far array<double>, n int, ids binary, rows binary, distances binary, data binary"
_MOST = 10**38 - 1


def _quantised(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(256 * x) of a list array as doubles, which hold it exactly, padded with zeros to ``dims``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    with np.errstate(over="ignore"):
        flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` distinct lines of the sample: the first, then always the one farthest from those taken."""
    taken = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(taken) < min(count, len(sample)):
        at = int(near.argmax())
        if not near[at] > 0:
            break
        taken.append(at)
        near = np.minimum(near, ((sample - sample[at]) ** 2).sum(1))
    return sample[taken]


class Space:
    """Distances of lifted rows and of queries to the pivots; ``top2`` is the largest squared norm of all rows."""

    def __init__(self, pivots: np.ndarray, top2: float):
        self.pivots, self.top2 = pivots, top2
        self.lift = np.sqrt(np.maximum(0, top2 - (pivots * pivots).sum(1)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(0, self.top2 - (x * x).sum(1)))
        return np.sqrt(np.maximum(0, 2 * self.top2 - 2 * (x @ self.pivots.T + own[:, None] * self.lift[None, :])))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.top2 - 2 * q @ self.pivots.T))


class Best:
    """The best rows of each query so far: (query, score, id, row), thinned out to k of each query now and then."""

    def __init__(self, kth: np.ndarray, k: int, wide: bool):
        self.kth, self.k, self.wide, self.parts, self.held = kth, k, wide, [], 0
        self.scored = np.zeros(len(kth), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((query, score, ids, rows))
        self.held += len(query)
        if self.held > HITS:
            self.thin()

    def thin(self) -> None:
        if not self.parts:
            return
        query, score, ids, rows = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        if self.wide:
            order = np.array(sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i], rows[i])), np.int64)
        else:
            order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        last = place == self.k - 1
        self.kth[query[last]] = np.maximum(self.kth[query[last]], [_as_float(v) for v in score[last]] if self.wide else score[last].astype(np.float64))
        kept = place < self.k
        self.parts, self.held = [(query[kept], score[kept], ids[kept], rows[kept])], int(kept.sum())


def _as_float(v: int) -> float:
    """A whole number of any size as a double that is no larger."""
    if v >= 1 << 1020:
        return 2.0**1020
    return -np.inf if v <= -(1 << 1020) else float(v) * (1 - 2.0**-52 if v > 0 else 1 + 2.0**-52)


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", embedding: str = "embedding", scored: bool = False) -> DataFrame:
    """For each row whose id is divisible by ``every`` its ``k`` highest scores: query_id, rank, vec_id, score.

    With ``scored`` instead (query_id, scored, rows): how many rows each query was multiplied with, its own annulus
    included, and how many there are.
    """
    with small_batches(vectors.sparkSession):
        return _top_k(vectors, k, every, key, embedding, scored)


def _top_k(vectors: DataFrame, k: int, every: int, key: str, embedding: str, scored: bool) -> DataFrame:
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    x = F.col("v")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < F.lit(float("inf"))))
    valid = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & x.isNotNull()).filter(sound)
    stored = scratch.table(valid.withColumn("row", F.monotonically_increasing_id()), "vectors")
    largest = F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c)))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + (F.abs(c) * SCALE + 1) * (F.abs(c) * SCALE + 1))
    asking = F.count_if(F.col("id") % every == 0)
    stats = stored.agg(F.count("*").alias("n"), asking.alias("asking"), F.max(F.size("v")).alias("dims"), F.max(largest).alias("top"), F.max(norm2).alias("norm2")).first()
    if not stats.n or not stats.asking:
        return spark.createDataFrame([], "query_id long, scored long, rows long" if scored else "query_id long, rank int, vec_id long, score long")
    dims = max(1, stats.dims)
    top = stats.top * SCALE + 1
    wide = not (top * top * dims < 2**53)
    sample = stored.select("v").orderBy(F.xxhash64("id", "row"), "row").limit(SAMPLE).toPandas()["v"]
    with np.errstate(over="ignore", invalid="ignore"):
        lines = _quantised(pa.array(sample.tolist(), pa.list_(pa.float64())), dims)
        space = Space(far_apart(lines, PIVOTS), float(stats.norm2))
    annulus = min(LARGEST, max(SMALLEST, isqrt(stats.n)))
    kind = np.float64 if wide else np.int32

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_worker("top-k")
        for b in parts:
            q = _quantised(b.column(1), dims)
            with np.errstate(all="ignore"):
                d = np.nan_to_num(space.of_rows(q), nan=0.0, posinf=0.0)
            cell = d.argmin(1) if len(q) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(q)), cell], pa.float64()), pa.array([r.tobytes() for r in q.astype(kind)], pa.binary())], ["id", "row", "cell", "distance", "data"])

    sorted_rows = stored.select("id", "v", "row").mapInArrow(keyed, "id long, row long, cell int, distance double, data binary")
    parts = max(1, -(-stats.n // (32 * annulus)))
    sorted_rows = sorted_rows.repartitionByRange(parts, "cell", "distance", "id", "row").sortWithinPartitions("cell", "distance", "id", "row")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Consecutive rows of one cell, up to ``annulus`` at a time."""
        open_rows: list[tuple] = []

        def ring() -> pa.RecordBatch:
            ids, rows, cells, far, data = zip(*open_rows, strict=True)
            with np.errstate(all="ignore"):
                d = space.of_rows(np.frombuffer(b"".join(data), kind).reshape(len(ids), dims).astype(np.float64))
            one = [cells[0], d.min(0).tolist(), d.max(0).tolist(), len(ids), np.array(ids, np.int64).tobytes(), np.array(rows, np.int64).tobytes(), np.array(far).tobytes(), b"".join(data)]
            open_rows.clear()
            return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(ring_schema, one, strict=True)}, schema=ring_schema)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if open_rows and (len(open_rows) == annulus or open_rows[0][2] != r[2]):
                    yield ring()
                open_rows.append(r)
        if open_rows:
            yield ring()

    ring_schema = pa.schema([("cell", pa.int32()), ("near", pa.list_(pa.float64())), ("far", pa.list_(pa.float64())), ("n", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("distances", pa.binary()), ("data", pa.binary())])
    rings = scratch.table(sorted_rows.mapInArrow(packed, _RING), "rings")
    scratch.drop(stored)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its k-th score within its own annulus (null if there are fewer rows)."""
        for b in batches:
            for r in b.to_pylist():
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
                m = np.frombuffer(r["data"], kind).reshape(len(ids), dims).astype(np.float64)
                at = np.flatnonzero(ids % every == 0)
                for lo in range(0, len(at), QUERY_BLOCK):
                    some = at[lo : lo + QUERY_BLOCK]
                    kth: list[float | None] = [None] * len(some)
                    if len(ids) > k and not wide:
                        s = m[some] @ m.T
                        s[np.arange(len(some)), some] = -np.inf
                        kth = np.partition(s, -k, axis=1)[:, -k].tolist()
                    yield pa.RecordBatch.from_pydict({"id": ids[some].tolist(), "row": rows[some].tolist(), "kth": kth, "home": [len(ids)] * len(some), "data": [x.tobytes() for x in m[some].astype(kind)]}, schema=pa.schema([("id", pa.int64()), ("row", pa.int64()), ("kth", pa.float64()), ("home", pa.int64()), ("data", pa.binary())]))

    width = dims * np.dtype(kind).itemsize + 8 * (PIVOTS + 8)
    chunks = -(-stats.asking * width // CHUNK_BYTES)
    chunk = F.pmod(F.xxhash64("id", "row"), F.lit(chunks)).cast("int")
    asked = scratch.table(rings.mapInArrow(at_home, "id long, row long, kth double, home long, data binary").withColumn("chunk", chunk), "queries")
    kinds = "query_id long, query_row long, vec_id long, vec_row long, score decimal(38,0), scored long" if wide else "query_id long, query_row long, vec_id long, vec_row long, score long, scored long"

    def searched(number: int) -> DataFrame:
        """Rows that may be among the best of a chunk of queries, from a pass over all annuli."""
        some = asked.filter(F.col("chunk") == number).orderBy("id", "row").select("id", "row", "kth", "data").toArrow()  # at most about CHUNK_BYTES
        shared = spark.sparkContext.broadcast((some.column("id").to_numpy(), some.column("row").to_numpy(), some.column("kth").fill_null(-np.inf).to_numpy(), b"".join(some.column("data").to_pylist())))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            in_worker("top-k")
            q_ids, q_rows, first, data = shared.value
            q = np.frombuffer(data, kind).reshape(len(q_ids), dims).astype(np.float64)
            best = Best(first.astype(np.float64).copy(), k, wide)
            with np.errstate(all="ignore"):
                q_norm2, d = (q * q).sum(1), space.of_queries(q)
                for b in batches:
                    around = b.to_pylist()
                    near, far = (np.array([r[c] for r in around]) for c in ("near", "far"))
                    lows = [np.maximum(d - f, n - d).max(1) for n, f in zip(near, far, strict=True)]
                    for i in sorted(range(len(around)), key=lambda i: float(np.nanmin(lows[i]))):
                        _expand(around[i], np.maximum(lows[i], 0), q, q_ids, q_rows, q_norm2, d, best)
                    best.thin()
            query, score, ids, rows = best.parts[0] if best.parts else (np.zeros(0, np.int64),) * 4
            if len(query):
                tell = pa.array([Decimal(v) for v in _clipped(score)], pa.decimal128(38, 0)) if wide else pa.array(score)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query]), pa.array(q_rows[query]), pa.array(ids), pa.array(rows), tell, pa.nulls(len(query), pa.int64())], names)
            if scored:
                n = len(q_ids)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(q_rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.decimal128(38, 0) if wide else pa.int64()), pa.array(best.scored)], names)

        names = [c.split()[0] for c in kinds.replace("(38,0)", "").split(", ")]
        return rings.mapInArrow(search, kinds)

    def _expand(r: dict, low: np.ndarray, q: np.ndarray, q_ids: np.ndarray, q_rows: np.ndarray, q_norm2: np.ndarray, d: np.ndarray, best: Best) -> None:
        """Score the rows of one annulus that may reach a query's k-th score."""
        upper = (q_norm2 + space.top2 - low * low) / 2
        slack = 1e-6 * (q_norm2 + space.top2) + 1
        reached = np.flatnonzero(~(upper + slack < best.kth))
        if not len(reached):
            return
        ids, rows, dist = (np.frombuffer(r[c], t) for c, t in (("ids", np.int64), ("rows", np.int64), ("distances", np.float64)))
        m = np.frombuffer(r["data"], kind).reshape(len(ids), dims).astype(np.float64)
        for at in range(0, len(reached), QUERY_BLOCK):
            some = reached[at : at + QUERY_BLOCK]
            # Rows sorted by their distance to the annulus' pivot: those within the query's reach stand together.
            reach = np.sqrt(np.maximum(0, q_norm2[some] + space.top2 - 2 * best.kth[some] + 2 * slack[some]))
            own = d[some, r["cell"]]
            lo, hi = np.searchsorted(dist, own - reach, "left"), np.searchsorted(dist, own + reach, "right")
            if wide:
                lo, hi = np.zeros_like(lo), np.full_like(hi, len(ids))
            best.scored[some] += np.maximum(hi - lo, 0)
            a, b = int(lo.min()), int(hi.max())
            if a >= b:
                continue
            s = q[some] @ m[a:b].T
            span = np.arange(a, b)
            inside = (span >= lo[:, None]) & (span < hi[:, None]) & (rows[a:b][None, :] != q_rows[some][:, None])
            if wide:  # sums of doubles are off by at most this much; what may reach is multiplied exactly
                off = dims * 2.0**-50 * np.sqrt(q_norm2[some])[:, None] * np.sqrt((m[a:b] * m[a:b]).sum(1))[None, :]
                inside &= ~(s + off + 1 < best.kth[some][:, None] * (1 - 2.0**-50 * np.sign(best.kth[some][:, None])))
            else:
                inside &= s >= best.kth[some][:, None]
            i, j = np.nonzero(inside)
            if not len(i):
                continue
            if wide:
                score = np.empty(len(i), object)
                score[:] = [_exact(q[some[u]], m[a + v]) for u, v in zip(i, j, strict=True)]
            else:
                score = np.rint(s[i, j]).astype(np.int64)
            best.add(some[i], score, ids[a + j], rows[a + j])

    found = None
    for number in range(chunks):
        part = scratch.table(searched(number), "found")
        found = part if found is None else found.unionByName(part)
    if scored:
        home = asked.select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "home")
        own = found.groupBy("query_id", "query_row").agg(F.sum("scored").alias("scored"))
        return home.join(own, ["query_id", "query_row"]).select("query_id", (F.col("scored") + F.col("home")).alias("scored"), F.lit(stats.n).cast("long").alias("rows"))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    score = F.greatest(F.least(F.col("score"), most), -most - 1).cast("long") if wide else F.col("score")
    ranked = found.filter("vec_id is not null").withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _clipped(score: np.ndarray) -> list[int]:
    return [max(-_MOST, min(_MOST, int(v))) for v in score]

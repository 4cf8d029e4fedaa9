"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are brought to unit length and rotated by one random orthogonal matrix. Each keeps the signs
of its residual to its cluster's centre as packed bits, and three scalars: the residual's length, its
inner products with its own code and with the centre. A query, quantised to four bit planes, meets a code by
bit counts; the scalars turn that into an unbiased estimate of the cosine with an error bound. Vectors
whose upper bound reaches the query's fifth best exact score so far are reranked on the spot with the original doubles.

Queries go through the index in blocks of BLOCK_BYTES of vectors: what is broadcast is bounded, and each block
is one pass over the codes, every row of which takes part. Queries start from their best scores in a bounded
sample, and a query skips a cluster whose longest residual can't bring any member up to its fifth best. A task returns its five best a query, so
what is shuffled does not depend on the rows. With `exact` the length of a residual bounds what it adds in
place of the estimate (Cauchy-Schwarz): slower, and nothing is left to chance.

Every vector is scaled by a power of two before it is squared, so that any finite, non-zero doubles have
their cosines. Centres come from a bounded sample of SAMPLE vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
null ids. Shorter vectors count as padded with zeros. A query is a row: other rows of its vec_id are candidates, and
repeated ids are queries each. Fewer candidates than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import document_columns, forget, sampled, ship, write_table

SAMPLE, CENTRES, PLANES = 4096, 32, 4
#: Bytes of query vectors in a block, and sampled vectors that give its queries their first scores.
BLOCK_BYTES, FIRST = 16 << 20, 1024
#: Half-width of the bound in standard errors.
SURE = 2.2
#: Vectors and queries that meet at a time, and pairs that are scored at a time: bounds of memory.
ROWS, TILE, PAIRS = 2048, 2048, 50_000


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return document_columns(df, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of `dims` doubles, padded with zeros."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component to between a half and one: no square overflows, no length vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Codec:
    """The rotation, and the rotated centres of a bounded sample."""

    def __init__(self, sample: np.ndarray, dims: int, seed: int = 5):
        self.dims, self.wide = dims, -(-dims // 64) * 64
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.normal(size=(self.wide, self.wide)))[0][:dims]
        x = unit(sample) @ self.turn if len(sample) else np.zeros((1, self.wide))
        centres = x[rng.permutation(len(x))[: min(CENTRES, len(x))]]
        for _ in range(8):
            near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(0)
        self.centres = centres

    def rotate(self, v: np.ndarray) -> np.ndarray:
        return unit(v) @ self.turn

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, cluster, residual length, residual times code (unit lengths), residual times centre."""
        x = self.rotate(v)
        near = (x @ self.centres.T - 0.5 * (self.centres**2).sum(1)).argmax(1)
        r = x - self.centres[near]
        length = np.sqrt((r * r).sum(1))
        own = np.abs(r).sum(1) / (np.maximum(length, 1e-300) * np.sqrt(self.wide))
        return np.packbits(r > 0, axis=1, bitorder="little"), near, length, own, (r * self.centres[near]).sum(1)


class Block:
    """A block of queries, ready to meet codes; `rows` ascend. A cluster's bit planes are made when first met."""

    def __init__(self, codec: Codec, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, exact: bool = False):
        self.codec, self.rows, self.ids, self.exact = codec, rows, ids, exact
        self.vectors = scaled(vectors)
        self.turned = codec.rotate(vectors)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        self.at_centres = self.turned @ codec.centres.T
        self.first = np.full(len(rows), -np.inf)
        self.made: tuple[int, tuple] | None = None

    def start(self, rows: np.ndarray, vectors: np.ndarray, top: int) -> None:
        """The `top`-th best score of each query among a few rows of the table, its own aside: a floor for what is worth keeping."""
        near = unit(vectors)
        for i in range(0, len(self.rows), TILE):
            scores = (self.vectors[i : i + TILE] / self.norms[i : i + TILE, None]) @ near.T
            scores[self.rows[i : i + TILE, None] == rows[None]] = -np.inf
            if len(rows) >= top:
                self.first[i : i + TILE] = np.partition(scores, len(rows) - top, axis=1)[:, len(rows) - top] - 1e-9

    def planes(self, cluster: int) -> tuple:
        """Packed bit planes of the queries' residuals to a centre, their scales and offsets."""
        if self.made is None or self.made[0] != cluster:
            codec, top = self.codec, (1 << PLANES) - 1
            q = self.turned - codec.centres[cluster]
            low, step = q.min(1), np.maximum((q.max(1) - q.min(1)) / top, 1e-12)
            levels = np.clip(np.rint((q - low[:, None]) / step[:, None]), 0, top).astype(np.uint8)
            packed = [np.packbits((levels >> p) & 1, axis=1, bitorder="little").view("<u8") for p in range(PLANES)]
            total = levels.sum(1, dtype=np.int64) * step + low * codec.wide
            self.made = cluster, (packed, low, step, total, np.sqrt((q * q).sum(1)))
        return self.made[1]

    def bounds(self, q: np.ndarray, cluster: int, codes: np.ndarray, length: np.ndarray, own: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Upper bounds of cosines, queries `q` by rows, against one cluster's codes."""
        at_centre = self.at_centres[q, cluster][:, None]
        if self.exact:
            return at_centre + length + 1e-9
        packed, low, step, total, far = self.planes(cluster)
        low, step, total, far = low[q], step[q], total[q], far[q]
        wide = self.codec.wide
        hits = np.zeros((len(q), len(codes)), np.uint32)
        for p, plane in enumerate(packed):
            mine = plane[q]
            for w in range(codes.shape[1]):
                hits += np.bitwise_count(mine[:, w, None] & codes[None, :, w]).astype(np.uint32) << np.uint32(p)
        # signed code = 2 * bits - 1, so <code, q> = 2 <bits, q> - sum(q), by levels and their offset
        gain = length / np.maximum(own, 1e-9)
        ones = np.bitwise_count(codes).sum(1)
        guess = hits * (2 * step[:, None]) + (2 * low[:, None] * ones - total[:, None])
        guess *= gain / np.sqrt(wide)
        guess += inner + at_centre
        spread = gain * np.sqrt(np.maximum(1 - own**2, 0)) * SURE / np.sqrt(max(wide - 1, 1))
        rounding = gain * SURE * 0.29  # of the queries' levels, evenly spread over a step
        guess += far[:, None] * spread + step[:, None] * rounding + 1e-9
        return np.minimum(guess, at_centre + length + 1e-9)


def index(df: DataFrame, codec: Codec) -> DataFrame:
    """(row, vec_id, v, code, cluster, length, own, inner) of every valid row; `row` numbers them once they are written."""
    held = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            if b.num_rows:
                codes, near, *scalars = c.encode(matrix(b.column("v"), c.dims))
                raw = [x.tobytes() for x in codes]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(raw, pa.binary()), pa.array(near.astype(np.int32)), *map(pa.array, scalars)], ["vec_id", "v", "code", "cluster", "length", "own", "inner"])

    made = df.mapInArrow(run, "vec_id long, v array<double>, code binary, cluster int, length double, own double, inner double")
    return made.sortWithinPartitions("cluster").withColumn("row", F.monotonically_increasing_id())  # so that what meets the queries is mostly of one cluster


class Best:
    """The best `top` candidates of each query of a block so far, better first."""

    def __init__(self, block: Block, top: int):
        self.block, self.top = block, top
        self.found: list[list[tuple[float, int]]] = [[] for _ in block.ids]
        self.worst = block.first.copy()

    def offer(self, q: np.ndarray, row: np.ndarray, v: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> None:
        """Score pairs of queries and rows exactly, and keep what belongs among the best."""
        for i in range(0, len(q), PAIRS):
            a, b = q[i : i + PAIRS], row[i : i + PAIRS]
            scores = (v[b] * self.block.vectors[a]).sum(1) / (norms[b] * self.block.norms[a])
            if not np.isfinite(scores).all():
                raise ValueError("a cosine is no number")
            keep = np.flatnonzero(scores >= self.worst[a])
            keep = keep[np.argsort(a[keep], kind="stable")]
            for part in np.split(keep, np.flatnonzero(np.diff(a[keep])) + 1) if len(keep) else []:
                k = int(a[part[0]])
                best = sorted([*self.found[k], *zip((-scores[part]).tolist(), ids[b[part]].tolist(), strict=True)])[: self.top]
                self.found[k] = best
                if len(best) == self.top:
                    self.worst[k] = max(self.worst[k], -best[-1][0])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _meet(best: Best, q: np.ndarray, cluster: int, rows: np.ndarray, columns: tuple, v: np.ndarray, norms: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
    """A tile of queries meets one cluster's rows."""
    block, top = best.block, best.top
    upper = block.bounds(q, cluster, *(c[rows] for c in columns))
    mine = np.minimum(np.searchsorted(block.rows[q], numbers[rows]), len(q) - 1)
    own = np.flatnonzero(block.rows[q][mine] == numbers[rows])
    upper[mine[own], own] = -np.inf  # a query is no candidate of its own
    # the most hopeful rows first, so that few of the others still reach the worst of the best
    few = min(2 * top, len(rows))
    first = np.argpartition(upper, len(rows) - few, axis=1)[:, len(rows) - few :]
    at = np.repeat(np.arange(len(upper)), few)
    reach = upper[at, first.ravel()]
    take = (reach >= best.worst[q[at]]) & (reach > -np.inf)
    best.offer(q[at[take]], rows[first.ravel()[take]], v, norms, ids)
    upper[at, first.ravel()] = -np.inf
    at, near = np.nonzero((upper >= best.worst[q][:, None]) & (upper > -np.inf))
    best.offer(q[at], rows[near], v, norms, ids)


def _search(held, top: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        best = Best(block, top)
        for b in _gathered(batches):
            column = lambda c, b=b: b.column(c).chunk(0)
            v, ids, cluster, numbers = scaled(matrix(column("v"), block.codec.dims)), column("vec_id").to_numpy(), column("cluster").to_numpy(), column("row").to_numpy()
            norms = np.sqrt((v * v).sum(1))
            codes = np.frombuffer(b"".join(column("code").to_pylist()), "<u8").reshape(b.num_rows, -1)
            columns = (codes, *(column(c).to_numpy() for c in ("length", "own", "inner")))
            for c in np.unique(cluster).tolist():
                rows = np.flatnonzero(cluster == c)
                # queries whose bound for the whole cluster falls short skip it
                able = np.flatnonzero(block.at_centres[:, c] + columns[1][rows].max() + 1e-9 >= best.worst)
                for i in range(0, len(able), TILE):
                    _meet(best, able[i : i + TILE], c, rows, columns, v, norms, ids, numbers)
        out = [(int(block.rows[q]), int(block.ids[q]), i, -s) for q, found in enumerate(best.found) for s, i in found]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["query", "query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries: Column | DataFrame, top: int = 5, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest rows of `df` (vec_id, embedding) for each query.

    `queries` is a condition on vec_id, whose rows are searched for among all others, or a table
    (vec_id, embedding) of other vectors, searched for among all.
    """
    spark = df.sparkSession
    ship(spark)
    rows = valid(df)
    foreign = valid(queries) if isinstance(queries, DataFrame) else None
    none = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dims = max((x.agg(F.max(F.size("v"))).first()[0] or 0 for x in (rows, foreign) if x is not None), default=0)
    if not dims:
        return none
    padded = lambda t: matrix(t.column("v").combine_chunks(), dims)
    codec = Codec(padded(sampled(rows, "vec_id", SAMPLE).select("v").toArrow()), dims)  # SAMPLE rows
    table = write_table(index(rows, codec), "codes")
    if foreign is None:
        asked = table.where(queries).select("row", "vec_id", "v")
    else:
        asked = foreign.withColumn("row", -1 - F.monotonically_increasing_id()).select("row", "vec_id", "v")
    asked = write_table(asked.repartitionByRange("row").sortWithinPartitions("row"), "queries")
    few = sampled(table, "row", FIRST).select("row", "v").toArrow()  # FIRST rows
    known = few.column("row").to_numpy(), padded(few)
    size, found, last = max(1, BLOCK_BYTES // (8 * dims)), [], None
    while True:
        # a block of rows at a time, in order
        block = (asked if last is None else asked.where(F.col("row") > last)).orderBy("row").limit(size).toArrow()
        if not block.num_rows:
            break
        numbers = block.column("row").to_numpy()
        last = int(numbers[-1])
        made = Block(codec, numbers, block.column("vec_id").to_numpy(), padded(block), exact)
        made.start(*known, top)
        held = spark.sparkContext.broadcast(made)
        near = table.mapInArrow(_search(held, top), "query long, query_id long, vec_id long, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        found.append(write_table(near.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "nearest"))
        held.unpersist()
        if block.num_rows < size:
            break
    forget(table)
    forget(asked)
    out = found[0] if found else none
    for more in found[1:]:
        out = out.union(more)
    return out


def op3(df: DataFrame) -> DataFrame:
    return search(df, F.col("vec_id") % 50 == 0)

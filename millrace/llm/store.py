"""Token-id output as a content-addressed store.

A document's id stream is cut where a rolling hash over a window of ids hits a mask, so equal passages
give equal chunks wherever they lie. The store is two Parquet tables and a manifest:

* ``chunks`` (digest, ids): each distinct chunk once, under the SHA-256 of its little-endian bytes;
* ``recipes`` (doc_id, n_tokens, digests, lengths, root, part, row), in ascending doc_id order, `row` being the
  place within the part: which chunks make a document, and the Merkle root of its chunks;
* ``manifest`` (level, part, block, docs, ids, wide, root): a hash tree over the recipes. A leaf hashes a
  recipe's doc_id, number of ids and root; a block node (level 2) BLOCK recipes in order, a part node
  (level 1) its blocks, the store node (level 0) the parts. A node's hash covers its counts too.

One pass encodes and cuts; chunks travel to their digest's task and recipes to their document's in one
exchange, with chunks met before in the same task left out already, so a chunk that many documents
share costs one row a task. Reading makes the tree anew from the recipes and holds every node against the
manifest (and the store's root against a given one, if any), then verifies every chunk's digest, every recipe's root and length, and
gets a document's CRC-32 by combining those of its chunks, so chunk bytes are never moved again;
``reconstruct`` returns the ids themselves, verified alike.

Defined results: a null text counts as empty and holds the end id alone. Null doc_ids sort first;
rows that repeat a doc_id are apart documents, in the order of their roots. An empty table gives an
empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import words
from millrace.llm.common import document_columns, drop_path, forget, pieces, scratch_path, ship, write_table

WINDOW = 16
#: Recipes under a node of the manifest.
BLOCK = 4096
MEAN = 512
LEAST, MOST = 64, 4096
#: Digests that a task remembers; beyond it starts anew, and the exchange drops the repeats.
REMEMBERED = 500_000
_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(odd: int, n: int) -> np.ndarray:
    held = _powers.get(odd)
    if held is None or len(held) < n:
        held = _powers[odd] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 16), np.uint64(odd))), dtype=np.uint64)
    return held[:n]


def cut_points(flat: np.ndarray, sizes: np.ndarray, mean: int = MEAN) -> list[list[int]]:
    """Each document's chunk ends in `flat`: where the window's polynomial hash has `mean` to one."""
    n = len(flat)
    x = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    total = np.cumsum(x * _power(_ODD, n), dtype=np.uint64)
    h = total.copy()
    h[WINDOW:] -= total[:-WINDOW]
    h *= _power(_INVERSE, n)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    hits = np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + 1
    last = np.cumsum(sizes)
    lo, hi = np.searchsorted(hits, last - sizes + WINDOW), np.searchsorted(hits, last)
    out = []
    for start, end, a, b in zip((last - sizes).tolist(), last.tolist(), lo.tolist(), hi.tolist(), strict=True):
        ends, at = [], start
        for p in [*hits[a:b].tolist(), end]:
            if p - at < LEAST and p != end:
                continue
            while p - at > MOST:
                at += MOST
                ends.append(at)
            at = p
            ends.append(p)
        out.append(ends)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and nodes are marked apart, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# CRC-32 of a concatenation: multiplication of polynomials over GF(2), as zlib defines the checksum
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


_squares = [1 << 30]
for _ in range(40):
    _squares.append(_times(_squares[-1], _squares[-1]))


@lru_cache(1 << 14)
def _shift(n_bytes: int) -> int:
    out, k = 1 << 31, 3
    while n_bytes:
        if n_bytes & 1:
            out = _times(_squares[k], out)
        n_bytes >>= 1
        k += 1
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a stream from its parts' (CRC-32, bytes)."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc if out else crc
    return out


#: What a store's tables hold; named, so that empty ones can be read.
_ROW = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, digest binary, ids binary, wide int"
SCHEMAS = {
    "parts": f"{_ROW}, kind int",
    "recipes": "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, wide int, part int, row long",
    "manifest": "level int, part int, block long, docs long, ids long, wide int, root string",
}


def _table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{where}/{name}")


def _encoded(docs: DataFrame, path: str | None, end: int) -> DataFrame:
    """Rows of two kinds: a recipe for each document, and a chunk the first time that its task meets it."""
    spark = docs.sparkSession
    ship(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())  # the tokenizer's file, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = words.load(held.value)
        kind = "<u2" if m.size <= 1 << 16 else "<u4"
        wide = int(kind[-1])
        met: set[bytes] = set()
        for b in pieces(batches, limit=4 << 20):
            flat, sizes = m.encode(b.column("text").to_pylist(), end)
            raw = memoryview(flat.astype(kind).tobytes())
            ids, digests, lengths, roots, fresh, held_ids = b.column("doc_id"), [], [], [], [], []
            at = 0
            for ends in cut_points(flat, sizes):
                mine = []
                for a, z in pairwise([at, *ends]):
                    d = hashlib.sha256(raw[a * wide : z * wide]).digest()
                    mine.append(d)
                    if d not in met:
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(d)
                        fresh.append(d)
                        held_ids.append(bytes(raw[a * wide : z * wide]))
                lengths.append(np.diff([at, *ends]).tolist())
                at = ends[-1]
                digests.append(mine)
                roots.append(merkle(mine))
            n, k = len(sizes), len(fresh)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([0] * n + [1] * k, pa.int32()), "doc_id": pa.concat_arrays([ids.cast(pa.int64()), pa.nulls(k, pa.int64())]),
                "n_tokens": pa.array([*sizes.tolist(), *[None] * k], pa.int64()), "digests": pa.array([*digests, *[None] * k], pa.list_(pa.binary())),
                "lengths": pa.array([*lengths, *[None] * k], pa.list_(pa.int32())), "root": pa.array([*roots, *[None] * k], pa.binary()),
                "digest": pa.array([*[None] * n, *fresh], pa.binary()), "ids": pa.array([*[None] * n, *held_ids], pa.binary()),
                "wide": pa.array([wide] * (n + k), pa.int32()),
            })

    return document_columns(docs, "doc_id", "text").mapInArrow(run, f"kind int, {_ROW}")


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows: drop a chunk whose digest the row before has; recipes pass."""
    before = None
    for b in batches:
        kinds, digests, keep = b.column("kind").to_pylist(), b.column("digest").to_pylist(), []
        for kind, digest in zip(kinds, digests, strict=True):
            keep.append(kind == 0 or digest != before)
            before = digest
        yield b.filter(pa.array(keep))


def _nodes(children: DataFrame, level: int, *at: str) -> DataFrame:
    """The parents of rows of (at..., place, docs, ids, wide, hash)."""
    counts = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("docs", "ids")]
    held = children.groupBy(*at).agg(*counts, F.coalesce(F.max("wide"), F.lit(0)).alias("wide"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below"))
    named = [F.col(c) if c in at else F.lit(None).cast(kind).alias(c) for c, kind in (("part", "int"), ("block", "long"))]
    parts = [F.lit(str(level)), *[F.col(c).cast("string") for c in ("docs", "ids", "wide")], F.array_join(F.transform("below", lambda x: x["hash"]), "")]
    return held.select(F.lit(level).alias("level"), *named, "docs", "ids", "wide", F.sha2(F.concat_ws(":", *parts), 256).alias("root"))


def tree(recipes: DataFrame) -> DataFrame:
    """The manifest that `recipes` call for. A group is a block's recipes, a part's blocks, or the parts."""
    leaf = F.sha2(F.concat_ws(":", F.lit("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), F.hex("root")), 256)
    rows = recipes.select("part", F.floor(F.col("row") / BLOCK).cast("long").alias("block"), F.col("row").alias("place"), F.lit(1).alias("docs"), F.col("n_tokens").alias("ids"), "wide", leaf.alias("hash"))
    blocks = write_table(_nodes(rows, 2, "part", "block"), "nodes")
    parts = _nodes(blocks.withColumnRenamed("root", "hash").withColumn("place", F.col("block")), 1, "part")
    store = _nodes(parts.withColumnRenamed("root", "hash").withColumn("place", F.col("part")), 0)
    out = write_table(blocks.union(parts).union(store), "tree")
    forget(blocks)
    return out


def write_store(docs: DataFrame, where: str, tokenizer: str | None = None, end: int = 2) -> str:
    """Encode, cut and write `docs` (doc_id, text) under the folder `where`; returns the store's root."""
    spark = docs.sparkSession
    rows = _encoded(docs, tokenizer, end)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("kind") == 0, F.xxhash64("root", "doc_id")).otherwise(F.xxhash64("digest"))
    both = rows.withColumn("place", place).repartition(n, "place").drop("place").sortWithinPartitions("kind", "digest")
    both.mapInArrow(_first_of_each, both.schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{where}/parts")
    # recipes in ascending doc_id order; `copy` deals rows that are alike to several parts
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("copy")]
    ordered = (
        _table(spark, where, "parts").where("kind = 0").select("doc_id", "n_tokens", "digests", "lengths", "root", "wide", F.monotonically_increasing_id().alias("copy"))
        .repartitionByRange(n, *order).sortWithinPartitions(*order).drop("copy")
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    ordered.write.option("compression", "zstd").parquet(f"{where}/recipes")
    made = tree(_table(spark, where, "recipes"))
    made.write.parquet(f"{where}/manifest")
    forget(made)
    return _table(spark, where, "manifest").where("level = 0").first().root


def verify(spark: SparkSession, where: str, root: str | None = None) -> str:
    """Hold the recipes against every node of the manifest, and its root against `root` if given; returns the root."""
    held = _table(spark, where, "manifest")
    top = held.where("level = 0").limit(2).collect()
    if len(top) != 1 or root not in (None, top[0].root):
        raise ValueError("the manifest's root does not match")
    made = tree(_table(spark, where, "recipes"))
    names = ["level", "part", "block", "docs", "ids", "wide", "root"]
    count = lambda df, x: df.groupBy(*names).agg(F.count("*").alias(x))
    both = count(made, "made").unionByName(count(held, "held"), allowMissingColumns=True).groupBy(*names).agg(F.sum("made").alias("made"), F.sum("held").alias("held"))
    wrong = both.where("made is null or held is null or made <> 1 or held <> 1").limit(1).collect()
    forget(made)
    if wrong:
        raise ValueError(f"the recipes do not match the manifest's node {wrong[0].level}, {wrong[0].part}, {wrong[0].block}")
    return top[0].root


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify each stored chunk and give its CRC-32 as unsigned 32-bit ids."""
    for b in batches:
        crcs, sizes = [], []
        for digest, raw, wide in zip(*(b.column(c).to_pylist() for c in ("digest", "ids", "wide")), strict=True):
            if hashlib.sha256(raw).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not match its address")
            crcs.append(zlib.crc32(np.frombuffer(raw, f"<u{wide}").astype("<u4").tobytes()))
            sizes.append(len(raw) // wide)
        yield pa.RecordBatch.from_pydict({"digest": b.column("digest"), "crc": pa.array(crcs, pa.int64()), "held": pa.array(sizes, pa.int32())})


def _chunks(spark: SparkSession, where: str) -> DataFrame:
    return _table(spark, where, "parts").where("kind = 1").select("digest", "ids", "wide")


def _recipes(spark: SparkSession, where: str, root: str | None) -> DataFrame:
    """Verified recipes with `start`: the parts before, from the manifest, and the documents before within the part."""
    verify(spark, where, root)
    recipes, parts = _table(spark, where, "recipes"), _table(spark, where, "manifest").where("level = 1")
    # a row for each part: its number is the session's number of shuffle partitions at most
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return recipes.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("inside"))


def _whole(n: int, root: bytes, parts: list[dict], held: str) -> None:
    """Hold a recipe against its chunks; `held` names what a missing chunk lacks."""
    if any(p[held] is None for p in parts) or sum(p["length"] for p in parts) != n or merkle([p["digest"] for p in parts]) != root:
        raise ValueError("a recipe does not match its chunks")


def _referenced(recipes: DataFrame, chunks: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, start, n_tokens, root, parts): each document's chunks in order, with `fields` of `chunks`."""
    at = ["part", "row", "doc_id", "start", "n_tokens", "root"]
    refs = recipes.select(*at, F.posexplode(F.arrays_zip("digests", "lengths")).alias("seq", "ref")).select(*at, "seq", F.col("ref.digests").alias("digest"), F.col("ref.lengths").alias("length"))
    return refs.join(chunks, "digest", "left").groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "length", *fields))).alias("parts")).drop("part", "row")


def read_back(spark: SparkSession, where: str, root: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks), verified, from the store's files alone."""
    sums = _chunks(spark, where).mapInArrow(_chunk_sums, "digest binary, crc long, held int")
    met = _referenced(_recipes(spark, where, root), sums, "crc", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": [], "ids_crc32": [], "n_chunks": []}
            for n, tip, parts in zip(*(b.column(c).to_pylist() for c in ("n_tokens", "root", "parts")), strict=True):
                _whole(n, tip, parts, "crc")
                if any(p["held"] != p["length"] for p in parts):
                    raise ValueError("a chunk does not match its recipe's length")
                out["n_tokens"].append(n)
                out["ids_crc32"].append(crc_join([(p["crc"], 4 * p["length"]) for p in parts]))
                out["n_chunks"].append(len(parts))
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in out.items()})

    return met.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def reconstruct(spark: SparkSession, where: str, root: str | None = None) -> DataFrame:
    """(doc_id, start, ids): each document's ids, put together from its chunks and verified like ``read_back``."""
    met = _referenced(_recipes(spark, where, root), _chunks(spark, where), "ids", "wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, tip, parts in zip(*(b.column(c).to_pylist() for c in ("n_tokens", "root", "parts")), strict=True):
                _whole(n, tip, parts, "ids")
                if any(hashlib.sha256(p["ids"]).digest() != p["digest"] or len(p["ids"]) != p["wide"] * p["length"] for p in parts):
                    raise ValueError("a chunk does not match its address")
                ids.append(np.concatenate([np.frombuffer(p["ids"], f"<u{p['wide']}").astype(np.int64) for p in parts] or [np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": b.column("start"), "ids": pa.array(ids, pa.list_(pa.int64()))})

    return met.mapInArrow(run, "doc_id long, start long, ids array<long>")


def op10(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    where = scratch_path(spark, "store")
    write_store(docs, where, tokenizer)
    return read_back(spark, where)


def drop_store(spark: SparkSession, where: str) -> None:
    drop_path(spark, where)

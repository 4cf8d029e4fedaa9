"""Near-duplicate groups by HyperMinHash banding, estimation and exact verification.

1. One pass over the texts gives each document's shingle-set size, a 128-bit digest of the set and
   its HyperMinHash registers. Documents of equal sets become one class.
2. Each class's registers form bands; classes that share a band meet. In a bucket every class meets the
   bucket's least class only, so a bucket costs as many pairs as it has classes.
3. Pairs whose collision-corrected similarity estimate lies MARGIN or more under the threshold go; the
   rest are verified on full shingle sets. Verified links contract to components.
4. Buckets that still hold classes of different components get the links a star can miss: classes in
   small buckets all meet across components; those of larger ones are joined exactly by a prefix filter,
   rarest shingles first, again in stars and then across components. A bucket that is large even then is dealt
   to units of at most 2 x UNIT classes, which compare registers in numpy; only pairs that reach the estimate leave
   a unit. Components are final after this.

Bands are as few and wide as leave a pair at the threshold a chance of MISSED at most to share none: 32 of 6
registers at 0.85 (3e-7, less above), 48 of 4 at 0.8 (1e-11). The estimate's standard error is 0.026 at 0.85 and
0.029 at 0.8, so MARGIN is over 5 of them. No bucket is capped and no document dropped.

Defined results: a null or empty text, or one of white space, has an empty set, is linked with nothing
and kept. Documents that repeat a doc_id are told apart by a 128-bit digest of id and text; a repeated row is one document. A null
doc_id is the least id. Other columns are ignored, and kept by ``first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import shingles as S
from millrace.llm.common import document_columns, forget, pieces, row_key, ship, write_table
from millrace.llm.graph import components

MARGIN = 0.16
#: Chance that a pair at the threshold shares no band, at most.
MISSED = 1e-6
#: Buckets of at most so many classes compare all of them across components.
SMALL = 48
#: Classes of a large bucket that a unit takes from each of two parts.
UNIT = 512
#: Cells that count shingles for the prefix filter's order: what occurs in more than a millionth of all sets' shingles stands out.
CELLS = 1 << 20


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """`docs` with `_node`, a document's number: its id where ids are unique (then True), else one given to each distinct (id, text)."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_node", F.col("doc_id").cast("long")), True
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text")))
    # numbers are fixed once they are written
    known = write_table(keyed.select("_key").distinct().withColumn("_node", F.monotonically_increasing_id()), "numbers")
    return keyed.join(known, "_key").drop("_key"), False


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(node, doc_id, n, d1, d2, sig) of (node, doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=2 << 20):
            h, sizes = S.sets([t.encode() if t else None for t in b.column("text").to_pylist()], k)
            sig = S.signatures(h, sizes)
            upto = np.append(0, np.cumsum(sizes))
            digests = []
            for salt in (0x51, 0xA7):
                total = np.append(np.uint64(0), np.cumsum(S.mix(h ^ np.uint64(salt * 0x0101010101010101)), dtype=np.uint64))
                digests.append(pa.array((total[upto[1:]] - total[upto[:-1]]).view(np.int64)))
            wide = sig.shape[1] * 2
            raw = sig.astype("<u2").tobytes()
            sigs = pa.array([raw[i * wide : (i + 1) * wide] for i in range(len(sizes))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), *digests, sigs], ["node", "doc_id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(run, "node long, doc_id long, n long, d1 long, d2 long, sig binary")


def bands(num: int, den: int, registers: int = S.REGISTERS) -> int:
    """The fewest bands that miss a pair at a similarity of num / den with a chance of MISSED at most."""
    fit = (b for b in range(1, registers) if registers % b == 0 and (1 - (num / den) ** (registers // b)) ** b <= MISSED)
    return next(fit, registers)


def _banded(classes: DataFrame, n_bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, -1)
                keys = S.band_keys(sig, n_bands)
                each = [np.repeat(b.column(c).to_numpy(), keys.shape[1]) for c in ("rep", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *each, np.zeros(keys.size, np.int32))], ["key", "rep", "n", "place"])

    return classes.mapInArrow(run, "key long, rep long, n long, place int")


def _stars(keyed: DataFrame) -> DataFrame:
    """Rows of the keys that two or more classes share, with the key's hub: the least class of them."""
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(hubs, "key")


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose similarity estimate reaches `least`."""
    sigs = classes.select("rep", "sig")
    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in "xy")
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(S.estimate(x, y) >= least))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(rep, set): sorted 64-bit shingles as bytes, of the documents whose node is in `reps` (rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=2 << 20):
            h, sizes = S.sets([t.encode() if t else None for t in b.column("text").to_pylist()], k)
            raw, ends = h.astype("<u8").tobytes(), np.cumsum(sizes)
            held = [raw[8 * (e - s) : 8 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(held, pa.binary())], ["rep", "set"])

    return docs.join(reps.withColumnRenamed("rep", "node"), "node", "left_semi").select("node", "text").mapInArrow(run, "rep long, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with den * |a and b| >= num * |a or b|."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if len(x) > len(y):
                    x, y = y, x
                common = 0
                if den * len(x) >= num * len(y):
                    at = np.searchsorted(y, x)
                    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            if keep:
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(keyed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets that hold several components: members of small ones, and of larger ones with their size."""
    held = keyed.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    held = write_table(held.select("key", "rep", "n", "place", "label"), "buckets")
    mixed = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo < hi")
    return held.join(mixed.where(f"size <= {SMALL}").select("key"), "key"), held.join(mixed.where(f"size > {SMALL}").select("key", "size"), "key")


def _units(large: DataFrame, classes: DataFrame, num: int, den: int, least: float) -> DataFrame:
    """``_meet`` and ``_estimated`` for large buckets: pairs are compared within units, and only near ones leave."""
    parts = F.ceil(F.col("size") / UNIT).cast("int")
    dealt = large.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    dealt = dealt.join(classes.select("rep", "sig"), "rep").select("key", "lo", "hi", "part", "rep", "n", "place", "label", "sig")

    def run(unit: pa.Table) -> pa.Table:
        part, rep, n, place, label = (unit.column(c).to_numpy() for c in ("part", "rep", "n", "place", "label"))
        lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
        sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), "<u2").reshape(len(rep), -1)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        out = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(left), 16):
            a = left[i : i + 16]
            room = np.minimum.outer(n[a] - place[a], n[right] - place[right])
            total = np.add.outer(n[a], n[right])
            near = (np.minimum.outer(n[a], n[right]) * den >= np.maximum.outer(n[a], n[right]) * num) & (room * (num + den) >= total * num)
            x, y = np.nonzero(near & (label[a][:, None] != label[right]))
            if lo == hi:
                x, y = x[rep[a[x]] < rep[right[y]]], y[rep[a[x]] < rep[right[y]]]
            for j in range(0, len(x), 8192):
                p, q = a[x[j : j + 8192]], right[y[j : j + 8192]]
                hit = S.estimate(sig[p], sig[q]) >= least
                out.append(np.stack([np.minimum(rep[p[hit]], rep[q[hit]]), np.maximum(rep[p[hit]], rep[q[hit]])], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _meet(bucket: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs across components within buckets, but those whose sizes rule a link out.

    `place` is how many rarer shingles each set has before the shared one: a pair's first common shingle leaves room for enough
    common ones after it (bands have place 0, where this says nothing beyond the sizes).
    """
    other = bucket.select("key", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("place").alias("pb"))
    room = F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb"))
    near = (F.least("n", "nb") * den >= F.greatest("n", "nb") * num) & (room * (num + den) >= (F.col("n") + F.col("nb")) * num)
    one = bucket.withColumnRenamed("rep", "a").withColumnRenamed("key", "ka")
    return one.join(other, (F.col("ka") == F.col("key")) & (F.col("label") != F.col("lb")) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _cell(h: np.ndarray) -> np.ndarray:
    return (S.mix(h ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(CELLS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each of CELLS cells occur: a bounded table however many sets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(_cell(np.frombuffer(b"".join(b.column("set").to_pylist()), "<u8")), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    found = sets.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, rep, n, place): each set's first shingles, so many that two linked sets must share one.

    Any order that all sets share keeps this exact; the one by cell frequency, then hash, puts what many
    sets share last.
    """
    held = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, reps, sizes, places = [], [], [], []
            for rep, raw in zip(b.column("rep").to_pylist(), b.column("set").to_pylist(), strict=True):
                h = np.frombuffer(raw, "<u8")
                m = len(h) + (-len(h) * num) // den + 1  # less the ceiling of the share that must be common
                first = h[np.lexsort((h, held.value[_cell(h)]))[:m]]
                keys.append(first.view("<i8"))
                reps.append(np.full(len(first), rep))
                sizes.append(np.full(len(first), len(h)))
                places.append(np.arange(len(first), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, reps, sizes, places)], ["key", "rep", "n", "place"])

    return sets.mapInArrow(run, "key long, rep long, n long, place int")


def grouped(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(node, doc_id, n, component_id, label) of (doc_id, text) rows: sets of k-word shingles, linked where den * common >= num * union.

    `label` tells groups apart also where two have the same least doc_id.
    """
    return _grouped(*numbered(document_columns(docs, "doc_id", "text")), k, num, den)


def _grouped(docs: DataFrame, unique: bool, k: int, num: int, den: int) -> DataFrame:
    ship(docs.sparkSession)
    docs = docs.select(F.col("_node").alias("node"), "doc_id", "text")
    if not unique:  # the join that numbers the rows is made once
        docs = write_table(docs, "numbered")
    least = num / den - MARGIN
    seen = write_table(signed(docs, k), "signed")
    every = seen.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("node").alias("rep"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first"), F.count("*").alias("size"))
    every = write_table(every, "classes")
    classes = write_table(seen.join(every.select(F.col("rep").alias("node")), "node", "left_semi").select(F.col("node").alias("rep"), "n", "sig").dropDuplicates(["rep"]), "representatives")
    keyed = write_table(_stars(_banded(classes, bands(num, den))).drop("size"), "stars")
    pairs = write_table(_estimated(keyed.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), classes, least), "pairs")
    sets = write_table(full_sets(docs, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), k), "sets")
    links = write_table(_verified(pairs, sets, num, den), "links")
    labels = components(links)
    small, large = _across(keyed, labels)
    more = _estimated(_meet(small, num, den).join(pairs, ["a", "b"], "left_anti"), classes, least)
    crowd = write_table(large.select("rep").distinct(), "crowd")
    if not crowd.isEmpty():
        # exact for all that the larger buckets hold: a prefix filter over their full sets, in the same two steps
        forget(sets)
        reps = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(crowd).distinct()
        sets = write_table(full_sets(docs, reps, k), "sets")
        rare = write_table(_stars(_prefixes(sets.join(crowd, "rep", "left_semi"), num, den)).drop("size"), "prefixes")
        star = write_table(_estimated(rare.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), classes, least), "pairs")
        links = write_table(links.union(_verified(star, sets, num, den)), "links")
        labels = components(links)
        small, large = _across(rare, labels)
        more = more.union(_estimated(_meet(small, num, den), classes, least)).union(_units(large, classes, num, den, least))
    more = write_table(more.distinct(), "pairs")
    if not more.isEmpty():
        missing = more.select(F.col("a").alias("rep")).union(more.select("b")).distinct().join(sets.select("rep"), "rep", "left_anti")
        sets = sets.union(write_table(full_sets(docs, missing, k), "sets"))
        found = write_table(_verified(more, sets, num, den), "links")
        if not found.isEmpty():
            labels = components(links.union(found))
    # classes to components, components to their least doc_id, documents to classes
    named = every.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    lowest = named.groupBy("label").agg(F.min("first").alias("lowest"))
    known = write_table(named.join(lowest, "label").select("d1", "d2", "n", "lowest", "label"), "named")
    out = seen.select("node", "doc_id", "n", "d1", "d2").join(known, ["d1", "d2", "n"], "left")
    least_id = F.when(F.col("lowest") == -(2**63), None).otherwise(F.col("lowest"))
    return out.select("node", "doc_id", "n", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(least_id).alias("component_id"), F.coalesce("label", "node").alias("label"))


def op7(docs: DataFrame) -> DataFrame:
    out = grouped(docs, k=3, num=85, den=100)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def first_of_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one document of each near-duplicate group: that of the least doc_id.

    Of several texts of that doc_id one stays; of rows that repeat a doc_id and its text one stays, whichever.
    """
    docs, unique = numbered(docs)
    found = _grouped(docs, unique, k, num, den)
    if unique:
        keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("node").alias("_kept"))
        return docs.join(keep, F.col("_node") == F.col("_kept"), "left_semi").drop("_node")
    keep = found.groupBy("label").agg(F.min(F.struct("doc_id", "node"))["node"].alias("_kept")).select("_kept")
    return docs.join(keep, F.col("_node") == F.col("_kept"), "left_semi").dropDuplicates(["_node"]).drop("_node")

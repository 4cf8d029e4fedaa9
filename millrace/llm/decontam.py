"""Benchmark decontamination by spaced-seed hashing. SQL functions only.

Texts and benchmark items become lower-case runs of letters and digits. Each fixed mask looks at some
of SPAN neighbouring tokens and ignores the rest, so a seed survives substitutions at ignored places.
An item of fewer than SPAN tokens has one seed instead, of all its tokens. Seeds of all training positions
meet the benchmark's in a hash join; a hit fixes how an item lies in a text. Only (text key, item, start) leave
that join, each placement once however many seeds hit it. The tokens come back by the key for texts with a hit
alone; the whole item is laid at each placement and the best-scoring stretch found (match +1, other token -2).
The pair counts as contaminated from min(LEAST, 0.8 x the item's tokens) on, and with `share` also where so large a
part of the item's tokens is equal at one placement: short items are then found with a fifth of their tokens
substituted, wherever these stand (the query and the pipeline pass SHARE). Of an item under SPAN tokens all must
be equal. `matched` is the best stretch's score in all cases.

While the benchmark has at most `broadcast_seeds` seeds they are broadcast, else both sides are shuffled by
seed, a text's seeds dealt to SALTS parts so that no common seed meets in one task. Placements are broadcast
under the same bound, by their count.

Defined results: one row a (doc_id, item_id) at least one row of which matches; null or empty texts and items
match nothing. Repeated documents give one row. A null doc_id or item_id is a value like others. Items that
repeat an item_id give the best of them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import document_columns, row_key, write_table

SPAN = 8
#: The token places that each mask looks at. By enumeration, an item of 8 to 25 tokens keeps a seed of one of them
#: whatever fifth of its tokens is substituted.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 4, 5, 7), (1, 2, 3, 4, 5), (0, 1, 4, 5, 7), (0, 1, 2, 3, 4))
LEAST = 12
#: The part of an item's tokens that is enough at one placement.
SHARE = 0.8
MISS = -2
BROADCAST_SEEDS = 1_000_000
SALTS = 8
BLOCK = 64


def tokens(text: Column) -> Column:
    # a function of a lambda is evaluated before generated code begins, so once a text and not once for each row that a join or generator makes of it
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeded(df: DataFrame, shorts: list[int], *keep: str) -> DataFrame:
    """Rows of (keep..., n, mask, at, seed), a row for each token and mask; `at` is the token it starts at, a mask that reaches past the end has a null seed.

    `shorts` are the lengths of whole short items, which have masks of their own. A row for each BLOCK tokens, then
    one for each token come first, so that seeds are made by generated code and no row holds a long text's tokens.
    """
    masks = [(k, at, SPAN) for k, at in enumerate(MASKS)] + [(len(MASKS) + m, tuple(range(m)), m) for m in shorts]
    df = df.withColumn("hashes", F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w))).withColumn("n", F.size("hashes"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")), lambda b: F.slice("hashes", b * BLOCK + 1, F.lit(BLOCK + SPAN - 1)))
    # the outer forms: for the inner ones a filter on the array's size is derived and pushed down, with all that makes it
    df = df.select(*keep, "n", F.posexplode_outer(F.when(F.col("n") > 0, blocks)).alias("block", "part"))
    df = df.select(*keep, "n", "block", "part", F.explode_outer(F.sequence(F.lit(0), F.least(F.col("n") - F.col("block") * BLOCK, F.lit(BLOCK)) - 1)).alias("i"))
    at = F.col("block") * BLOCK + F.col("i")
    each = [F.when(at + span <= F.col("n"), F.xxhash64(F.lit(k), *[F.get("part", F.col("i") + j) for j in places])) for k, places, span in masks]
    df = df.select(*keep, "n", at.alias("at"), F.posexplode_outer(F.array(*each)).alias("k", "seed"))
    return df.select(*keep, "n", F.get(F.array(*[F.lit(k) for k, _, _ in masks]), F.col("k")).alias("mask"), "at", "seed")


def placements(texts: DataFrame, items: DataFrame, broadcast_seeds: int) -> DataFrame:
    """(key, item_id, copy, n_item, start): where seeds say that items may lie, written as a table.

    `texts` has (key, text); `items` (item_id, copy, text).
    """
    sizes = items.select(F.size(tokens(F.col("text"))).alias("n")).where(f"n between 1 and {SPAN - 1}").distinct()
    shorts = sorted(r.n for r in sizes.collect())  # SPAN - 1 numbers at most
    known = _seeded(items, shorts, "item_id", "copy").where("seed is not null")
    # a short item stands for itself alone; longer ones have the masks
    short = F.col("mask") == F.col("n") + len(MASKS)
    known = known.where(F.when(F.col("n") < SPAN, short).otherwise(F.col("mask") < len(MASKS))).select("seed", "item_id", "copy", F.col("at").alias("item_at"), F.col("n").alias("n_item")).distinct()
    asked = _seeded(texts, shorts, "key").select("key", "at", "seed").where("seed is not null")
    if known.count() <= broadcast_seeds:
        hits = asked.join(F.broadcast(known), "seed")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = asked.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    return write_table(hits.select("key", "item_id", "copy", "n_item", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "placements")


def matches(docs: DataFrame, benchmark: DataFrame, share: float | None = None, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, start): `start` is the item's first token's place in the text."""
    items = document_columns(benchmark, "item_id", "text").where("text is not null").withColumn("copy", F.xxhash64("text"))
    texts = document_columns(docs, "doc_id", "text").where("text is not null")
    texts = texts.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    laid = placements(texts.select("key", "text"), items, broadcast_seeds)
    whole = items.withColumn("item", tokens(F.col("text"))).select(F.col("item_id").alias("_item"), F.col("copy").alias("_copy"), "item").dropDuplicates(["_item", "_copy"])
    keys = laid.select("key").distinct()
    if laid.count() <= broadcast_seeds:
        laid, keys = F.broadcast(laid), F.broadcast(keys)
    if items.count() <= broadcast_seeds // SPAN:
        whole = F.broadcast(whole)
    held = texts.join(keys, "key", "left_semi").select("key", "doc_id", tokens(F.col("text")).alias("words"))
    parts = held.join(laid, "key").select(
        "doc_id", "item_id", "copy", "start",
        F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("n_item") + F.least("start", F.lit(0))).alias("part"),
    )
    # where the item starts before the text, its first tokens have no partner
    met = parts.join(whole, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("copy") == F.col("_copy")))
    equal = F.zip_with(F.slice("item", F.greatest(-F.col("start"), F.lit(0)) + 1, F.size("part")), "part", lambda a, b: F.when(a == b, 1).otherwise(MISS))
    best = F.aggregate(
        equal, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda s, x: F.struct(F.greatest(s["run"] + x, F.lit(0)).alias("run"), F.greatest(s["best"], s["run"] + x).alias("best")),
    )["best"]
    same = F.size(F.filter(equal, lambda x: x == 1))
    scored = met.select("doc_id", "item_id", F.size("item").alias("item_tokens"), "start", best.alias("matched"), same.alias("same"))
    enough = F.col("matched") >= F.least(F.lit(LEAST), F.ceil(F.col("item_tokens") * 0.8))
    if share is not None:
        enough = enough | (F.col("same") >= F.ceil(F.col("item_tokens") * share))
    found = scored.where(F.when(F.col("item_tokens") < SPAN, F.col("same") == F.col("item_tokens")).otherwise(enough))
    top = F.max(F.struct("matched", "item_tokens", (-F.col("start")).alias("start"))).alias("top")
    return found.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "top.matched", "top.item_tokens", (-F.col("top.start")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float | None = None, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """`docs` without contaminated documents; a null doc_id is contaminated if any row with it is."""
    bad = write_table(matches(docs, benchmark, share, broadcast_seeds).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    if bad.count() <= broadcast_seeds:
        bad = F.broadcast(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad")), "left_anti")

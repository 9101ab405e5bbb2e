"""Sharding by histogram sort: find splitters from exact byte histograms, then exchange once.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of the row's id. Equal texts are
neighbours, so a group of copies stays in one shard unless a splitter has to fall inside it, as with a
group larger than a shard, and large groups can be split by id. Each round counts the exact bytes below
a set of candidate boundaries (probes) in one distributed aggregation, and refines only the intervals
in which a splitter still misses its target by more than the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.runtime import drop_stash, stash

#: Bits of the key that one round of probes resolves: 4096 probes an interval.
STEP = 12
#: Bits of each of the two parts of the key (the sign bit is dropped).
BITS = 60
#: Pieces into which a shard's slots are dealt, by the first bits of both parts.
DEAL = (12, 6)
#: Rows of a piece beyond which it is dealt further by the id's hash, as where one text is on very many rows.
PIECE = 1_000_000


def _part(column: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column, F.lit(seed)), 64 - BITS)


def with_key(docs: DataFrame, text: str, row_id: str, overhead: int, columns: list[str]) -> DataFrame:
    """row (a struct of ``columns``, so that none can clash with those made here), both parts of the key, and the size."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    return docs.select(row, _part(t, 1).alias("_h1"), _part(F.col(f"`{row_id}`").cast("string"), 2).alias("_h2"), (F.octet_length(t).cast("long") + F.lit(overhead)).alias("_size"))


def _probe(key: DataFrame, depth: int, prefixes: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """Exact bytes and rows of the probe intervals within each prefix, in key order.

    A prefix is (first bits of h1, 0) in the upper half of the key, (h1, first bits of h2) in the lower.
    """
    upper = depth < BITS // STEP
    part, left = ("_h1", BITS - STEP * depth) if upper else ("_h2", 2 * BITS - STEP * depth)
    rows, h1 = key, F.lit(0).cast("long") if upper else F.col("_h1")
    if not upper:
        rows = rows.where(F.col("_h1").isin(sorted({a for a, _ in prefixes})))
    if left < BITS:
        rows = rows.where(F.shiftrightunsigned(part, left).isin(sorted({a if upper else b for a, b in prefixes})))
    bins = rows.groupBy(h1.alias("h1"), F.shiftrightunsigned(part, left - STEP).alias("bin")).agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for r in sorted(bins.collect()):  # at most 4096 for each splitter
        at = r["bin"] >> STEP
        out.setdefault((at, 0) if upper else (r["h1"], at), []).append((r["bin"], r["bytes"], r["n"]))
    return out


def splitters(key: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Boundaries (h1, h2): a row lies at or after one if its key is not less."""
    total = key.agg(F.sum("_size")).first()[0] or 0
    slack = total / shards * tolerance / 2
    out: dict[int, tuple[int, int]] = {}
    #: by splitter, the interval that it lies in, and the bytes below that interval
    open_ = {s: ((0, 0), 0) for s in range(1, shards)}
    for depth in range(2 * BITS // STEP):
        if not open_ or not total:
            break
        upper = depth < BITS // STEP
        shift = BITS - STEP * (depth + 1) if upper else 2 * BITS - STEP * (depth + 1)
        bins = _probe(key, depth, sorted({p for p, _ in open_.values()}))
        after = {}
        for s, (prefix, at) in open_.items():
            want = total * s / shards
            for b, size, n in bins[prefix]:
                if at + size >= want:
                    miss, over = want - at, at + size - want
                    if min(miss, over) <= slack or n == 1 or shift == 0 and not upper:
                        edge = (b + (over <= miss)) << shift
                        out[s] = (edge, 0) if upper else (prefix[0], edge)
                    else:
                        after[s] = ((b, 0) if upper else (prefix[0], b)), at
                    break
                at += size
        open_ = after
    return [out.get(s, (0, 0)) for s in range(1, shards)]


def _shard(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters lie at or below a row: a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = cuts[mid]
        h1 = F.col("_h1")
        at_least = (h1 > a) | ((h1 == a) & (F.col("_h2") >= b)) if b else h1 >= a
        return F.when(at_least, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, overhead: int = 8, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs``, and ``size``, ``shard`` (0 to shards-1) and ``slot`` (gapless from 0).

    size is the text's UTF-8 bytes plus ``overhead`` (null: the overhead). Each splitter misses its
    target by at most half of ``tolerance`` of a shard where some boundary does; a boundary between
    rows of equal text is taken only where none between texts does. Rows with equal text and id are
    never parted. Empty input: no rows. Columns named size, shard or slot are replaced.
    """
    from pyspark.sql import Window

    kept = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    keyed = with_key(docs, text, row_id, overhead, kept)
    key = stash(keyed.select("_h1", "_h2", "_size"), "shardkey")
    cuts = splitters(key, shards, tolerance)
    place = {"shard": _shard(cuts), "_a": F.shiftrightunsigned("_h1", BITS - DEAL[0]), "_b": F.shiftrightunsigned("_h2", BITS - DEAL[1])}
    # slots: rows of the pieces before, then the place within; the table of pieces has at most a row for each of 4096
    # times 64 and of the shards, and one or two for every PIECE rows
    by = ["shard", "_a", "_b", "_c"]
    counts = key.withColumns(place).groupBy(*by[:3]).agg(F.count(F.lit(1)).alias("n"))
    large = stash(counts.where(F.col("n") > PIECE).select(*by[:3], F.ceil(F.log2(F.col("n") / PIECE)).cast("int").alias("_bits")), "shardlarge")

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns(place).join(F.broadcast(large), by[:3], "left")
        return rows.withColumn("_c", F.expr(f"coalesce(shiftrightunsigned(_h2, {BITS - DEAL[1]} - _bits) & (shiftleft(1L, _bits) - 1), 0L)")).drop("_bits")

    pieces = dealt(key).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, -1)
    pieces = stash(pieces.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "shardslots")
    drop_stash(key)
    inner = Window.partitionBy(*by).orderBy("_h1", "_h2")
    placed = dealt(keyed).withColumn("_in", F.row_number().over(inner) - 1)
    out = placed.join(pieces, by)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("_size").alias("size"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_in")).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every document; see :func:`shard` for odd rows."""
    from folio.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lean = docs.select("doc_id", "text")
    t = F.coalesce(F.col("text"), F.lit(""))
    got = shard(lean.withColumn("text_crc32", F.crc32(t.cast("binary"))))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))

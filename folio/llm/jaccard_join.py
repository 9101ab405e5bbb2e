"""Similarity join of word n-gram sets by chosen paths.

Texts with equal n-gram sets form one class, told apart by a hash of the set, and one of each goes on. Each
is known by a pool: the POOL least hashes of its set, whose overlap follows the sets' overlap.

A run starts with all sets in one bucket. A bucket is split by tokens: a set goes on to every token of its
pool that a hash of the run and the path so far picks, on average 1/LAMBDA tokens, so that similar sets
mostly go on together along some path and others part. Buckets of one set end; those up to LIMIT are
brute-forced on the pools; in a larger one the sets are held against a few pivots, near ones are linked to
them, the nearest leave, and the others are split again.

A pair at the threshold shares a path of a given depth with a probability that follows from the branching
(:func:`survival`). Runs repeat until the target recall holds at the depth that was really reached: those
of the first level for all sets, further ones for the sets that stood in large buckets. A pair of which one set
never did so met all its chances in brute-forced buckets of the first level.

The links found so, with a generous threshold, only tell which sets may belong together. The whole sets of
every group of such are then compared exactly and the links counted. A group that exceeds a block is first held
to a centre, the grams that most of a few members have: by the triangle inequality of the Jaccard distance,
what is very near the centre is similar, and what differs much in its distance is not. Only the slabs of
distance between which neither is certain are compared, block against block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import kernel
from folio.llm.graph import components
from folio.runtime import scratch, ship, spread, stash, table

N = 5
THRESHOLD = 0.8
POOL = 64
#: A set goes on to 1/LAMBDA tokens: many from the first bucket, then about as many as stay together.
FIRST_LAMBDA, LAMBDA = 0.25, 0.7
#: Sets that are brute-forced together in one task: at first, and after doubling with every level.
LIMIT, MOST = 256, 4096
#: Parts of a pool of PARTED tokens or more, one for each level in turn, so that a path's tokens differ.
PARTS, PARTED = 8, 24
PIVOTS = 8
RECALL = 0.995
#: On the pools: what is as near as CLOSE to a pivot needs no further look, because all that is within the
#: threshold of it is, by the triangle inequality, nearer than CLOSE - 0.2 and so linked to the pivot as LOOSE.
#: The gap of 0.15 is about two and a half standard errors. In a small bucket every set is a pivot, but for
#: those within LEAF_CLOSE of one before.
LOOSE, CLOSE = 0.35, 0.7
LEAF_LOOSE, LEAF_CLOSE = 0.6, 0.95
#: Links up to which one task joins them (16 bytes each); more go through the distributed stars.
LOCAL_LINKS = 1_000_000
#: Rows up to which the table of sets to compare (about a hundred bytes each) is broadcast to find their texts.
BROADCAST_ROWS = 500_000
#: Sets, and bytes of their grams, in one block of the exact comparison.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Levels of distance from a group's centre, and members that the centre is made of.
LEVELS, CENTRE = 200, 16
#: Slack of the similarity test.
SLACK = 1e-9


def survival(threshold: float = THRESHOLD, levels: int = 1) -> float:
    """Probability that a pair at the threshold still shares a path ``levels`` down in one run.

    A shared path has a Poisson number of shared ones below it: a branching process.
    """
    lost = 0.0
    for _ in range(levels - 1):
        lost = math.exp(-threshold / LAMBDA * (1 - lost))
    return 1 - math.exp(-threshold / FIRST_LAMBDA * (1 - lost))


def runs(recall: float = RECALL, threshold: float = THRESHOLD, levels: int = 1) -> int:
    """Runs after which a pair at the threshold was together, ``levels`` down, with the probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, levels))))


def in_groups(frames, key: str):
    """The rows of each run of equal keys; the frames are sorted by the key, groups are of bounded size."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        k = pdf[key].to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1]) + 1
        last = int(cut[-1]) if len(cut) else 0
        yield [pdf.iloc[i:j] for i, j in zip([0, *cut[:-1]], cut, strict=False)] if len(cut) else []
        rest = pdf.iloc[last:]
    if rest is not None and len(rest):
        yield [rest]


def gram_sets(texts: list[str | None], n: int):
    """For each text the sorted distinct hashes of its n-grams; of fewer words, but not none, one of them all."""
    raw = [(t or "").lower().encode() for t in texts]
    for lo, hi in kernel.blocks(raw):
        w = kernel.Words(raw[lo:hi])
        h, at = w.grams(n)
        own = w.owner[at] if len(at) else np.empty(0, np.int64)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[fresh], own[fresh]
        cut = np.searchsorted(own, np.arange(hi - lo + 1))
        for k in range(hi - lo):
            if 0 < w.count[k] < n:
                few = w.hash[w.first[k] : w.first[k + 1]]
                x = np.zeros(1, np.uint64)
                for v in few:
                    x = x * np.uint64(kernel._P) + v
                yield kernel.mix(x)
            else:
                yield h[cut[k] : cut[k + 1]]


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    m = kernel.mix(s)
    return int(m.sum(dtype=np.uint64).view(np.int64)), int(kernel.mix(m ^ np.uint64(7)).sum(dtype=np.uint64).view(np.int64))


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """id, size and two hashes of the set, and the pool, of each row (columns id, text)."""

    @F.pandas_udf("size int, ha long, hb long, pool binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = [(len(s), *_hashes(s), (s[:POOL] >> np.uint64(32)).astype(np.uint32).tobytes()) for s in gram_sets(list(texts), n)]
        return pd.DataFrame(out, columns=["size", "ha", "hb", "pool"])

    return spread(docs).select("id", of("text").alias("s")).select("id", "s.*")


def _as_pool(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32)


def _pick(pool: bytes, path: int, seed: int, rate: float) -> np.ndarray:
    """The paths to which a pool goes on: one for each token that the hash of run and path picks.

    ``seed`` is the level; past the first a large pool offers the level's part of its tokens only.
    """
    p = _as_pool(pool).astype(np.uint64)
    if seed and len(p) >= PARTED:
        rate *= PARTS
        rate, p = rate / len(p), p[kernel.mix(p) % np.uint64(PARTS) == seed % PARTS]
    else:
        rate /= max(1, len(p))
    h = kernel.mix(p ^ kernel.mix(np.array([(path + seed) & 0xFFFFFFFFFFFFFFFF], np.uint64)))
    return kernel.mix(h[h < np.uint64(min(1.0, rate) * (2**64 - 2048))] + np.uint64(1)).view(np.int64)


def _near(pool: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one pool to others (end to end): over the hashes in the range that both cover."""
    ends = np.cumsum(sizes)
    top = np.where(sizes == POOL, flat[ends - 1], np.uint32(0xFFFFFFFF))
    if len(pool) == POOL:
        top = np.minimum(top, pool[-1])
    own = np.repeat(np.arange(len(sizes)), sizes)
    inside = flat <= top[own]
    at = np.searchsorted(pool, flat)
    hit = inside & (pool[np.minimum(at, len(pool) - 1)] == flat)
    both = np.bincount(own[hit], minlength=len(sizes))
    return both / np.maximum(1, np.searchsorted(pool, top, "right") + np.bincount(own[inside], minlength=len(sizes)) - both)


def _laid(pools) -> tuple[np.ndarray, np.ndarray]:
    """Pools end to end, and the length of each."""
    return _as_pool(b"".join(pools)), np.array([len(p) // 4 for p in pools])


class _Sets:
    """Union-find within a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(i), self.root(j)
        self.up[b] = a
        return a != b


class _Forest:
    """Union-find over any numbers."""

    def __init__(self):
        self.number: dict[int, int] = {}
        self.sets = _Sets(0)

    def of(self, x: int) -> int:
        i = self.number.get(x)
        if i is None:
            i = self.number[x] = len(self.number)
            self.sets.up.append(i)
        return i

    def join(self, x: int, y: int) -> bool:
        return self.sets.join(self.of(x), self.of(y))


def _leaf(ids: np.ndarray, pools: list[bytes]) -> list[tuple[int, int]]:
    """Brute force in a small bucket: links enough to join what is near."""
    out, gone, sets = [], np.zeros(len(ids), bool), _Sets(len(ids))
    flat, sizes = _laid(pools)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(len(ids) - 1):
        if gone[i]:
            continue
        near = _near(flat[starts[i] : starts[i + 1]], flat[starts[i + 1] :], sizes[i + 1 :])
        gone[i + 1 :] |= near >= LEAF_CLOSE
        out += [(ids[i], ids[j]) for j in (np.flatnonzero(near >= LEAF_LOOSE) + i + 1).tolist() if sets.join(i, j)]
    return out


def _leaves(frames):
    """Links of all buckets of a task; what is joined already needs no further link."""
    forest = _Forest()
    for groups in in_groups(frames, "path"):
        links = []
        for g in groups:
            ids = g["id"].to_numpy()
            if len(ids) > 1:
                links += [x for x in _leaf(ids, list(g["pool"])) if forest.join(int(x[0]), int(x[1]))]
        yield pd.DataFrame(links, columns=["u", "v"]).astype("int64")


def _holder(level: int):
    """Links of the rows of large buckets to their pivots (path null), and where a row that is close to none goes on."""

    def hold(frames):
        forest = _Forest()
        for pdf in frames:
            links, on = [], []
            for path, g in pdf.groupby("path", sort=False):
                ids, pools, pids = g["id"].tolist(), list(g["pool"]), g["pids"].iloc[0]
                flat, sizes = _laid(pools)
                near = np.stack([_near(_as_pool(p), flat, sizes) for p in g["ppools"].iloc[0]])
                links += [(ids[j], int(pids[k])) for k, j in zip(*np.nonzero(near >= LOOSE), strict=True) if forest.join(ids[j], int(pids[k]))]
                on += [(int(p), ids[j]) for j in np.flatnonzero(near.max(axis=0) < CLOSE).tolist() for p in _pick(pools[j], int(path), level, 1 / LAMBDA)]
            rows = [(None, u, v) for u, v in links] + [(p, i, None) for p, i in on]
            yield pd.DataFrame({"path": pd.array([x[0] for x in rows], "Int64"), "id": pd.array([x[1] for x in rows], "int64"), "pid": pd.array([x[2] for x in rows], "Int64")})

    return hold


def _starter(starts: list[int]):
    def first(frames):
        for pdf in frames:
            chosen = [np.concatenate([_pick(p, s, 0, 1 / FIRST_LAMBDA) for s in starts]) for p in pdf["pool"]]
            n = [len(c) for c in chosen]
            yield pd.DataFrame({"path": np.concatenate(chosen) if chosen else np.empty(0, np.int64), "id": np.repeat(pdf["id"].to_numpy(), n)})

    return first


def descend(sets: DataFrame, starts: list[int]) -> tuple[list[DataFrame], DataFrame | None, int]:
    """The links of the runs ``starts``, the ids that stood in large buckets of the first level, and the depth reached."""
    links: list[DataFrame] = []
    state, level, deep = sets.mapInPandas(_starter(starts), "path long, id long"), 0, None
    while True:
        level += 1
        limit = min(MOST, LIMIT << level - 1)
        state = stash(state, f"paths{level}")
        # a written table: the join below then has an exchange of its own on either side, which Spark splits where a path is hot
        sizes = stash(state.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"sizes{level}")
        state = stash(state.join(sizes, "path"), f"buckets{level}")
        small = state.where(F.col("n") <= limit).join(sets, "id").select("path", "id", "pool")
        links.append(stash(small.repartition("path").sortWithinPartitions("path", "id").mapInPandas(_leaves, "u long, v long"), f"links{level}"))
        large = state.where(F.col("n") > limit)
        if large.isEmpty():
            return links, deep, level
        if deep is None:
            deep = stash(large.select("id").distinct(), "deep")
        # a few pivots for each large bucket, to which all its rows are held where they lie
        large = large.join(sets, "id").select("path", "id", "pool")
        pivots = large.groupBy("path").agg(*[F.min_by(F.struct("id", "pool"), F.xxhash64("id", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
        pivots = stash(pivots.select("path", F.array(*[f"p{k}.id" for k in range(PIVOTS)]).alias("pids"), F.array(*[f"p{k}.pool" for k in range(PIVOTS)]).alias("ppools")), f"pivots{level}")
        held = stash(large.join(pivots, "path").mapInPandas(_holder(level), "path long, id long, pid long"), f"held{level}")
        links.append(held.where("path is null").select(F.col("id").alias("u"), F.col("pid").alias("v")))
        state = held.where("path is not null").select("path", "id").distinct()


def candidate_links(sets: DataFrame, recall: float, threshold: float) -> DataFrame:
    """u, v: links by pools that join, in the end, all sets that may be similar (columns id, pool)."""
    done, depth, links, among = 0, 1, [], sets
    while done < (wanted := runs(recall, threshold, depth)):
        found, deep, reached = descend(among, list(range(done + 1, wanted + 1)))
        links += found
        if deep is None:
            break
        if not done:
            among = stash(sets.join(deep, "id", "left_semi"), "deeppools")
        done, depth = wanted, max(depth, reached)
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def joined(links: DataFrame) -> DataFrame:
    """node and component of links (u, v): by one task where they are few, by alternating stars beyond."""
    links = stash(links, "candidates")
    if links.count() > LOCAL_LINKS:
        return components(links)

    def join(frames):
        forest = _Forest()
        for pdf in frames:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                forest.join(u, v)
        least: dict[int, int] = {}
        roots = {x: forest.sets.root(i) for x, i in forest.number.items()}
        for x, r in roots.items():
            least[r] = min(x, least.get(r, x))
        yield pd.DataFrame({"node": list(roots), "component": [least[r] for r in roots.values()]}).astype("int64")

    return links.coalesce(1).mapInPandas(join, "node long, component long")


# -- the exact comparison -------------------------------------------------------------------------


def _as_set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _compare(g: pd.DataFrame, threshold: float) -> list[tuple[int, int, int]]:
    """Exact similarities between two blocks of a group (``side`` 0 and 1), or within one (all on side 0).

    (key, key, links): the links that a set has there; (key, other, 0): links that join what is similar.
    """
    g = g.drop_duplicates("key")  # rows may repeat
    keys, copies, side = (g[c].to_numpy() for c in ("key", "copies", "side"))
    sets = [_as_set(x) for x in g["grams"]]
    size = np.array([len(s) for s in sets])
    within = not side.any()
    left, right = np.flatnonzero(side == 0), np.arange(len(g)) if within else np.flatnonzero(side)
    if not len(left) or not len(right):
        return []
    flat, own = np.concatenate([sets[j] for j in right]), np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    count, join, out = np.zeros(len(keys), np.int64), _Sets(len(keys)), []
    for i in left:
        at = np.searchsorted(flat, sets[i])
        hits = np.searchsorted(flat, sets[i], "right") - at
        total = int(hits.sum())
        if not total:
            continue
        where = np.repeat(at - (np.cumsum(hits) - hits), hits) + np.arange(total)
        both = np.bincount(own[where], minlength=len(right))
        j = right[both >= threshold * (size[i] + size[right] - both) - SLACK]
        j = j[j > i] if within else j
        count[i] += copies[j].sum()
        count[j] += copies[i]
        out += [(keys[i], keys[k], 0) for k in j.tolist() if join.join(int(i), k)]
    return out + [(k, k, c) for k, c in zip(keys, count, strict=True) if c]


def _compared(threshold: float):
    def of(frames):
        for groups in in_groups(frames, "group"):
            yield pd.DataFrame([x for g in groups for x in _compare(g, threshold)], columns=["u", "v", "n"]).astype("int64")

    return of


def _centre(g: pd.DataFrame) -> pd.DataFrame:
    """The grams that at least half of a few members have."""
    h, n = np.unique(np.concatenate([_as_set(x) for x in g["grams"]]), return_counts=True)
    return pd.DataFrame({"component": [g["component"].iloc[0]], "centre": [h[2 * n >= len(g)].tobytes()]})


def _distance(grams: pd.Series, centre: pd.Series) -> pd.Series:
    """Exact Jaccard distance; to an empty centre, where there is none, 1."""
    out = []
    for x, c in zip(grams, centre, strict=True):
        s, m = _as_set(x), _as_set(c or b"")
        both = len(np.intersect1d(s, m, assume_unique=True))
        out.append(1 - both / max(1, len(s) + len(m) - both))
    return pd.Series(out, dtype="float64")


def _blocks(n: Column, grams: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(grams * 8 / BLOCK_BYTES)).cast("int")


def large_groups(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Comparisons left to do, and what is certain without any, in groups over one block.

    ``members``: key, component, copies, size, n (of the group), grams. The first table has the rows of
    :func:`_compared` (group, key, copies, side, grams); the second key, n (links) and other (a similar set, or null).
    """
    share = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) * F.col("n") < CENTRE * (1 << 20)
    centres = stash(members.where(share).select("component", "grams").groupBy("component").applyInPandas(_centre, "component long, centre binary"), "centres")
    far = stash(members.join(centres, "component", "left").withColumn("d", F.pandas_udf(_distance, "double")("grams", "centre")).drop("centre").dropDuplicates(["key"]), "distances")
    # adjacent levels of distance make a slab of about a block or more; a table of at most LEVELS + 1 rows a group
    level = F.floor(F.col("d") * LEVELS).cast("int")
    levels = far.groupBy("component", level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.sum("copies").alias("copies"), F.min("d").alias("near"), F.max("d").alias("far"), F.min("key").alias("first"))
    before = Window.partitionBy("component").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    held = F.greatest(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK, F.coalesce(F.sum("grams").over(before), F.lit(0)) * 8 / BLOCK_BYTES)
    levels = stash(levels.withColumn("slab", F.floor(held).cast("int")), "levels")
    slabs = levels.groupBy("component", "slab").agg(*[F.sum(c).alias(c) for c in ("n", "grams", "copies")], F.min("near").alias("near"), F.max("far").alias("far"), F.min("first").alias("first"))
    slabs = stash(slabs.withColumn("blocks", _blocks(F.col("n"), F.col("grams"))), "slabs")
    a, b = slabs.alias("a"), slabs.select("component", *[F.col(c).alias(f"b_{c}") for c in ("slab", "copies", "near", "far", "first", "blocks")]).alias("b")
    pairs = a.join(b, "component")
    sure = F.col("far") + F.col("b_far") <= 1 - threshold - SLACK
    apart = F.greatest(F.col("near") - F.col("b_far"), F.col("b_near") - F.col("far")) > 1 - threshold + SLACK
    # certain links of a slab, and the first set of its group's nearest slab, which is similar to all of it if anything is
    known = pairs.where(sure).groupBy("component", "slab").agg(F.sum("b_copies").alias("more"), F.min_by("b_first", "b_slab").alias("hub"), F.max(F.col("slab") == F.col("b_slab")).alias("own"))
    place = levels.select("component", "level", "slab")
    whose = far.withColumn("level", level).join(place, ["component", "level"]).drop("level")
    certain = whose.join(known, ["component", "slab"]).select("key", (F.col("more") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"), F.when(F.col("hub") != F.col("key"), F.col("hub")).alias("other"))
    # uncertain pairs of slabs: each set goes to the blocks that it has to meet
    todo = pairs.where(~sure & ~apart).select("component", "slab", "blocks", "b_slab", "b_blocks")
    block = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    dealt = whose.join(todo, ["component", "slab"]).withColumn("block", block).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    own, other = F.struct("slab", "block"), F.struct(F.col("b_slab").alias("slab"), F.col("b_block").alias("block"))
    lo, hi = F.least(own, other), F.greatest(own, other)
    side = F.when(own == lo, 0).otherwise(1)
    return dealt.select(F.xxhash64("component", lo, hi).alias("group"), "key", "copies", side.alias("side"), "grams"), certain


def similar(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """doc_id, copy_id, class_id and n_links for every row of ``docs``; ids of any type that has an order.

    copy_id: the least id with the same n-gram set. class_id: the least id that links lead to. n_links: rows
    of other ids at or over the threshold, copies included. Texts without words, null or not, link to
    nothing and are classes of their own. Rows that repeat an id count as one if their sets agree; an id with
    several texts gets a row for each. Null ids are one id, less than all others. Empty input: no rows.

    A group of n similar sets gives rows only for its n members; of the comparisons in it those remain that
    the distances from its centre leave open.
    """
    ship(docs.sparkSession)
    with scratch() as keep:
        # a struct orders null ids first, and counts them as one
        known = F.struct(F.col(f"`{row_id}`").isNotNull().alias("known"), F.col(f"`{row_id}`").alias("value"))
        lean = docs.select(known.alias("id"), F.col(f"`{text}`").alias("text"))
        sets = keep(stash(_sets(lean, n), "sets"))
        worded = sets.where("size > 0")
        classes = worded.groupBy("ha", "hb").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.any_value("pool").alias("pool"), F.any_value("size").alias("size"))
        # an id may have several texts: a class is known by its hash, and by the least id in the result
        classes = stash(classes.withColumn("key", F.xxhash64("ha", "hb")), "classes")
        links = candidate_links(classes.select(F.col("key").alias("id"), "pool").dropDuplicates(["id"]), recall, threshold)
        groups = stash(joined(links), "groups")

        # the whole sets of each group, made once
        placed = groups.withColumnRenamed("node", "key").join(classes.drop("pool"), "key")
        counts = stash(placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams")), "groupsizes")
        counts = counts.select("component", "n", (_blocks(F.col("n"), F.col("grams")) > 1).alias("large"))
        chosen = placed.join(counts, "component").select("key", "component", "n", "large", F.col("rep.known").alias("known"), F.col("rep.value").alias("value"), "copies", "size", "ha", "hb")
        chosen = stash(chosen, "chosen")
        chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen  # else all texts go through an exchange
        same = (F.col("t.id.known") == F.col("c.known")) & F.col("t.id.value").eqNullSafe(F.col("c.value"))
        members = stash(_whole(lean.alias("t").join(chosen.alias("c"), same).select("text", "c.*").drop("known", "value"), n), "members")
        large = members.where("large")
        dealt, certain = members.where("not large").select(F.col("component").alias("group"), "key", "copies", F.lit(0).alias("side"), "grams"), None
        if not large.isEmpty():
            more, certain = large_groups(large, threshold)
            dealt = dealt.unionByName(more)
            certain = stash(certain, "certain")
        found = stash(dealt.repartition("group").sortWithinPartitions("group", "key").mapInPandas(_compared(threshold), "u long, v long, n long"), "found")
        pairs, degree = found.where("u <> v").select("u", "v"), found.where("u = v").select(F.col("u").alias("key"), "n")
        if certain is not None:
            pairs = pairs.unionByName(certain.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v")))
            degree = degree.unionByName(certain.select("key", "n"))
        degree = degree.groupBy("key").agg(F.sum("n").alias("more"))
        by_key = classes.join(joined(pairs).withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
        by_key = stash(by_key.withColumn("component", F.coalesce("component", "key")).drop("pool"), "bykey")
        least = by_key.groupBy("component").agg(F.min("rep").alias("class"))
        links_of = (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
        of = keep(stash(by_key.join(least, "component").select("ha", "hb", F.col("rep.value").alias("copy_id"), F.col("class.value").alias("class_id"), links_of), "classof"))
    out = worded.join(of, ["ha", "hb"]).select(F.col("id.value").alias("doc_id"), "copy_id", "class_id", "n_links")
    own = F.col("id.value")
    alone = sets.where("size = 0").select(own.alias("doc_id"), own.alias("copy_id"), own.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def _whole(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the gram sets of their texts, those of which the hashes agree: an id may have several texts."""

    @F.pandas_udf("ha long, hb long, grams binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*_hashes(s), s.tobytes()) for s in gram_sets(list(texts), n)], columns=["ha", "hb", "grams"])

    # not deterministic: else the comparison would become part of the join, and every text be split into grams
    made = rows.withColumn("made", of.asNondeterministic()("text")).where("made.ha = ha and made.hb = hb")
    return made.select("key", "component", "n", "large", "copies", "size", F.col("made.grams").alias("grams"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every document."""
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_sql() -> str:
    words = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least({N}, len(w)) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
own AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS copy FROM l GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(copy, doc_id)) AS copy_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d JOIN class ON class.a = doc_id LEFT JOIN own ON own.a = doc_id"""

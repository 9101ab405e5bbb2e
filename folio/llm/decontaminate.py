"""Benchmark decontamination: hash the windows of test items, scan all token windows, verify, remove.

Words are runs of ASCII letters and digits and of non-ASCII characters, with A-Z lower-cased. A test
item's windows are its runs of ``n`` words, or all its words where it has fewer. The windows of a benchmark of up
to BLOCK_BYTES are broadcast as sorted 64-bit hashes with their words; a document is scanned in one
vectorised pass, and every hash hit is compared word by word. Of a larger benchmark only a filter of fixed size is
broadcast; the document windows that pass it are joined with the benchmark's by their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import kernel
from folio.runtime import scratch, ship, spread, stash, table

#: Words of a window.
N = 10
#: Bytes of item texts up to which the windows themselves are broadcast.
BLOCK_BYTES = 16 << 20
#: Bits of the filter that stands for a larger benchmark.
FILTER_BITS = 1 << 27
#: Texts with hits up to which these are broadcast to the documents.
BROADCAST_ROWS = 100_000
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(range(256)).replace(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Windows:
    """The windows of some items: for each length sorted hashes with item and first word, 16 bytes a window.

    The items' words stay in their texts, from which a hit is verified.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = [i for i, _ in items]
        self.raw = [(t or "").encode().translate(_LOWER) for _, t in items]
        self.spans: list[tuple[np.ndarray, np.ndarray]] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for lo, hi in kernel.blocks(self.raw):
            w = kernel.Words(self.raw[lo:hi])
            for k in range(hi - lo):
                words = slice(w.first[k], w.first[k + 1])
                self.spans.append(((w.start[words] - w.text_start[k]).astype(np.int32), (w.end[words] - w.text_start[k]).astype(np.int32)))
            for size in {n, *(int(c) for c in w.count if 0 < c < n)}:
                h, at = w.grams(size)
                if size < n:  # of an item of so many words
                    h, at = h[w.count[w.owner[at]] == size], at[w.count[w.owner[at]] == size]
                if len(h):
                    found.setdefault(size, []).append((h, (w.owner[at] + lo).astype(np.int32), (at - w.first[w.owner[at]]).astype(np.int32)))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for size, parts in found.items():
            h, item, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.tables[size] = h[order], item[order], first[order]
            bits = min(24, max(16, int(len(h) * 8).bit_length()))
            self.filters[size] = np.zeros(1 << bits, bool)
            self.filters[size][(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True

    def words(self, item: int, first: int, size: int) -> list[bytes]:
        starts, ends = self.spans[item]
        return [self.raw[item][starts[j] : ends[j]] for j in range(first, first + size)]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the merged ranges of hit words, and the items with occurring windows."""
        texts = [t.translate(_LOWER) for t in texts]
        for lo, hi in kernel.blocks(texts):
            w = kernel.Words(texts[lo:hi])
            hits: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
            for size, (known, item, begin) in self.tables.items():
                h, at = w.grams(size)
                mask = np.uint64(len(self.filters[size]) - 1)
                maybe = np.flatnonzero(self.filters[size][(h & mask).astype(np.int64)])
                left = np.searchsorted(known, h[maybe])
                right = np.searchsorted(known, h[maybe], "right")
                for i, a, b in zip(maybe[left < right], left[left < right], right[left < right], strict=True):
                    first = int(at[i])
                    words = [w.buf[w.start[j] : w.end[j]] for j in range(first, first + size)]
                    ks = {int(item[x]) for x in range(a, b) if self.words(int(item[x]), int(begin[x]), size) == words}
                    if ks:
                        spans, items = hits.setdefault(int(w.owner[first]), ([], set()))
                        spans.append((first, first + size))
                        items |= ks
            for k in range(hi - lo):
                if k not in hits:
                    yield int(w.count[k]), [], []
                    continue
                base, merged = int(w.first[k]), []
                for a, b in sorted(hits[k][0]):
                    if merged and a - base <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(merged[-1][1], b - base))
                    else:
                        merged.append((a - base, b - base))
                yield int(w.count[k]), merged, sorted({self.names[i] for i in hits[k][1]})


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """i (the id as text; empty for null) and t of the items with a text."""
    return benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null")


_KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``n_words``, ``hit_spans`` (word ranges, merged) and ``items`` (sorted).

    Null and empty texts have no words and no hits; items without words have no windows; equal rows get
    equal results. Columns with those names are replaced. With a benchmark of up to BLOCK_BYTES nothing is
    shuffled; with a larger one, of any size, only what passes the filter is.
    """
    ship(docs.sparkSession)
    items = _items(benchmark, item_id, item_text)
    docs = docs.drop("n_words", "hit_spans", "items")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return _broadcast_hits(docs, items, n, text) if size <= BLOCK_BYTES else _joined_hits(docs, items, n, text)


def _broadcast_hits(docs: DataFrame, items: DataFrame, n: int, text: str) -> DataFrame:
    held = [(r["i"], r["t"]) for r in items.collect()]  # at most BLOCK_BYTES
    out = spread(docs)
    inside = _inner(out.columns)
    windows = docs.sparkSession.sparkContext.broadcast(Windows(held, n))
    hit = out.withColumn(inside, _scanner(windows)(F.col(f"`{text}`")))
    return hit.select(*[F.col(f"`{c}`") for c in out.columns], *[F.col(inside)[c].alias(c) for c in ("n_words", "hit_spans", "items")])


def _inner(columns: list[str], name: str = "_hits") -> str:
    """A name that none of the columns has."""
    while name in columns:
        name += "_"
    return name


# -- benchmarks of any size -----------------------------------------------------------------------


def _window(w: kernel.Words, first: int, size: int) -> str:
    """The words of a window, joined by blanks."""
    return b" ".join(w.buf[w.start[j] : w.end[j]] for j in range(first, first + size)).decode()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """item, size, win (its words) and the bit of the filter of every window."""

    def of(frames):
        for pdf in frames:
            for i, t in zip(pdf["i"], pdf["t"], strict=True):
                w = kernel.Words([t.encode().translate(_LOWER)])
                if size := min(n, int(w.count[0])):
                    h, at = w.grams(size)
                    yield pd.DataFrame({"item": i, "size": size, "win": [_window(w, k, size) for k in at.tolist()], "bit": _bits(h)})

    return items.mapInPandas(of, "item string, size int, win string, bit long")


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter's bits, packed, of FILTER_BITS at most whatever the benchmark, and the sizes of windows."""
    word = F.shiftright("bit", 5)
    packed = windows.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    for r in packed.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out, [r["size"] for r in windows.select("size").distinct().collect()]


def _passing(docs: DataFrame, known, text: str) -> DataFrame:
    """a, b (hashes of the text), first, size and win of the document windows that pass the filter."""

    @F.pandas_udf("array<struct<first: int, size: int, win: string>>")
    def of(texts: pd.Series) -> pd.Series:
        bits, sizes = known.value
        out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
        raw = [(t or "").encode().translate(_LOWER) for t in texts]
        for lo, hi in kernel.blocks(raw):
            w = kernel.Words(raw[lo:hi])
            for size in sizes:
                h, at = w.grams(size)
                b = _bits(h)
                for first in at[(bits[b >> 5] >> (b & 31).astype(np.uint32) & 1) == 1].tolist():
                    k = int(w.owner[first])
                    out[lo + k].append((first - int(w.first[k]), size, _window(w, first, size)))
        return pd.Series(out)

    t = F.col(f"`{text}`")
    rows = spread(docs.where(t.isNotNull()).select(t.alias("t")))
    found = rows.select(F.xxhash64("t").alias("a"), F.xxhash64("t", F.lit(1)).alias("b"), of("t").alias("w"))
    return found.where(F.size("w") > 0).select("a", "b", F.explode("w").alias("w")).select("a", "b", "w.*").distinct()


def _joined_hits(docs: DataFrame, items: DataFrame, n: int, text: str) -> DataFrame:
    """The hits by a join on the windows' words; rows are told apart by their texts alone."""
    t = F.col(f"`{text}`")
    with scratch() as keep:
        windows = stash(_item_windows(items, n).distinct(), "windows")
        known = docs.sparkSession.sparkContext.broadcast(_filter(windows))
        passing = stash(_passing(docs, known, text), "passing")
        hits = stash(passing.join(windows.select("size", "win", "item"), ["size", "win"]).select("a", "b", "first", "size", "item"), "hits")
        known.unpersist()
        span = F.array(F.col("first").cast("long"), (F.col("first") + F.col("size")).cast("long"))
        every = hits.groupBy("a", "b").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
        by_text = keep(stash(every.select("a", "b", F.aggregate("spans", F.expr("cast(array() as array<array<bigint>>)"), _merge).alias("hit_spans"), "items"), "hitsbytext"))
        by_text = F.broadcast(by_text) if by_text.count() <= BROADCAST_ROWS else by_text

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(_WORD.findall(t.encode().translate(_LOWER))) if t else 0 for t in texts], dtype="int64")

    rows = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), count(t).alias("n_words"), F.xxhash64(t).alias("a"), F.xxhash64(t, F.lit(1)).alias("b"))
    none = [F.coalesce(F.col(c), F.expr(f"cast(array() as {kind})")).alias(c) for c, kind in (("hit_spans", "array<array<bigint>>"), ("items", "array<string>"))]
    return rows.join(by_text, ["a", "b"], "left").select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "n_words", *none)


def _merge(done, span):
    last = F.element_at(done, -1)
    meets = (F.size(done) > 0) & (F.get(span, 0) <= F.get(last, 1))
    joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(F.get(last, 0), F.greatest(F.get(last, 1), F.get(span, 1)))))
    return F.when(F.size(done) == 0, F.array(span)).when(meets, joined).otherwise(F.concat(done, F.array(span)))


def _scanner(windows):
    @F.arrow_udf(_KIND)
    def scan(column: pa.Array) -> pa.Array:
        texts = [b"" if t is None else t.encode() for t in column.to_pylist()]
        got = list(windows.value.scan(texts))
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([[list(s) for s in g[1]] for g in got], pa.list_(pa.list_(pa.int64()))), pa.array([g[2] for g in got], pa.list_(pa.string()))], ["n_words", "hit_spans", "items"])

    return scan.asNondeterministic()


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + F.get(s, 1) - F.get(s, 0))


def remove_documents(docs: DataFrame, benchmark: DataFrame, least: float = 0.0, n: int = N) -> DataFrame:
    """The rows of ``docs`` of which at most the share ``least`` of words is hit (0: none), columns as they were."""
    hits = find_hits(docs, benchmark, n)
    return hits.where(n_hit() <= F.lit(least) * F.col("n_words")).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """All rows, with the hit words and what stands between them cut out of ``text``."""
    hits = find_hits(docs, benchmark, n, text)

    @F.pandas_udf(T.StringType())
    def without(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or len(s) == 0 else _cut(t, s))

    return hits.withColumn(text, without(F.col(f"`{text}`"), "hit_spans")).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cut(text: str, spans) -> str:
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_LOWER))]
    out, end = [], 0
    for a, b in spans:
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode()


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """A digest of the hits of every document; see :func:`find_hits` for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_hits(docs, table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def op6_sql() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least({N}, len(w)) AS size, array_to_string(w[i:i + least({N}, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least({N}, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM wins),
d AS (SELECT doc_id, coalesce({words}, []) AS w FROM documents),
dw AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, wins.item FROM dw JOIN wins USING (size, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + size)) AS r(p) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

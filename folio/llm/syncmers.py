"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's units are its runs of up to UNIT non-blank characters; a longer run is cut after certain characters, and
scripts without blanks are cut after each character, so that where units begin depends on the characters there
and an insertion shifts none of those behind it. A k-mer of K units is a closed syncmer if the least of its S-mers stands at its first
or last place. Whether it is depends on the k-mer alone, so an edit changes only the anchors that
touch it, and every window of K - S + 1 k-mers holds at least one. All anchors with their positions serve for
positional matching. The fingerprint is a sketch of them, the SIZE least anchor hashes in order; the likeness of two
fingerprints is the share of the least hashes of both that both hold, an estimate with a standard error of at most
0.0625 of the share of anchors in common, and exact for texts of up to SIZE anchors together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.runtime import scratch, stash, table

K, S, UNIT, SIZE = 5, 2, 12, 64
#: Characters of scripts that are written without blanks, and those after which a long run is cut.
_DENSE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uA960-\uA97F\uAC00-\uD7FF\uF900-\uFAFF"
_ENDS = "".join(f"\\x{c:02x}" for c in range(0x21, 0x7F) if c % 4 == 1)
#: First what goes fast: a unit begins with no blank, and most are characters of one range between two blanks. The two
#: choices that are made twice, by a small class and by the full one, find the same.
_UNIT = rf"(?:[!-\u0DFF]{{1,{UNIT}}}+(?=[ \n])|[^\s{_DENSE}]{{1,{UNIT}}}(?![^\s{_DENSE}]))"
UNITS = rf"(?=\S)(?:(?:(?<=[ \n])|(?<![^\s{_DENSE}])){_UNIT}|[{_DENSE}]|[^\s{_DENSE}{_ENDS}]*[{_ENDS}]|[^\s{_DENSE}{_ENDS}]+)"
#: The id that a null id counts as.
NULL_ID = -(1 << 63)


def anchors(text: Column) -> Column:
    """The anchors of a text as structs (pos: index of the first unit, hash), in order.

    A text of fewer than K units, but not none, has one anchor of all its units; an empty or null one none.
    """
    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), F.lit(0)), lambda u: F.xxhash64(u))

    def of(units: Column) -> Column:
        smers = F.zip_with(units, F.slice(units, S, F.greatest(F.size(units), F.lit(1))), lambda a, b: F.xxhash64(a, b))

        def closed(smers: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(units) - K)
            edge = lambda i: F.least(F.get(smers, i), F.get(smers, i + (K - S)))
            inner = lambda i: F.least(*[F.get(smers, i + j) for j in range(1, K - S)])
            return F.transform(F.filter(at, lambda i: edge(i) <= inner(i)), lambda i: F.struct(i.alias("pos"), F.pmod(F.xxhash64(F.slice(units, i + 1, K)), F.lit(1 << 32)).alias("hash")))

        whole = F.array(F.struct(F.lit(0).alias("pos"), F.pmod(F.xxhash64(units), F.lit(1 << 32)).alias("hash")))
        none = F.filter(whole, lambda _: F.lit(False))
        return F.when(F.size(units) == 0, none).when(F.size(units) < K, whole).otherwise(_let(smers, closed))

    return _let(units, of)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def _least(found: Column) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda a: a["hash"]))), 1, SIZE)


def sketch(text: Column) -> Column:
    """The SIZE least distinct anchor hashes, ascending."""
    return _least(anchors(text))


def as_text(least: Column) -> Column:
    return F.array_join(F.transform(least, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches; two empty ones are alike."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SIZE)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``fingerprint``: a string, empty for null, empty and blank texts.

    Equal texts have equal fingerprints. A column of that name is replaced; nothing is shuffled.
    """
    return docs.withColumn("fingerprint", as_text(sketch(F.col(f"`{text}`"))))


def positional_matches(a: Column, b: Column) -> Column:
    """Anchors that ``a`` and ``b`` each have once, as structs (a, b: their positions), in the order of the hashes.

    Both lists are sorted together, where a match is two neighbours of one hash that no third one joins.
    """
    tagged = lambda x, side: F.transform(x, lambda y: F.struct(y["hash"].alias("hash"), F.lit(side).alias("side"), y["pos"].alias("pos")))

    def of(both: Column) -> Column:
        at = lambda i: F.get(both, i)
        same = lambda i, j: F.coalesce(at(i)["hash"] == at(j)["hash"], F.lit(False))
        pair = lambda i: same(i, i + 1) & (at(i)["side"] < at(i + 1)["side"]) & ~same(i, i - 1) & ~same(i + 1, i + 2)
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(both) - 2, F.lit(0))), pair)
        return F.transform(firsts, lambda i: F.struct(at(i)["pos"].alias("a"), at(i + 1)["pos"].alias("b")))

    return _let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), of)


def next_ids(ids: DataFrame) -> DataFrame:
    """``ids`` (unique column k) with ``next_k``, the next greater; after the last the first.

    The ids are dealt into ranges and sorted there; the first id of each range, one row for each
    partition, closes the gaps between them.
    """
    ranged = stash(ids.repartitionByRange("k").withColumn("_p", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("_p").agg(F.min("k").alias("first"))
    order = Window.orderBy("_p")  # a row for each partition
    after = firsts.withColumn("after", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy(F.lit(0))))).drop("first")
    inner = Window.partitionBy("_p").orderBy("k")
    return ranged.withColumn("next_k", F.lead("k").over(inner)).join(F.broadcast(after), "_p").select(*[c for c in ids.columns], F.coalesce("next_k", "after").alias("next_k"))


def edited(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``k``, ``text`` and ``least`` (sketch) of each row, with ``edited`` text and ``next_least``.

    Ids are whole numbers, or strings of such; other types raise an error. The least whole number counts as null.

    The last quarter of a text's code points gives way to the first as many of the next row's, by ascending
    id. Of rows with one id the least text is the next; null ids come first, null texts are empty.
    """
    base = docs.select(F.coalesce(F.col(f"`{row_id}`").cast("long"), F.lit(NULL_ID)).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    with scratch() as keep:
        links = keep(stash(next_ids(base.groupBy("k").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))), "links"))
    keyed = base.withColumn("least", sketch(F.col("text")))
    heads = keyed.join(links.select(F.col("k").alias("before"), F.col("next_k").alias("k"), "need"), "k")
    heads = heads.groupBy(F.col("before").alias("k")).agg(F.min(F.struct(F.expr("left(text, cast(need as int))").alias("head"), F.col("least"))).alias("h"))
    whole = keyed.join(heads, "k")
    quarter = F.floor(F.length("text") / 4).cast("int")
    return whole.select("k", "text", "least", F.concat(F.left("text", F.length("text") - quarter), F.left("h.head", quarter)).alias("edited"), F.col("h.least").alias("next_least"))


def op8_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and the anchors that both have once; see :func:`edited` for odd rows."""
    got = edited(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, other = anchors(F.col("text")), anchors(F.col("edited"))
    got = got.select("k", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "least", "next_least", own.alias("own"), other.alias("other"))
    got = got.withColumns({"edited_least": _least(F.col("other")), "n_matched": F.size(positional_matches(F.col("own"), F.col("other"))).cast("long"), "n_anchors": F.size("own").cast("long")})
    return got.select(
        F.nullif(F.col("k"), F.lit(NULL_ID)).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("least")).alias("fingerprint"), as_text(F.col("edited_least")).alias("edited_fingerprint"),
        likeness(F.col("least"), F.col("edited_least")).alias("near_edited"), likeness(F.col("least"), F.col("next_least")).alias("near_next"),
        "n_anchors", "n_matched",
    )

"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared as their character 5-grams, trimmed and lower-cased. A line's signature is made of minima of
hashes of its grams over UTF-8 bytes: of all grams of a short line, of a sample of a longer one. The sample is
the grams that begin with certain bytes, so it depends on the grams alone, and two similar lines sample alike.
Lines near the length at which the sample changes are signed both ways, so a pair always has a signature in common.

The hash of a gram, exclusive-or a constant, is one of BANDS hash functions; the remainder of the hash parts the grams
into ROWS classes, and a band is the minima of one function in all classes. Lines of one band are candidates,
in two rounds: each line is paired with a few lines that are first in its bands, which joins most of a large
group at the cost of its size; then all lines of a band that the links so far leave in different components are
compared with one another, in blocks, whatever the band's size. A sketch of the minima screens the pairs, the exact Jaccard similarity decides, connected components follow, and of
each component one line stays: the first in the document of the least id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.graph import components
from folio.runtime import drop_stash, scratch, stash, table

GRAM = 5
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.992 at 0.8, 0.9997 at 0.85, for minima
#: of all grams. Lines that have 0.3 in common, as unrelated ones of a language may, do so once in ninety pairs.
BANDS, ROWS = 16, 6
THRESHOLD = 0.8
#: By sample: the least and one past the greatest length in bytes, and by which classes of bytes a sampled gram
#: begins, as remainder and modulus. All grams of short lines; about one in seven, and one in fourteen, of longer ones.
SAMPLES = ((0, 64, ()), (48, 160, ()), (120, 640, ((0, 3), (0, 2))), (512, 1 << 31, ((0, 3), (0, 2), (1, 2))))
#: Classes by sample: a short line has too few grams for six, as a class of a single gram changes all bands with it.
CLASSES = (3, ROWS, ROWS, ROWS)
#: A line that only repeats up to this many bytes has a band of its own, as its length says nothing about its grams.
PERIOD = 4
#: The columns of a signature's sketch, one a class: BITS of each of its first PACKED minima.
SKETCH, BITS, PACKED = ("s0", "s1", "s2", "s3", "s4", "s5"), 5, 12
#: Of the sketch's 72 minima, those in which the signatures of a candidate pair have to agree: nearly five standard
#: errors below what a pair at the threshold has, and above what most pairs of similarity 0.5 have.
AGREE = 41
#: The id that a null id counts as.
NULL_ID = -(1 << 63)
#: Rows up to which a table of line ids (16 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: A band seen this often among a sixty-fourth of the lines is aggregated and joined instead of windowed.
HOT = 64
#: Lines of a band outside its main component that are compared with the whole band in one key of a join.
BLOCK = 256
#: Bands of a line that are shuffled at a time.
PORTION = 4
#: Lines, each first in a band of it, that a line is held against before its bands are compared in whole.
FIRSTS = 4
#: Words of 64 bits into which the grams of a line are hashed, to rule out pairs before the exact comparison.
WORDS = 32
#: What is trimmed from a line's ends.
BLANKS = " \t\r\f\x0b"


def _constant(i: int) -> int:
    """The i-th constant of the hash functions (splitmix64, signed)."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    z = (z ^ z >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def _grams(line: Column) -> Column:
    """All character 5-grams, lower-cased; a shorter line is one gram."""
    line = F.lower(line)
    return F.when(F.length(line) <= GRAM, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{GRAM}}}))."), F.lit(1)))


def grams(line: Column) -> Column:
    """The distinct character 5-grams, as 32-bit hashes.

    Two of a line's few hundred grams collide once in some ten thousand lines, which moves the similarity by
    a fraction of a percent.
    """
    return F.array_distinct(F.transform(_grams(line), lambda g: F.hash(g)))


def _alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two sets reaches the threshold; the sets are intersected once, and only where their sizes allow it."""
    t, n = F.lit(threshold), F.size(x) + F.size(y)
    reached = lambda k: k / (n - k) >= t  # noqa: E731  with k members in common
    k = F.ceil(n * t / (t + 1)).cast("int")
    need = F.when(reached(k - 1), k - 1).when(reached(k), k).otherwise(k + 1)  # whichever way the quotient was rounded
    return (F.least(F.size(x), F.size(y)) >= t * F.greatest(F.size(x), F.size(y))) & (F.size(F.array_intersect(x, y)) >= need)


def _lines(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """id, th (hash of the text), pos, line (trimmed of blanks, tabs and carriage returns) and its hash lid, for lines that are not blank.

    Null ids are the least. Lines that differ in case only have one hash.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.select(F.coalesce(F.col(f"`{row_id}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(t).alias("th"), F.posexplode(F.split(t, "\n")).alias("pos", "line"))
    return out.withColumn("line", F.btrim("line", F.lit(BLANKS))).where("line <> ''").withColumn("lid", F.xxhash64(F.lower("line")))


def _near(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


def _beginning(rest: int, modulus: int) -> str:
    """The class of bytes, as characters, that leave ``rest``."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(0x09, 0x100) if b % modulus == rest) + "]"


def _sampled(raw: Column, sample: int) -> Column:
    """The 5-grams of a sample without their first byte, and how the line begins."""
    first, *more = [_beginning(*x) for x in SAMPLES[sample][2]]
    return F.concat(F.array(F.left(raw, F.lit(GRAM))), F.regexp_extract_all(raw, F.lit(f"(?s){first}(?=({''.join(more)}.{{{GRAM - 1 - len(more)}}}))"), F.lit(1)))


def _periodic(raw: Column) -> Column:
    """A number for a line that repeats up to PERIOD bytes, whatever its length and where it begins; null for others."""
    out = F.lit(None).cast("long")
    for p in range(PERIOD, 0, -1):
        again = lambda n: F.left(F.repeat(F.left(raw, F.lit(p)), F.ceil(n / p).cast("int")), n)  # noqa: B023, E731  used at once
        n = F.length(raw)
        fits = (n >= GRAM + PERIOD) & (F.left(raw, F.lit(8)) == again(F.lit(8))) & (raw == again(n))
        least = F.least(*[F.substring(raw, i + 1, p) for i in range(p)]) if p > 1 else F.left(raw, F.lit(1))
        out = F.when(fits, F.xxhash64(F.lit(p), least)).otherwise(out)
    return out


def signatures(lines: DataFrame) -> DataFrame:
    """lid, id (the least), n (occurrences), own, again, bands and sketch of every distinct line and sample.

    One exchange of the lines. ``own``: whether it is the first of the line's samples; ``again``: see _periodic.
    """
    # grouped by the hash alone, so that the minima below find their rows together without another exchange
    distinct = lines.groupBy("lid").agg(F.any_value("line").alias("line"), F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    raw = distinct.select("lid", "id", "n", F.encode(F.lower("line"), "UTF-8").alias("utf8")).withColumn("raw", F.decode("utf8", "ISO-8859-1"))
    size = F.octet_length("utf8")
    samples = F.array_compact(F.array(*[F.when((size >= lo) & (size < hi), k) for k, (lo, hi, _) in enumerate(SAMPLES)]))
    keys = ["lid", "sample", "nth", "id", "n", "again"]
    each = raw.select("lid", "id", "n", "utf8", "raw", _periodic(F.col("raw")).alias("again"), F.posexplode(samples).alias("nth", "sample"))
    # all grams by their places, cut from the bytes at once; sampled ones by an expression that a line passes in one go
    all_ = F.col("sample") < 2
    places = F.when(all_, F.sequence(F.lit(1), F.greatest(size - GRAM + 1, F.lit(1)))).otherwise(F.array(F.lit(0)))
    shingles = F.when(all_, F.array(F.lit(""))).when(F.col("sample") == 2, _sampled(F.col("raw"), 2)).otherwise(_sampled(F.col("raw"), 3))
    each = each.select(*keys, "utf8", "raw", F.explode(places).alias("at"))
    each = each.select(*keys, "utf8", "at", F.explode(shingles).alias("s"))
    each = each.select(*keys, F.when(F.col("at") > 0, F.xxhash64(F.substring("utf8", F.col("at"), F.lit(GRAM)))).otherwise(F.xxhash64("s")).alias("h"))
    each = each.groupBy(*keys, F.pmod("h", F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col("sample"))).alias("class")).agg(*[F.min(F.col("h").bitwiseXOR(F.lit(_constant(i)))).alias(f"m{i}") for i in range(BANDS)])
    packed = F.lit(0).cast("long")
    for i in range(PACKED):
        packed = packed.bitwiseOR(F.shiftleft(F.shiftrightunsigned(f"m{i}", 8).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * i))
    bands = [F.bit_xor(F.xxhash64("class", F.col(f"m{i}"))).alias(f"b{i}") for i in range(BANDS)]
    sketch = [F.coalesce(F.max(F.when(F.col("class") == k, packed)), F.lit(0)).alias(c) for k, c in enumerate(SKETCH)]
    signed = each.groupBy(*keys).agg(*bands, *sketch)
    keyed = [F.xxhash64(F.lit(i), "sample", f"b{i}") for i in range(BANDS)]
    return signed.select("lid", "sample", "id", "n", (F.col("nth") == 0).alias("own"), "again", F.array(*keyed).alias("bands"), *SKETCH)


def _agreeing(a: str, b: str) -> Column:
    """Minima in which two sketches agree."""
    out = F.lit(PACKED * len(SKETCH))
    firsts = sum(1 << BITS * i for i in range(PACKED))
    for s in SKETCH:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        differ = x
        for i in range(1, BITS):
            differ = differ.bitwiseOR(F.shiftrightunsigned(x, i))
        out = out - F.bit_count(differ.bitwiseAND(F.lit(firsts)))
    return out


def _enough(sample: Column) -> Column:
    """The agreement that a pair of signatures needs; classes that a sample hasn't got agree in any case."""
    need = [PACKED * (ROWS - c) + -(-AGREE * c // ROWS) for c in CLASSES]
    return F.get(F.array(*[F.lit(n) for n in need]), sample)


def shared_bands(signed: DataFrame) -> DataFrame:
    """band, lid, sample and first (the band's first line in an order of its own) of all rows of bands that several lines have.

    Windows by band; the bands that a sample of the lines shows to be hot are aggregated and joined, with the same result.
    The bands are taken PORTION at a time, as a shuffle of all is the most that lies on disk at once.
    """
    sampled = signed.where(F.pmod("lid", F.lit(64)) == 0).select(F.explode("bands").alias("band"))
    hot = stash(sampled.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= HOT).select("band"), "hotbands")
    few = hot.isEmpty()
    whole = Window.partitionBy("band")
    # lines stand in another order in each band, so that a line meets different ones in its bands
    place = F.col("lid").bitwiseXOR(F.col("band"))
    parts = []
    for k in range(0, BANDS, PORTION):
        rows = signed.select("lid", "sample", F.explode(F.slice("bands", k + 1, PORTION)).alias("band"))
        cold = rows if few else rows.join(hot, "band", "left_anti")
        out = cold.withColumns({"first": F.min(place).over(whole), "last": F.max(place).over(whole)}).where("first <> last").drop("last")
        if not few:
            rest = rows.join(hot, "band", "left_semi")
            firsts = stash(rest.groupBy("band").agg(F.min(place).alias("first")), "hotfirsts")
            out = out.unionByName(rest.join(firsts, "band").select(out.columns))
        parts.append(stash(out.select("band", "lid", "sample", F.col("first").bitwiseXOR(F.col("band")).alias("first")), "sharedbands"))
    shared = parts[0]
    for x in parts[1:]:
        shared = shared.unionByName(x)
    return shared


def _first_pairs(shared: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs u < v of a line with up to FIRSTS lines that are first in most of its bands, of which the sketches agree."""
    votes = shared.where("lid <> first").groupBy("lid", "sample", "first").agg(F.count(F.lit(1)).alias("k"))
    # a line has no more of them than bands
    most = F.slice(F.sort_array(F.collect_list(F.struct("k", "first")), False), 1, FIRSTS)
    pairs = votes.groupBy("lid", "sample").agg(most.alias("most")).select("lid", "sample", F.explode("most.first").alias("first"))
    pairs = pairs.select("sample", F.least("lid", "first").alias("u"), F.greatest("lid", "first").alias("v")).distinct()
    sketch = signed.select("lid", "sample", *SKETCH)
    at = lambda x, y: (F.col(f"p.{x}") == F.col(f"{y}.lid")) & (F.col("p.sample") == F.col(f"{y}.sample"))
    held = pairs.alias("p").join(sketch.alias("x"), at("u", "x")).join(sketch.alias("y"), at("v", "y"))
    return held.where(_agreeing("x", "y") >= _enough(F.col("p.sample"))).select("p.u", "p.v").distinct()


def _periodic_pairs(signed: DataFrame) -> DataFrame:
    """The lines that repeat a few bytes, each with the first of its kind."""
    rows = signed.where("own and again is not null").select("lid", "again")
    firsts = stash(rows.groupBy("again").agg(F.min("lid").alias("first")), "periods")
    return rows.join(firsts, "again").where("lid <> first").select(F.least("lid", "first").alias("u"), F.greatest("lid", "first").alias("v"))


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of bands in blocks, as x all of them and as y those outside their band's main component, at most about BLOCK a block."""
    y = rows.where("component <> main").withColumn("block", F.pmod(F.xxhash64("lid"), F.col("blocks")).cast("int"))
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x"), y.alias("y")


def _meet() -> Column:
    """Whether x and y are to be compared: in different components, of agreeing sketches, once for each band that they share."""
    meet = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component"))
    return meet & ((F.col("x.component") == F.col("x.main")) | (F.col("x.lid") < F.col("y.lid"))) & (_agreeing("x", "y") >= _enough(F.col("x.sample")))


def apart(shared: DataFrame, signed: DataFrame, group: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Pairs u, v of similar lines that share a band but no component (of ``group``: lid, component).

    All pairs of which the sketches agree are compared, however many lines a band has: by bits, which rule out
    most that are not similar and none that is, then exactly. First come the rows that agree with any other, as only
    their texts are needed.
    """
    rows = stash(shared.select("band", "lid", "sample").join(group, "lid", "left").withColumn("component", F.coalesce("component", "lid")), "bandrows")
    sizes = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("k"))
    mains = sizes.groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), (F.sum("k") - F.max("k")).alias("others")).where("others > 0")
    mains = stash(mains.select("band", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks")), "mains")
    open_ = stash(rows.join(mains, "band").join(signed.select("lid", "sample", *SKETCH), ["lid", "sample"]), "openbands")
    drop_stash(rows)
    x, y = _sides(open_)
    key = ["band", "lid", "sample"]
    some = x.join(y, _meet(), "left_semi").select(*key).unionByName(y.join(x, _meet(), "left_semi").select(*key))
    some = stash(some.distinct(), "promising")
    ids = stash(some.select("lid").distinct(), "compared")
    sets = stash(_sets(lines.select("lid", "line").join(_near(ids, ids.count()), "lid")), "grams")
    bits = stash(_bits(sets), "bits")
    earlier = F.slice("bands", 1, F.greatest(F.array_position("bands", F.col("band")).cast("int") - 1, F.lit(0)))
    x, y = _sides(open_.join(some, key).join(bits, "lid").join(signed.select("lid", "sample", "bands"), ["lid", "sample"]).withColumn("earlier", earlier).drop("bands"))
    # in the first band that they share
    pairs = x.join(y, _meet() & ~F.arrays_overlap("x.earlier", "y.earlier") & _possible(threshold)).select(F.least("x.lid", "y.lid").alias("u"), F.greatest("x.lid", "y.lid").alias("v"))
    pairs = stash(pairs.distinct(), "mates")
    drop_stash(open_)
    drop_stash(bits)
    return _linked(pairs, sets, threshold)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("lid")).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """lid and grams of each line of ``texts``: lid and line, which may repeat."""
    return texts.groupBy("lid").agg(F.any_value("line").alias("line")).select("lid", grams(F.col("line")).alias("grams"))


def _bits(sets: DataFrame) -> DataFrame:
    """lid, n (grams) and bits: 64 * WORDS of them, of which each gram sets one."""
    h = sets.select("lid", F.explode("grams").alias("h"))
    bit = F.expr("shiftleft(1L, shiftrightunsigned(h, 26))")
    words = [F.coalesce(F.bit_or(F.when(F.pmod("h", F.lit(WORDS)) == w, bit)), F.lit(0)).alias(f"w{w}") for w in range(WORDS)]
    return h.groupBy("lid").agg(F.count(F.lit(1)).cast("int").alias("n"), *words).select("lid", "n", F.array(*[f"w{w}" for w in range(WORDS)]).alias("bits"))


def _possible(threshold: float) -> Column:
    """Whether the bits of x and y allow that similarity: each bit that one has alone is a gram, or more, that it has alone."""
    alone = lambda a, b: F.aggregate(F.zip_with(F.col(f"{a}.bits"), F.col(f"{b}.bits"), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda k, n: k + n)
    both = F.least(F.col("x.n") - alone("x", "y"), F.col("y.n") - alone("y", "x"))
    return both * F.lit(1 + threshold) >= F.lit(threshold) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-6)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs u, v of which the exact similarity reaches the threshold; drops ``sets`` (lid, grams)."""
    held = pairs.join(sets.select(F.col("lid").alias("u"), F.col("grams").alias("x")), "u").join(sets.select(F.col("lid").alias("v"), F.col("grams").alias("y")), "v")
    links = stash(held.where(_alike(F.col("x"), F.col("y"), threshold)).select("u", "v"), "links")
    drop_stash(sets)
    return links


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs u, v of which the exact similarity reaches the threshold; ``texts``: lid and line, which may repeat."""
    return _linked(pairs, stash(_sets(texts), "grams"), threshold)


def removals(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """id, th (hash of the text) and ``removed`` (line numbers from 0, ascending) of each text that loses lines.

    Blank lines are never removed. Null texts have no lines. Rows with one id are one document: of a
    component that it keeps, each of its texts keeps the first line. Null ids come first. Ids are whole
    numbers, or strings of such; other types raise an error.
    """
    with scratch() as keep:
        lines = _lines(docs, text, row_id)
        signed = stash(signatures(lines), "signatures")
        shared = shared_bands(signed)
        again = stash(_periodic_pairs(signed), "periodic")
        first = stash(_first_pairs(shared, signed).unionByName(again).distinct(), "pairs")
        ids = stash(_ends(first).withColumn("candidate", F.lit(True)), "candidates")
        # a second scan: where every line stands, with the texts of these pairs
        placed = lines.join(_near(ids, ids.count()), "lid", "left").select("id", "th", "pos", "lid", F.when(F.col("candidate"), F.col("line")).alias("line"))
        placed = keep(stash(placed, "placed"))
        group = components(verified(first, placed.where("line is not null").select("lid", "line"), threshold)).withColumnRenamed("node", "lid")
        # a third one for the texts of the others
        more = apart(shared, signed, group, lines, threshold)
        if not more.isEmpty():
            group = components(group.select(F.col("lid").alias("u"), F.col("component").alias("v")).unionByName(more)).withColumnRenamed("node", "lid")
        dup = signed.where("own").select("lid", "id", "n").join(group, "lid", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "lid"))
        dup = stash(dup, "duplicates")
        winners = stash(dup.groupBy("component").agg(F.min("id").alias("winner")), "winners")
        dup = keep(stash(dup.select("lid", "component").join(winners, "component"), "removable"))
    here = placed.select("id", "th", "pos", "lid").join(dup, "lid").repartition("id", "th").groupBy("id", "th", "component", "winner").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gone = here.select("id", "th", F.when(F.col("id") == F.col("winner"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at")).alias("gone"))
    return gone.groupBy("id", "th").agg(F.array_sort(F.flatten(F.collect_list("gone"))).alias("removed")).where(F.size("removed") > 0)


def _marked(n: Column) -> Column:
    """For each of ``n`` lines whether it is among ``removed``: the kept runs between removed lines, laid end to end."""
    ends = F.concat(F.col("removed"), F.array(n))
    starts = F.concat(F.array(F.lit(-1)), F.col("removed"))
    runs = F.zip_with(starts, ends, lambda a, b: F.concat(F.array_repeat(F.lit(True), F.when(a >= 0, 1).otherwise(0)), F.array_repeat(F.lit(False), b - a - 1)))
    return F.flatten(runs)


def dedupe_lines(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the removed lines; null and empty texts stay."""
    t = F.col(f"`{text}`")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{row_id}`").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("th"))
    # a removed line is marked at its place, so that each line is looked at once however many go
    lines = F.split(F.col("row").getField(text), "\n")
    cut = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), _marked(F.size(lines)).alias("gone")), lambda x: ~x["gone"]), lambda x: x["line"]), "\n")
    new = F.when(F.col("removed").isNull(), F.col("row").getField(text)).otherwise(cut)
    joined = own.join(removals(docs, threshold, text, row_id), ["id", "th"], "left")
    return joined.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_kept and removed_lines (numbers from 0) of every document; see :func:`removals` for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lean = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    gone = removals(docs).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "removed")
    joined = lean.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(NULL_ID))).join(gone, ["_id", "_th"], "left")
    removed = F.coalesce("removed", F.expr("cast(array() as array<int>)"))
    return joined.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), (F.greatest("n_lines", F.lit(0)) - F.size(removed)).alias("n_kept"), removed.alias("removed_lines"))

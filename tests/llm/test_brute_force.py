"""Operators that SQL can't express against plain loops over the same definitions."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
import xxhash

from tests.llm.test_llm import frame, prose

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(*values, seed: int = 42) -> int:
    """What xxhash64 of Spark gives for strings and whole numbers, or lists of them."""
    h = seed
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            raw = x.encode() if isinstance(x, str) else (x & MASK).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


# -- 2: language ----------------------------------------------------------------------------------


def lang_buckets(text: str) -> list[int]:
    clean = re.sub(r"[\W\d_]+", " ", text).strip().lower()
    points = [ord(c) for c in f" {clean} "] if clean else []
    out = []
    for k in (1, 2, 3):
        for i in range(len(points) - k + 1):
            h = 0
            for j in range(k):
                h = (h * 0x9E3779B97F4A7C15 + points[i + j] + j + 1) & MASK
            out.append(((h ^ h >> 31) * 0xBF58476D1CE4E5B9 & MASK) >> 48)
    return out


def test_language_by_hand(spark):
    from folio.llm import langid

    rows = [("the cat sat on the mat and the dog", "en"), ("a hat and a bat were there", "en"), ("der Hund und die Katze sind da", "de"), ("Äpfel und Öl für die Küche", "de"), ("le chat et le chien", "fr")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    names = sorted({x for _, x in rows})
    counts = {x: {} for x in names}
    for t, x in rows:
        for b in lang_buckets(t):
            counts[x][b] = counts[x].get(b, 0) + 1
    size = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in names}
    texts = ["the dog", "die Katze", "le chien et la table", "Öl", "x", None, "12 !", "the " * 2000]
    got = langid.identify(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        grams = lang_buckets(t or "")
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scale = min(1.0, langid.EVIDENCE / len(grams))
        z = {x: scale * sum(math.log((counts[x].get(b, 0) + 0.5) / size[x]) for b in grams) + math.log((sum(y == x for _, y in rows) + 1) / (len(rows) + len(names))) for x in names}
        best = max(z, key=z.get)
        post = 1 / sum(math.exp(v - z[best]) for v in z.values())
        assert r["lang_pred"] == best and r["score"] == pytest.approx(post, abs=1e-4)


def test_samples_keep_rare_values():
    from folio.llm.langid import shares

    counts = {"en": 1_000_000, "de": 1_000_000, "fo": 40}
    text = str(shares(counts, "l", 2_000)._jc)
    assert "1.0" in text and text.count("9.8E-4") == 2  # all of the rare one, 980 of each of the others


# -- 4: toxicity ------------------------------------------------------------------------------------


def test_machines_by_windows():
    from folio.llm import toxicity as x

    rng = random.Random(4)
    for _ in range(400):
        s = [rng.choice([x.OTHER] * 6 + [x.INSULT, x.THREAT, x.TARGET, x.NEGATION, x.REPORT]) for _ in range(rng.randrange(40))]
        want = []
        for i, symbol in enumerate(s):
            if symbol in (x.INSULT, x.THREAT):
                aimed = x.TARGET in s[max(0, i - 4) : i] or x.TARGET in s[i + 1 : i + 5]
                kind = ("insult", "threat")[symbol == x.THREAT] + "+target" * aimed
                want.append((i, kind + "+negated" * (x.NEGATION in s[max(0, i - 3) : i]) + "+reported" * (x.REPORT in s[max(0, i - 12) : i])))
        assert x.read(s) == want


def test_clauses_and_apostrophes():
    from folio.llm.toxicity import Grammar

    g = Grammar(["idiot"], [])
    kinds = lambda t: [k for *_, k, _ in g.events(t)]
    assert kinds("You aren’t an idiot") == kinds("You aren't an idiot") == kinds("You can’t be idiot") == ["insult+target+negated"]
    assert kinds("he said " + "that " * 11 + "idiot") == ["insult+target+reported"[:6] + "+reported"]
    far = "x" * 5000 + " you idiot " + "y" * 5000  # a clause longer than any window
    assert kinds(far) == ["insult+target"] and kinds("you. idiot; you") == ["insult"]
    assert [(a, b) for a, b, *_ in g.events("idiot. An idiot! idiot")] == [(0, 5), (10, 15), (17, 22)]


# -- 5: mixing ----------------------------------------------------------------------------------------


def test_posteriors_by_hand(spark):
    from folio.llm import mixing

    rows = [(1, "red green blue red"), (2, "green red blue"), (3, "one two three four"), (4, "four one two")]
    labels = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (4, "c"), (9, "a")], "doc_id long, domain string")
    model = mixing.fit(frame(spark, rows), labels)
    assert model.domains == ["a", "b"]  # of several labels the least counts
    bucket = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B97F4A7C15 & MASK) >> 48
    grams = lambda t: [bucket((t.encode() + b"\n")[i : i + 3]) for i in range(len(t.encode()) - 1)]  # noqa: E731  with the end
    counts = {d: {} for d in "ab"}
    for i, t in rows:
        for b in grams(t):
            d = "a" if i < 3 else "b"
            counts[d][b] = counts[d].get(b, 0) + 1
    prior = {"a": 4 / 7, "b": 3 / 7}  # three labels a and two labels b, one more of each
    docs = [(10, "red two"), (11, "green green blue"), (12, ""), (13, None)]
    got = mixing.mix(frame(spark, docs), model, {"a": 0.5, "b": 0.5}).collect()
    for (_, t), r in zip(docs, sorted(got, key=lambda r: r["doc_id"]), strict=True):
        g = grams(t or "")
        scale = mixing.EVIDENCE / max(mixing.EVIDENCE, len(g))
        z = {d: scale * sum(math.log((counts[d].get(b, 0) + 0.5) / (sum(counts[d].values()) + 0.5 * mixing.BUCKETS)) for b in g) + math.log(prior[d]) for d in "ab"}
        p = 1 / (1 + math.exp(z["b"] - z["a"]))
        assert r["p_a"] == pytest.approx(p, abs=1e-4) and r["n_tokens"] == len((t or "").split())


# -- 8: fingerprints ----------------------------------------------------------------------------------


def brute_anchors(text: str):
    from folio.llm import syncmers as s

    units = [hashed(m.group()) for m in re.finditer(s.UNITS, text, re.ASCII)]
    if not units:
        return []
    if len(units) < s.K:
        return [(0, hashed(units) % (1 << 32))]
    out = []
    for i in range(len(units) - s.K + 1):
        inner = [hashed(units[j], units[j + 1]) for j in range(i, i + s.K - s.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hashed(units[i : i + s.K]) % (1 << 32)))
    return out


def test_anchors_by_hand(spark):
    from pyspark.sql import functions as F

    from folio.llm import syncmers as s

    rng = random.Random(3)
    texts = [prose(rng, 60), "one two", "https://example.org/a/path?with=some&more=parts " + prose(rng, 9), "漢字仮名交じり文の例です。長い文", "".join(rng.choice("abcdefgh0123") for _ in range(400)), ""]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in frame(spark, rows, False).select("doc_id", s.anchors(F.col("text")).alias("a"), s.as_text(s.sketch(F.col("text"))).alias("f")).collect()}
    for i, t in rows:
        want = brute_anchors(t)
        assert [(x["pos"], x["hash"]) for x in got[i]["a"]] == want
        assert got[i]["f"] == "".join(f"{h:08X}" for h in sorted({h for _, h in want})[: s.SIZE])


def test_units_of_prose_cost_little(spark):
    """The pattern of units stays within a few times of the plainest one."""
    from pyspark.sql import functions as F

    from folio.llm import syncmers as s

    rng = random.Random(4)
    docs = frame(spark, [(i, prose(rng, 4000).replace("e", "eé"[i % 2])) for i in range(240)], False).cache()

    def took(pattern):
        began = time.perf_counter()
        docs.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).collect()
        return time.perf_counter() - began

    plain, units = (min(took(p) for _ in range(6)) for p in (r"[^ ]{1,12}", s.UNITS))
    assert units < 1.7 * plain


def test_an_insertion_moves_no_anchor_behind_it(spark):
    """In texts without blanks too: units depend on the characters where they are."""
    from pyspark.sql import functions as F

    from folio.llm import syncmers as s

    rng = random.Random(5)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "".join(map(chr, range(0x4E00, 0x4F00)))):
        t = "".join(rng.choice(alphabet) for _ in range(1200))
        rows = [(1, t), (2, t[:30] + "b" + t[30:])]
        a, b = (r["a"] for r in frame(spark, rows, False).select("doc_id", s.anchors(F.col("text")).alias("a")).orderBy("doc_id").collect())
        assert len({x["hash"] for x in a} - {x["hash"] for x in b}) <= 2 * s.K and len(a) > 100
        pair = spark.createDataFrame([(a, b)], "a array<struct<pos: int, hash: long>>, b array<struct<pos: int, hash: long>>")
        met = pair.select(s.positional_matches(F.col("a"), F.col("b")).alias("m")).first()["m"]
        once = lambda x: {h for h in (y["hash"] for y in x) if sum(z["hash"] == h for z in x) == 1}
        at = [{y["hash"]: y["pos"] for y in x} for x in (a, b)]
        assert sorted((m["a"], m["b"]) for m in met) == sorted((at[0][h], at[1][h]) for h in once(a) & once(b))


# -- 10: shards -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [5, 1_000_000])
def test_shards_are_cuts_of_one_order(spark, monkeypatch, piece):
    from folio.llm import sharding

    monkeypatch.setattr(sharding, "PIECE", piece)

    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(80))) for i in range(600)] + [(1000 + i, "one hot text " * 9) for i in range(300)] + [(None, None), (7777, "")]
    got = sharding.shard(frame(spark, rows), 12).collect()
    assert len(got) == len(rows)
    part = lambda x, seed: xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42 if x is None else hashed(x) & MASK) >> 4
    keyed = sorted(((part(r["text"] or "", 1), part(None if r["doc_id"] is None else str(r["doc_id"]), 2)), r["shard"]) for r in got)
    assert [s for _, s in keyed] == sorted(s for _, s in keyed)  # shards are ranges of the key
    sizes = [0] * 12
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes) / 12
    assert max(abs(x - mean) for x in sizes) <= 0.01 * mean + max(r["size"] for r in got)
    for s in range(12):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))

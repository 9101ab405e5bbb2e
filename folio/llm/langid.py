"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of characters that are not letters become one blank, and the 1- to 3-grams
of what remains are hashed into a fixed number of buckets. The log-probability matrix (buckets times
languages, of fixed size) is broadcast; each batch is scored in numpy by gathering the rows of the
grams that occur.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.runtime import ship, spread, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows that are learned from at most: a sample by hash of the text.
FIT_ROWS = 20_000
#: Characters that are turned into grams at a time.
CHARS = 1 << 19
#: Grams of evidence that count at most; a long text's posterior does not harden without end.
EVIDENCE = 60.0
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _clean(text: str | None) -> str:
    return _NOT_LETTER.sub(" ", text or "").strip().lower()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram of the cleaned texts, and the index of its text."""
    padded = [f" {t} " if t else "" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    idx, own = [], []
    h = np.zeros(len(points), np.uint64)
    for k in range(max(ORDERS)):
        h = h[: len(points) - k] * np.uint64(0x9E3779B97F4A7C15) + points[k:] + np.uint64(k + 1)
        if k + 1 in ORDERS and len(h):
            same = owner[: len(h)] == owner[k:]
            x = h ^ (h >> np.uint64(31))
            x = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            idx.append((x[same] % np.uint64(BUCKETS)).astype(np.int64))
            own.append(owner[: len(h)][same])
    return (np.concatenate(idx), np.concatenate(own)) if idx else (np.empty(0, np.int64), np.empty(0, np.int64))


def _slices(texts: list[str]):
    """Parts of a batch of bounded size, and within a long text pieces that overlap by the longest gram."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 2
        if len(t) > CHARS:
            for j in range(0, len(t), CHARS):
                yield at, [*[""] * (i - at), t[j : j + CHARS]]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


class Model:
    """languages, and log P(bucket | language), with the prior over languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        p = counts + smoothing
        self.matrix = np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32)
        self.prior = np.log((docs + 1) / (docs + 1).sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cleaned = [c if any(map(str.isalpha, c)) else "" for c in map(_clean, texts)]
        total = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts))
        for at, part in _slices(cleaned):
            idx, own = grams(part)
            k = len(part)
            n[at : at + k] += np.bincount(own, minlength=k)
            for lang in range(len(self.languages)):
                total[at : at + k, lang] += np.bincount(own, self.matrix[idx, lang], k)
        scaled = total * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + self.prior
        scaled -= scaled.max(axis=1, keepdims=True)
        post = np.exp(scaled)
        post /= post.sum(axis=1, keepdims=True)
        best = post.argmax(axis=1)
        names = [self.languages[b] if c else "und" for b, c in zip(best, cleaned, strict=True)]
        return names, np.where([bool(c) for c in cleaned], post[np.arange(len(best)), best], 0.0)


def shares(counts: dict[str, int], column: str, rows: int) -> Column:
    """By value of a column the share of its rows that are learned from: all of rare ones, as many of each other."""
    share, left = F.lit(0.0), rows
    for i, (name, n) in enumerate(sorted(counts.items(), key=lambda x: x[1])):
        own = min(1.0, left / (len(counts) - i) / n)
        left -= own * n
        share = F.when(F.col(column) == name, own).otherwise(share)
    return share


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Count grams by language over at most about ``rows`` labelled rows, chosen by hash of the text.

    The rows are dealt evenly over the languages, and what a rare one leaves goes to the others; the prior is of all rows.

    Rows without text or language are left out; without any the model has no language and predicts ``und``.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("t is not null and l is not null")
    whole = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = known.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < shares(whole, "l", rows) * (1 << 30))

    def count(frames):
        for pdf in frames:
            for name, group in pdf.groupby("l"):
                total = np.zeros(BUCKETS, np.int64)
                for _, part in _slices([_clean(t) for t in group["t"]]):
                    total += np.bincount(grams(part)[0], minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"l": name, "bucket": at, "n": total[at]})
                yield pd.DataFrame({"l": [name], "bucket": [-1], "n": [len(group)]})

    counted = sample.mapInPandas(count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most a row for each bucket and language
    names = sorted(set(got["l"])) or ["und"]
    counts, seen = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    column = got["l"].map({k: i for i, k in enumerate(names)}).to_numpy()
    grams_ = (got["bucket"] >= 0).to_numpy()
    counts[got["bucket"][grams_], column[grams_]] = got["n"][grams_]
    seen[column[~grams_]] = got["n"][~grams_]
    return Model(names, counts, np.array([float(whole.get(k, n)) for k, n in zip(names, seen, strict=True)]))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``lang_pred`` and ``score``, the posterior of the predicted language.

    ``und`` with score 0 where the text is null or has no letter. Equal texts get equal results.
    Columns with those names are replaced; nothing is shuffled and a text is scored whole.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(s: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.predict(list(s))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # a row's own columns travel in a struct, so that none can clash with the prediction
    made = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predict(F.col(f"`{text}`")).alias("p"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in keep], "p.lang_pred", "p.score")


def fold(row_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(folds))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the others and their lang alone."""
    docs = table(spark, sf_dir, "documents")
    held = fold("doc_id", 5) == 0
    model = fit(docs.where(~held).select("text", "lang"))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")

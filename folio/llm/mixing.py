"""Mixing to target weights with soft membership.

A classifier learned from a labelled table gives every text its posterior over the domains. Document rates
are then fitted by projected gradient least squares, so that the expected tokens of each domain,
sum of rate * tokens * posterior, match the targets. A step moves a document by the inner product of its
posterior and one vector with an entry a domain, so the state of the descent is the list of these
vectors, the rates are a plain column expression of it, and an iteration is one aggregation of a few sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import kernel
from folio.llm.langid import shares
from folio.runtime import ship, spread, stash, table

BUCKETS = 1 << 16
#: Labelled rows that are learned from at most: a sample by hash of the id.
FIT_ROWS = 12_000
#: Grams of evidence that count at most, and the weight of the prior against them.
EVIDENCE = 60.0
ROUNDS, TOLERANCE = 30, 1e-6


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte 3-grams of the texts, and the index of each one's text."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8).astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    h = (a[:-2] << np.uint64(16) | a[1:-1] << np.uint64(8) | a[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    inside = own[:-2] == own[2:]
    return h[inside].astype(np.int64), own[:-2][inside]


def _pieces(texts: list[bytes]):
    """Blocks of texts, with the longest in overlapping pieces, so that no array grows with a text."""
    for lo, hi in kernel.blocks(texts):
        if hi - lo == 1 and len(texts[lo]) > 2 * kernel.BLOCK:
            for at in range(0, len(texts[lo]), kernel.BLOCK):
                yield lo, [texts[lo][at : at + kernel.BLOCK + 2]]
        else:
            yield lo, texts[lo:hi]


class Classifier:
    """log P(gram | domain) and the prior of each domain; posteriors on a bounded scale of evidence."""

    def __init__(self, domains: list[str], counts: np.ndarray, docs: np.ndarray):
        self.domains = domains
        p = counts + 0.5
        self.matrix = np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32)
        self.prior = np.log((docs + 1) / (docs + 1).sum())

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and tokens (words) of each text; the prior and 0 for null and empty ones."""
        raw = [(t or "").encode() for t in texts]
        total, n = np.zeros((len(raw), len(self.domains))), np.zeros(len(raw))
        for lo, part in _pieces(raw):
            h, own = _grams(part)
            k = len(part)
            n[lo : lo + k] += np.bincount(own, minlength=k)
            for d in range(len(self.domains)):
                total[lo : lo + k, d] += np.bincount(own, self.matrix[h, d], k)
        z = total * (EVIDENCE / np.maximum(EVIDENCE, n))[:, None] + self.prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), np.array([len(t.split()) for t in raw])


def fit(docs: DataFrame, labels: DataFrame, domain: str = "domain", text: str = "text", row_id: str = "doc_id", rows: int = FIT_ROWS) -> Classifier:
    """Learn from at most about ``rows`` labelled rows, chosen by hash of the id, which alone are broadcast.

    The rows are dealt evenly over the domains, and what a rare one leaves goes to the others; the prior is of all rows.

    Null ids, domains and texts are left out; of several labels of an id the least counts. Without labels
    there is one domain, "none".
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(f"`{row_id}`").alias("i"), F.col(f"`{domain}`").alias("y")).dropna().groupBy("i").agg(F.min("y").alias("y"))
    whole = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 30)) < shares(whole, "y", rows) * (1 << 30))
    sample = docs.select(F.col(f"`{row_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").join(F.broadcast(chosen), "i")

    def count(frames):
        for pdf in frames:
            for y, g in pdf.groupby("y"):
                sums = np.zeros(BUCKETS, np.int64)
                for _, part in _pieces([t.encode() for t in g["t"]]):
                    sums += np.bincount(_grams(part)[0], minlength=BUCKETS)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"y": y, "bucket": at, "n": sums[at]})
                yield pd.DataFrame({"y": [y], "bucket": [-1], "n": [len(g)]})

    got = sample.select("t", "y").mapInPandas(count, "y string, bucket long, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toPandas()
    domains = sorted(set(got["y"])) or ["none"]
    counts, docs_ = np.zeros((BUCKETS, len(domains))), np.zeros(len(domains))
    at = got["y"].map({y: i for i, y in enumerate(domains)}).to_numpy()
    grams = (got["bucket"] >= 0).to_numpy()
    counts[got["bucket"][grams], at[grams]] = got["n"][grams]
    docs_[at[~grams]] = got["n"][~grams]
    return Classifier(domains, counts, np.array([float(whole.get(d, n)) for d, n in zip(domains, docs_, strict=True)]))


def memberships(docs: DataFrame, model: Classifier, text: str, columns: list[str]) -> DataFrame:
    """row (a struct of ``columns``), tokens and p (posteriors in the order of ``model.domains``)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))]))
    def of(s: pd.Series) -> pd.DataFrame:
        p, tokens = shared.value.posteriors(list(s))
        return pd.DataFrame({"tokens": tokens, "p": list(p)})

    made = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), of(F.col(f"`{text}`")).alias("m"))
    return made.select("row", "m.tokens", "m.p")


def _rate(steps: list[np.ndarray], least: float) -> Column:
    """The rate of a row after the steps: from 1, each step and the projection in turn."""
    r = F.lit(1.0)
    for z in steps:
        move = sum((F.get("p", k) * float(v) for k, v in enumerate(z)), F.lit(0.0))
        r = F.greatest(F.lit(float(least)), r - move)
    return r


def fit_rates(members: DataFrame, target: np.ndarray, least: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The steps of the descent for the target tokens of each domain.

    The gradient is scaled by the inverse Gram matrix of the rows that can move: those over the bound, and those
    at it that the residual pulls up. So a round that meets no new bound ends at the targets; a step that
    makes the residual larger is halved. Targets out of reach end at the nearest reached within the rounds.
    """
    k = len(target)
    scale = max(1.0, float(np.abs(target).sum()))
    steps: list[np.ndarray] = []
    best, stride, step, pull = np.inf, 1.0, None, np.full(k, -1.0)
    for _ in range(rounds + 1):
        trial = steps if step is None else [*steps, step * stride]
        up = sum((F.get("p", i) * float(v) for i, v in enumerate(pull)), F.lit(0.0)) < 0
        rows = members.select("tokens", "p", _rate(trial, least).alias("rate")).select("tokens", "p", "rate", ((F.col("rate") > least) | up).alias("free"))
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.get("p", i)) for i in range(k)]
        gram = [F.sum(F.when(F.col("free"), F.col("tokens") * F.get("p", i) * F.get("p", j))) for i in range(k) for j in range(i + 1)]
        got = [float(x or 0.0) for x in rows.agg(*sums, *gram).first()]
        miss = (np.array(got[:k]) - target) / scale
        size = float(np.abs(miss).max())
        if size < best:
            steps, best, stride, pull = trial, size, 1.0, miss
            if size <= tolerance:
                break
            m = np.zeros((k, k))
            m[np.tril_indices(k)] = got[k:]
            m = (m + m.T - np.diag(np.diag(m))) / scale
            step = np.linalg.solve(m + np.eye(k) * max(1e-9, 1e-6 * np.trace(m)), miss)
        elif step is None or stride < 1e-3:
            break
        else:
            stride /= 2
    return steps


def mix(docs: DataFrame, model: Classifier, weights: dict[str, float], total: float | None = None, least: float = 0.0, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or ``columns`` alone, ``n_tokens``, a column ``p_<domain>`` each, and ``rate``.

    ``weights``: the shares of the named domains in the ``total`` tokens that they are to have (as many as
    they have, if not given; with ``least`` over 0 at least as many as let every one keep that share of what it
    has). A domain without a weight is to keep what it has.
    Null and empty texts have no tokens and the prior as posterior. Rows that repeat get equal rates.
    Columns of these names are replaced. Empty input: no rows.
    """
    new = ["n_tokens", *(f"p_{d}" for d in model.domains), "rate"]
    kept = [c for c in columns or docs.columns if c not in new]
    # every text is classified once; what the descent reads of the table are two narrow columns
    members = stash(memberships(docs, model, text, kept), "members")
    k = len(model.domains)
    got = members.agg(*[F.sum(F.col("tokens") * F.get("p", i)) for i in range(k)]).first()
    have = np.array([float(x or 0.0) for x in got])
    named = np.array([d in weights for d in model.domains])
    w = np.array([max(0.0, weights.get(d, 0.0)) for d in model.domains])
    w = w / w.sum() if w.sum() else named / max(1, named.sum())
    if total is None:
        total = float(have[named].sum())
        if least > 0:
            total = max([total, *(least * h / x for h, x in zip(have, w, strict=True) if x > 0)])
    target = np.where(named, w * total, have * max(1.0, least))
    steps = fit_rates(members, target, least)
    out = members.withColumn("rate", _rate(steps, least))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("tokens").alias("n_tokens"), *[F.get("p", i).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate")


def repeat(mixed: DataFrame, columns: list[str], salt: int = 5) -> DataFrame:
    """``columns`` of each row as often as its rate says: the whole part, and one more by a hash of the row."""
    u = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.lit(salt)), F.lit(1 << 30)) / (1 << 30)
    times = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return mixed.where(times > 0).select(F.explode(F.array_repeat(row, times)).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in columns])


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain: toxic, or else high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


#: The mixture that query and pipeline aim at.
WEIGHTS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the posterior of each domain and the rate of every document; see :func:`mix` for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, quality_domains(table(spark, sf_dir, "labels")))
    return mix(docs, model, WEIGHTS, columns=["doc_id"])

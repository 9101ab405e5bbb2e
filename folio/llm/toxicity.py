"""Toxicity: a weighted finite-state grammar over clauses.

Lexical transducers turn a clause's words into symbols: insult, threat, target, negation, reporting, other.
Small machines for the scope of a negation, of reported speech and of a target are composed into one
product machine that reads the symbols forwards; one for a target that follows reads them backwards. Where both meet
at an insult or threat they emit an event, such as "insult, aimed at a target, not negated, reported". A clause
is all between two sentence ends or line ends, however long. Each kind of event has a weight, and a text's score is the
logistic of the summed weights of its matched clauses. An isolated word only counts through its event.

Threats, targets, negations and reporting verbs are listed here. Insults are a learned automaton of whole
words and of stems (word beginnings), and the events' weights are learned too, both from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.langid import fold
from folio.runtime import drop_stash, ship, spread, stash, table

#: Labelled rows that are learned from at most: toxic, and other.
FIT_TOXIC, FIT_OTHER = 6_000, 14_000
#: Texts by which a word or stem must be borne out.
SUPPORT = 4
STEMS = (4, 5, 6, 7)

THREATS = "kill murder hurt destroy burn shoot stab strangle matar mataré töten umbringen schlagen tuer tuerai frapper".split()
TARGETS = "you your yours yourself u they them he she him her these those tú te ti usted ustedes vosotros du dich dir ihr euch sie tu toi vous".split()
NEGATIONS = "not no never cannot without nunca jamás nicht kein keine nie niemals ne pas jamais aucun sin ohne sans".split()
REPORTS = "said says say told tells called calls claimed reported wrote quoted quote alleged dijo dice llamó afirmó sagte sagt nannte behauptete dit disait appelé affirmé".split()
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CUT = re.compile(r"[.!?;\n]")

# -- machines -----------------------------------------------------------------------------------

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


def scope(trigger: int, reach: int) -> dict[tuple[int, int], int]:
    """A machine whose state counts down from ``reach`` after the trigger; 0: out of scope."""
    return {(state, symbol): reach if symbol == trigger else max(0, state - 1) for state in range(reach + 1) for symbol in range(6)}


def compose(*machines: dict[tuple[int, int], int]) -> dict[tuple[tuple[int, ...], int], tuple[int, ...]]:
    """The product machine, from the states that can be reached from the start."""
    start = (0,) * len(machines)
    table_, todo = {}, [start]
    seen = {start}
    while todo:
        state = todo.pop()
        for symbol in range(6):
            to = tuple(m[s, symbol] for m, s in zip(machines, state, strict=True))
            table_[state, symbol] = to
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return table_


#: Negation reaches 3 words on, a target 4, and a reporting verb 12.
GRAMMAR = compose(scope(NEGATION, 3), scope(TARGET, 4), scope(REPORT, 12))
#: Read from the end: a target that follows, up to 4 words on.
AHEAD = compose(scope(TARGET, 4))


def read(symbols: list[int]) -> list[tuple[int, str]]:
    """Positions and kinds of the events of a clause."""
    ahead, state = [], (0,)
    for symbol in reversed(symbols):
        ahead.append(state[0])
        state = AHEAD[state, symbol]
    state, out = (0, 0, 0), []
    for i, symbol in enumerate(symbols):
        if symbol in (INSULT, THREAT):
            aimed = state[1] > 0 or ahead[-1 - i] > 0
            out.append((i, ("insult", "threat")[symbol == THREAT] + "+target" * aimed + "+negated" * (state[0] > 0) + "+reported" * (state[2] > 0)))
        state = GRAMMAR[state, symbol]
    return out


KINDS = [k + t + n + r for k in ("insult", "threat") for t in ("", "+target") for n in ("", "+negated") for r in ("", "+reported")]


def _prior(kind: str) -> float:
    """What a kind adds to its word's evidence before any label is seen."""
    return -2.5 if "negated" in kind or "reported" in kind else 0.0


class Grammar:
    """The learned lexicon and weights; ``events`` and ``score`` for one text.

    An entry of the lexicon has the rate at which other texts hold it by chance, for each character, and
    the times that toxic texts hold it on top. The evidence of an event is the Poisson likelihood ratio
    of one more such word in a text of that length, plus the adjustment of the event's kind; a logistic
    fitted to labelled texts turns the sum into a probability.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = words, stems
        self.rates: dict[str, tuple[float, float]] = {}
        self.kinds = {k: _prior(k) for k in KINDS}
        self.slope, self.bias = 1.0, -3.0
        self._ready = False

    def _prepare(self) -> None:
        import ahocorasick

        self._scan = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self._scan.add_word(w, len(w))
        if len(self._scan):
            self._scan.make_automaton()
        self._insults, self._stems = set(self.words), tuple(sorted(self.stems))
        self._other = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self._ready = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("words", "stems", "rates", "kinds", "slope", "bias")} | {"_ready": False}

    def symbol(self, word: str) -> int:
        word = word.replace("’", "'")
        if word in self._insults or self._stems and word.startswith(self._stems):
            return INSULT
        return NEGATION if word.endswith("n't") else self._other.get(word, OTHER)

    def entry(self, word: str) -> str:
        """The entry of the lexicon that a word matches."""
        return word if word in self._insults else next((f"{x}-" for x in self._stems if word.startswith(x)), word)

    def events(self, text: str | None) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and entry of each event; the text is scanned whole, then the clauses that were hit are read."""
        if not self._ready:
            self._prepare()
        if not text or not len(self._scan):
            return []
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, done, begin, lo, upto = [], -1, 0, 0, 0
        for end, size in self._scan.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            if at >= upto:  # on to the clause that holds the hit; each is passed once
                for m in _CUT.finditer(low, upto):
                    if m.start() > at:
                        lo, upto = begin, m.start() + 1
                        begin = m.end()
                        break
                    begin = m.end()
                else:
                    lo, upto = begin, len(low) + 1
            hi = min(upto - 1, len(low))
            found = list(_WORD.finditer(low, lo, hi))
            if any(m.start() <= at < m.end() and self.symbol(m.group()) in (INSULT, THREAT) for m in found):
                out += [(found[i].start(), found[i].end(), kind, self.entry(found[i].group())) for i, kind in read([self.symbol(m.group()) for m in found])]
                done = hi
        return out

    def evidence(self, length: int, kinds: list[str], entries: list[str]) -> float:
        total = 0.0
        for kind, entry in zip(kinds, entries, strict=True):
            rate, more = self.rates.get(entry, (1e-5, 0.05))
            total += max(0.0, math.log1p(more / (rate * max(length, 100))) + self.kinds[kind])
        return min(total, 60.0)

    def score(self, length: int, kinds: list[str], entries: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.evidence(length, kinds, entries)))))


# -- learning -----------------------------------------------------------------------------------


def _features(text: str) -> set[str]:
    """Words, and stems marked by a hyphen, of a text."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:k]}-" for w in words for k in STEMS if len(w) > k}


#: Times more frequent among toxic texts than among others that an entry has to be.
RATIO = 6.0
#: Entries by which a toxic text is to be explained.
DEPTH = 3


def _cover(texts: list[list[str]], toxic: dict[str, int], ratio: dict[str, float]) -> list[str]:
    """Greedy cover of the toxic texts by features, weighed by how much oftener toxic texts have them.

    Every text is to be explained by up to DEPTH entries; of a stem and the words that begin with it one is
    taken. What only goes along with a group of copies gains little, as the group counts once.
    """
    by_feature: dict[str, set[int]] = {}
    for i, t in enumerate(texts):
        for f in t:
            by_feature.setdefault(f, set()).add(i)
    least = max(SUPPORT, 0.01 * len(texts))
    need, taken = [DEPTH] * len(texts), []
    gain = lambda f: (len(by_feature[f]) * math.log(ratio[f]) * (0.8 if f.endswith("-") else 1.0), len(f), f)
    while by_feature:
        best = max(by_feature, key=gain)
        if len(by_feature[best]) < least:
            break
        taken.append(best)
        for i in by_feature[best]:
            need[i] -= 1
        shut = {i for i in by_feature[best] if not need[i]}
        root = best.rstrip("-")
        for f in list(by_feature):
            if f.startswith(root) if best.endswith("-") else f == best or f.endswith("-") and best.startswith(f[:-1]):
                del by_feature[f]
            elif f.endswith("-") and root.startswith(f[:-1]):
                del by_feature[f]
            else:
                by_feature[f] -= shut
    return taken


def _logistic(rows: list[tuple[int, float]]) -> tuple[float, float]:
    """Slope and bias by Newton's method, with a weak pull to slope 1 and bias -3."""
    import numpy as np

    if not rows:
        return 1.0, -3.0
    y, e = np.array(rows, float).T
    x = np.stack([np.minimum(e, 20.0), np.ones_like(e)])
    start, pull = np.array([1.0, -3.0]), np.array([1.0, 0.1])

    def loss(w):
        z = w @ x
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * pull @ (w - start) ** 2)

    w = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag(pull), x @ (p - y) + pull * (w - start))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:  # damped: the curve flattens out
            step = step / 2
        w = w - step
    return float(max(0.2, w[0])), float(min(0.0, w[1]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "toxic", toxic_rows: int = FIT_TOXIC, other_rows: int = FIT_OTHER) -> Grammar:
    """Learn the lexicon and the weights from at most about ``toxic_rows`` and ``other_rows`` labelled rows.

    The rows are chosen by hash of the id; an id with several labels counts as toxic if one says so, null
    labels and texts are left out, and without toxic rows the lexicon is empty. Only the chosen ids, of
    bounded number, are broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(f"`{row_id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("i").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, toxic_rows / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, other_rows / max(1, n.get(0, 0)))))
    chosen = known.where(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    sample = stash(docs.select(F.col(f"`{row_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("t is not null").join(F.broadcast(chosen), "i").select("t", "y"), "toxicfit")

    def of_toxic(frames):
        """The features of a text, with its group of near copies."""
        for pdf in frames:
            for t in pdf["t"]:
                if fs := sorted(_features(t)):
                    yield pd.DataFrame({"f": fs, "k": _group(t)})

    borne = sample.where("y = 1").mapInPandas(of_toxic, "f string, k long").distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    toxic = {r["f"]: r["n"] for r in borne.collect()}  # features of a bounded sample
    wanted = spark.sparkContext.broadcast(frozenset(toxic))

    def of_other(frames):
        for pdf in frames:
            seen = Counter(f for t in pdf["t"] for f in _features(t) & wanted.value)
            if seen:
                yield pd.DataFrame({"f": list(seen), "n": list(seen.values())})

    other = {r["f"]: r["n"] for r in sample.where("y = 0").mapInPandas(of_other, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    total = {r["y"]: (r["n"], r["c"]) for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("c")).collect()}
    rows = {y: total.get(y, (0, 0))[0] + 1.0 for y in (0, 1)}
    times = {f: (k + 0.5) / rows[1] / ((other.get(f, 0) + 0.5) / rows[0]) for f, k in toxic.items()}
    telling = spark.sparkContext.broadcast(frozenset(f for f, k in times.items() if k >= RATIO))

    @F.pandas_udf(T.StructType([T.StructField("m", T.ArrayType(T.StringType())), T.StructField("k", T.LongType())]))
    def members(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"m": [sorted(_features(t) & telling.value) for t in s], "k": [_group(t) for t in s]})

    texts = {r["m"]["k"]: list(r["m"]["m"]) for r in sample.where("y = 1").select(members("t").alias("m")).toLocalIterator()}
    taken = _cover([texts[k] for k in sorted(texts)], toxic, times)
    grammar = Grammar([f for f in taken if not f.endswith("-")], [f[:-1] for f in taken if f.endswith("-")])

    found = stash(_found(sample, spark.sparkContext.broadcast(grammar)).drop("t"), "toxicevents")
    for r in found.select("y", F.explode("entries").alias("e")).groupBy("e").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("other")).collect():
        rate = (r["other"] + 0.5) / (total.get(0, (0, 0))[1] + 1000.0)
        grammar.rates[r["e"]] = rate, max(0.02, (r["toxic"] - rate * total.get(1, (0, 0))[1]) / rows[1])
    sums = {r["kind"]: (r["toxic"], r["other"]) for r in found.select("y", F.explode(F.array_distinct("kinds")).alias("kind")).groupBy("kind").agg(F.count_if(F.col("y") == 1).alias("toxic"), F.count_if(F.col("y") == 0).alias("other")).collect()}
    usual = [sum(x[i] for x in sums.values()) + 1.0 for i in (0, 1)]
    for k, (a, b) in sums.items():
        shift = math.log((a + 1.0) / usual[0]) - math.log((b + 1.0) / usual[1])
        trust = (a + b) / (a + b + 5.0)
        grammar.kinds[k] = trust * max(-4.0, min(1.0, shift)) + (1 - trust) * _prior(k)
    # a number for each row of the bounded sample
    grammar.slope, grammar.bias = _logistic([(r["y"], grammar.evidence(r["length"], r["kinds"], r["entries"])) for r in found.toLocalIterator()])
    drop_stash(sample)
    drop_stash(found)
    return grammar


def _group(text: str) -> int:
    """The smallest hash of the runs of four words: near copies mostly share it, other texts hardly."""
    import xxhash

    w = _WORD.findall(text.lower())
    return min((xxhash.xxh64_intdigest(" ".join(w[i : i + 4])) >> 1 for i in range(max(1, len(w) - 3))), default=0)


def _found(docs: DataFrame, grammar, text: str = "t") -> DataFrame:
    """``docs`` with the kinds and entries of the events of each text, and its length."""

    @F.pandas_udf(T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("entries", T.ArrayType(T.StringType()))]))
    def events(s: pd.Series) -> pd.DataFrame:
        got = [grammar.value.events(t) for t in s]
        return pd.DataFrame({"kinds": [[e[2] for e in g] for g in got], "entries": [[e[3] for e in g] for g in got]})

    return docs.withColumn("_e", events(F.col(f"`{text}`"))).select("*", "_e.kinds", "_e.entries", F.length(f"`{text}`").alias("length")).drop("_e")


_MATCH = T.StructType([T.StructField("toxicity", T.DoubleType()), T.StructField("matches", T.ArrayType(T.StringType()))])


def score(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and ``toxicity`` (0 to 1) and ``matches`` ("start:end:kind" of each event).

    Null and empty texts score as texts without events. Equal texts score equally; columns with those names
    are replaced. Nothing is shuffled and a text is scanned whole.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf(_MATCH)
    def of(s: pd.Series) -> pd.DataFrame:
        g = shared.value
        got = [g.events(t) for t in s]
        return pd.DataFrame({"toxicity": [g.score(len(t or ""), [x[2] for x in e], [x[3] for x in e]) for t, e in zip(s, got, strict=True)], "matches": [[f"{x[0]}:{x[1]}:{x[2]}" for x in e] for e in got]})

    # a row's own columns travel in a struct, so that none can clash with the result
    made = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), of(F.col(f"`{text}`")).alias("of"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("toxicity", "matches")], "of.toxicity", "of.matches")


def learned(spark, sf_dir: str) -> Grammar:
    train = fold("doc_id", 3) != 1
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(train))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see :func:`score` for odd rows."""
    got = score(table(spark, sf_dir, "documents").select("doc_id", "text"), learned(spark, sf_dir))
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))

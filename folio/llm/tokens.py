"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary, a row of tokens is an encoding exactly when each two neighbours stay two
tokens if encoded together. So the last token of every prefix of a word is unique, and

    count[prefix] = count[prefix without its last token] + 1

gives the exact count at every prefix in one pass. White space always parts words, so counts add up
over the pieces of a text, and a text's table of prefix counts answers how many tokens a cut-off text
has, and where to cut for a budget, without encoding anything again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.runtime import ship, spread

#: Characters of a piece beyond which a table holds every place in it.
LONG = 32
#: Pieces, and words, of which a worker remembers the counts: this many new ones, and the generation before.
MEMO = 400_000

#: A word, or a word and signs after it, that any lower-casing word-level splitter cuts at that place.
_PLAIN = re.compile(r"([a-zß-öø-ÿāăąćĉċčďđēĕėęěğñœšž]+)[!-&(-/:-@\[-`{-~]*")
#: The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others for U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512))) | {b: b for b in _PRINTED}

#: ASCII white space parts a text into pieces that the tokenizer never joins.
_PIECE = re.compile(r"[^ \t\n\r\f\v]+")


class PrefixCounter:
    """Exact token counts of every prefix of a text for a word-level BPE tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError(f"{path}: only plain BPE vocabularies are supported")
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)): i for i, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        names = str(spec.get("normalizer")) + str(spec.get("pre_tokenizer"))
        self.plain = "Lowercase" in names and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in names
        self.longest = max(map(len, self.vocab))
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        #: beginnings of the vocabulary's entries that don't end a word
        self.starts = {t[:k] for t in self.vocab if not (self.end and t.endswith(self.end)) for k in range(1, len(t) + 1)}
        self._pair: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}
        self._memo: dict[str, int] = {}
        self._memo_before: dict[str, int] = {}
        self._word: dict[str, int] = {}
        self._word_before: dict[str, int] = {}

    # -- the dynamic program over one pre-token ----------------------------------------------

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE over symbols."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str) -> list[str]:
        """The single characters of a token; the last of a final one bears the word end."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            s = list(token[: -len(self.end)])
            s[-1] += self.end
            return s
        return list(token)

    def _stays(self, a: str, b: str) -> bool:
        """Whether two tokens side by side remain these two tokens."""
        got = self._pair.get((a, b))
        if got is None:
            if len(self._pair) > 4 * MEMO:
                self._pair.clear()
            got = self._pair[a, b] = self._merge(self._symbols(a) + self._symbols(b)) == [a, b]
        return got

    def _whole(self, token: str) -> bool:
        """Whether a vocabulary entry is what its own characters encode to."""
        got = self._own.get(token)
        if got is None:
            got = self._own[token] = self._merge(self._symbols(token)) == [token]
        return got

    def _open(self, w: str) -> tuple[list[str | None], list[int]]:
        """For every prefix of ``w`` that the word goes on after: its last token, and its tokens."""
        n = len(w)
        last: list[str | None] = [None] * n
        count = [0] * n
        if n:
            last[0] = ""
        vocab, starts, own, pair = self.vocab, self.starts, self._own, self._pair
        for i in range(n - 1):
            before = last[i]
            for j in range(i + 1, n):
                t = w[i:j]
                if t not in starts:
                    break
                if last[j] is not None or t not in vocab:
                    continue
                if (own[t] if t in own else self._whole(t)) and (not i or (pair[before, t] if (before, t) in pair else self._stays(before, t))):
                    last[j], count[j] = t, count[i] + 1
        return last, count

    def _closed(self, w: str, last: list[str | None], count: list[int]) -> int:
        """Tokens of ``w`` ended as a word, given its open prefixes."""
        for i in range(max(0, len(w) - self.longest), len(w)):
            t = w[i:] + self.end
            if t in self.vocab and self._whole(t) and (not i or self._stays(last[i], t)):
                return count[i] + 1
        raise AssertionError(f"no encoding of {w!r}")

    def word_prefixes(self, w: str) -> list[int]:
        """Tokens of w[:0], w[:1], ... w, each ended as a word; ``w`` in the byte alphabet."""
        last, count = self._open(w + "x" if w else w)
        return [0, *(self._closed(w[:j], last, count) for j in range(1, len(w) + 1))]

    def word_count(self, w: str) -> int:
        """Tokens of one pre-token: the end of the same program."""
        got = self._word.get(w)
        if got is None:
            got = self._word_before.get(w)
            if got is None:
                got = self._closed(w, *self._open(w)) if w else 0
            if len(w) <= 64:
                if len(self._word) >= MEMO:
                    self._word_before, self._word = self._word, {}
                self._word[w] = got
        return got

    # -- pieces and texts ---------------------------------------------------------------------

    def _pretokens(self, piece: str) -> list[str]:
        """The pre-tokens in the byte alphabet; plain ASCII words with or without a sign need no library."""
        if self.plain and (m := _PLAIN.fullmatch(low := piece.lower())) and len(low) == len(piece):
            word, signs = low[: m.end(1)], low[m.end(1) :]
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_ALPHABET)
            return [word, signs] if signs else [word]
        t = self.tokenizer
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(piece))]

    def piece_count(self, piece: str) -> int:
        """Tokens of a piece without white space; special strings in it count as the library has them."""
        got = self._memo.get(piece)
        if got is None:
            got = self._memo_before.get(piece)
            if got is None:
                got = self._count(piece, self.specials)
            if len(piece) <= 64:
                if len(self._memo) >= MEMO:
                    self._memo_before, self._memo = self._memo, {}
                self._memo[piece] = got
        return got

    def _count(self, piece: str, specials: list[str]) -> int:
        n, at = 0, 0
        while specials and (hits := [(i, s) for s in specials if (i := piece.find(s, at)) >= 0]):
            i, s = min(hits, key=lambda x: (x[0], -len(x[1])))
            n += sum(map(self.word_count, self._pretokens(piece[at:i]))) + 1
            at = i + len(s)
        return n + sum(map(self.word_count, self._pretokens(piece[at:] if at else piece)))

    def piece_prefixes(self, piece: str) -> list[int]:
        """Tokens of piece[:0], piece[:1], ... piece, from the programs of its pre-tokens."""
        t = self.tokenizer
        text = t.normalizer.normalize_str(piece) if t.normalizer else piece
        if any(s in piece for s in self.specials) or len(text) != len(piece):  # characters of both don't correspond
            return [self.piece_count(piece[:k]) for k in range(len(piece) + 1)]
        out, done = [0], 0
        for word, (a, b) in t.pre_tokenizer.pre_tokenize_str(text):
            counts, size = self.word_prefixes(word), 0
            for c in text[a:b]:
                size += len(c.encode())
                out.append(done + counts[size])
            done = out[-1]
        return out if len(out) == len(piece) + 1 else [self.piece_count(piece[:k]) for k in range(len(piece) + 1)]

    def table(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ends of prefixes in characters, and the token count of the text up to each.

        Every piece's end, and every place within a piece of more than LONG characters.
        """
        ends, counts, n = [], [], 0
        memo, count = self._memo.get, self.piece_count
        for m in _PIECE.finditer(text or ""):
            p = m.group()
            if len(p) > LONG:
                inside = self.piece_prefixes(p)
                ends += range(m.start() + 1, m.end())
                counts += [n + x for x in inside[1:-1]]
                n += inside[-1]
            else:
                got = memo(p)
                n += count(p) if got is None else got
            ends.append(m.end())
            counts.append(n)
        return ends, counts

    def total(self, text: str | None) -> int:
        """The last entry of the table."""
        memo, count, n = self._memo.get, self.piece_count, 0
        for p in _PIECE.findall(text or ""):
            got = memo(p)
            n += count(p) if got is None else got
        return n

    def at(self, text: str, chars: int, table: tuple[list[int], list[int]]) -> int:
        """Tokens of text[:chars]: the table's count of the prefix before, and that of what the open piece has up to there."""
        ends, counts = table
        i = bisect_right(ends, chars)
        if i and ends[i - 1] == chars:
            return counts[i - 1]
        m = _PIECE.search(text, ends[i - 1] if i else 0)
        done = counts[i - 1] if i else 0
        return done + (self.piece_prefixes(m.group())[chars - m.start()] if m and m.start() < chars else 0)

    def cut(self, text: str, budget: int, table: tuple[list[int], list[int]]) -> int:
        """The most characters whose tokens fit the budget: the last prefix of the table that does, and what of the next piece does."""
        ends, counts = table
        i = next((k for k in range(len(counts) - 1, -1, -1) if counts[k] <= budget), -1)
        done, at = (counts[i], ends[i]) if i >= 0 else (0, 0)
        m = _PIECE.search(text, at)
        if m is None:
            return at
        inside = self.piece_prefixes(m.group())  # the open piece alone
        k = max(k for k, n in enumerate(inside) if not k or done + n <= budget)
        return m.start() + k if k else at


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the exact token count of ``text``.

    Null and empty texts and those of white space only have 0 tokens. Equal rows get equal counts.
    An existing column of the name ``out`` is replaced. No shuffle; a text is never cut.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def total(s: pd.Series) -> pd.Series:
        c = counter(tokenizer)
        return s.map(c.total, na_action=None).astype("int64")

    return spread(docs).withColumn(out, total(F.col(f"`{text}`")))


def prefix_tables(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``prefix_ends``, ``prefix_counts``: the stored table of each text.

    Empty arrays for null and empty texts.
    """
    ship(docs.sparkSession)
    kind = T.StructType([T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def tables(s: pd.Series) -> pd.DataFrame:
        c = counter(tokenizer)
        got = [c.table(t) for t in s]
        return pd.DataFrame({"ends": [g[0] for g in got], "counts": [g[1] for g in got]})

    own = [c for c in docs.columns if c not in ("prefix_ends", "prefix_counts")]
    made = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tables(F.col(f"`{text}`")).alias("table"))
    return made.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("table.ends").alias("prefix_ends"), F.col("table.counts").alias("prefix_counts"))


def truncate(tables: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Cut each text at the last prefix of its table that fits ``budget``: array look-ups, no encoding.

    That is the end of a piece, or any place in a long one. Null texts stay null.
    """
    fits = F.filter(F.arrays_zip("prefix_ends", "prefix_counts"), lambda x: x["prefix_counts"] <= int(budget))
    end = F.coalesce(F.array_max(F.transform(fits, lambda x: x["prefix_ends"])), F.lit(0))
    return tables.withColumn(text, F.left(F.col(f"`{text}`"), end))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; null texts have no bytes and no tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))

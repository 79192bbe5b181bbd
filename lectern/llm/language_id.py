"""Language identification by segmentation-marginalised unigrams.

Each language has one probability for every piece of a fixed public vocabulary.  A word's probability
in a language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is
the product over its words (lower-cased runs of letters, with the vocabulary's word-start mark).

Training is one expectation step over all training texts: under a start distribution that falls with
the piece's rank, forward-backward gives the expected number of uses of each piece in each word, and
these are summed by (language, piece).  A task holds one bounded table of word counts and sends at most
languages x pieces sums, so neither the shuffle nor the model grows with the corpus.

Defined results: a null text and one without a letter get ``und`` and score 0, and so does every
text when nothing could be learned; ties go to the first language in code point order; rows without
a language are never trained on; repeated rows give equal rows; extra columns pass through
``identified`` (columns named like its results are replaced); an empty table gives an empty result.
Words are never cut: those of more than 40 letters, and those whose probability comes near the end of a
double's range (letters that a large corpus never showed), are computed with logarithms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, unwrapped, wrapped

START = "▁"
UNKNOWN = 1e-7
#: Longer words, and those with a smaller probability in any language, are computed with logarithms.  Up to this length the start
#: distribution stays inside a double's range; above the bound what plain doubles lose does not show.
PLAIN_LETTERS, PLAIN_LEAST = 40, 1e-250
ALPHA = 0.05
#: Distinct words whose counts a training task holds before it folds them into piece sums.
COUNTED_WORDS = 300_000
#: Words a worker keeps scored (one row of doubles each; a full table starts anew), words of texts that it
#: scores together, and words whose lattices are built together.
SCORED_WORDS, TOGETHER, WORDS_AT_ONCE = 400_000, 100_000, 20_000
#: Letters of words that are computed with logarithms together (one longer word goes alone).
LETTERS_AT_ONCE = 200_000
UNDETERMINED = "und"
FOLDS = 5
LETTERS = regex.compile(r"\p{L}+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary (pieces that lower-case words can use) and the lattices of words.

    All pieces inside a batch of words are found in one pass of an Aho-Corasick automaton over the joined
    words; a piece only has the word-start mark in front, so no match crosses a word.  Forward and backward then
    run over the batch position by position.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.find = ahocorasick.Automaton()
        own = []
        for i in range(self.size):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)):
                p = sp.id_to_piece(i)
                if (body := p.removeprefix(START)).isalpha() and p == p.lower() or not body:
                    self.find.add_word(p, i << 6 | len(p))
                    own.append(i)
        self.find.make_automaton()
        #: The start distribution falls with the rank; the last entry is a letter outside the vocabulary.
        self.start = np.zeros(self.size + 1)
        self.start[own] = 1 / np.arange(100, 100 + len(own))
        self.start /= self.start.sum()
        self.start[self.size] = UNKNOWN

    def lattices(self, found: list[str]):
        """Edges (from, to, piece) of all words by rising start in their word, where the steps begin, first and last nodes."""
        text = "".join(START + w for w in found)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
        first = np.cumsum(sizes) - sizes
        hits = np.fromiter(chain.from_iterable(self.find.iter(text)), dtype=np.int64).reshape(-1, 2)
        size, piece = hits[:, 1] & 63, hits[:, 1] >> 6
        start = hits[:, 0] - size + 1
        bare = np.ones(len(text), dtype=bool)
        bare[start[size == 1]] = False
        bare = np.flatnonzero(bare)
        start = np.concatenate([start, bare])
        size = np.concatenate([size, np.ones_like(bare)])
        piece = np.concatenate([piece, np.full_like(bare, self.size)])
        own = np.repeat(np.arange(len(found)), sizes)
        local = start - first[own[start]]
        order = np.argsort(local.astype(np.int16 if sizes.max() < 1 << 15 else np.int64), kind="stable")
        source = (start + own[start])[order]
        steps = np.searchsorted(local[order], np.arange(int(sizes.max()) + 1))
        nodes = first + np.arange(len(found))
        return source, source + size[order], piece[order], steps, nodes, nodes + sizes

    @staticmethod
    def _forward(lattice, p: np.ndarray) -> np.ndarray:
        source, to, piece, steps, first, last = lattice
        a = np.zeros((last[-1] + 1, *p.shape[1:]))
        a[first] = 1
        for i, j in zip(steps, steps[1:]):
            a[to[i:j]] += a[source[i:j]] * p[piece[i:j]]  # one edge at most to a node in a step
        return a

    @staticmethod
    def _log_forward(lattice, logs: np.ndarray) -> np.ndarray:
        """``_forward`` with logarithms, which neither underflow nor need short words."""
        source, to, piece, steps, first, last = lattice
        a = np.full((last[-1] + 1, *logs.shape[1:]), -np.inf)
        a[first] = 0
        for i, j in zip(steps, steps[1:]):
            a[to[i:j]] = np.logaddexp(a[to[i:j]], a[source[i:j]] + logs[piece[i:j]])
        return a

    @staticmethod
    def _in_parts(found: list[str], at: np.ndarray) -> Iterator[np.ndarray]:
        """The indices ``at`` in parts whose words have a bounded number of letters together, like lengths together."""
        at = sorted(at, key=lambda k: len(found[k]))
        part, n = [], 0
        for k in at:
            if part and n + len(found[k]) > LETTERS_AT_ONCE:
                yield np.array(part)
                part, n = [], 0
            part.append(k)
            n += len(found[k])
        if part:
            yield np.array(part)

    def expected(self, found: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, over all segmentations under the start distribution."""
        out = np.zeros(self.size + 1)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        with np.errstate(divide="ignore"):
            logs = np.log(self.start)
        for part in self._in_parts(found, np.flatnonzero(sizes > PLAIN_LETTERS)):
            lattice = source, to, piece, steps, first, last = self.lattices([found[k] for k in part])
            a = self._log_forward(lattice, logs)
            b = np.full_like(a, -np.inf)
            b[last] = np.log(counts[part]) - a[last]
            for i, j in reversed(list(zip(steps, steps[1:]))):
                np.logaddexp.at(b, source[i:j], logs[piece[i:j]] + b[to[i:j]])
            out += np.bincount(piece, weights=np.exp(a[source] + logs[piece] + b[to]), minlength=self.size + 1)
        if (sizes > PLAIN_LETTERS).any():
            found, counts = [w for w in found if len(w) <= PLAIN_LETTERS], counts[sizes <= PLAIN_LETTERS]
        for at in range(0, len(found), WORDS_AT_ONCE):
            some, n = found[at : at + WORDS_AT_ONCE], counts[at : at + WORDS_AT_ONCE]
            lattice = source, to, piece, steps, first, last = self.lattices(some)
            p = self.start[piece]
            a = self._forward(lattice, self.start)
            b = np.zeros_like(a)
            b[last] = n / a[last]
            for i, j in reversed(list(zip(steps, steps[1:]))):
                b += 0 if i == j else np.bincount(source[i:j], weights=p[i:j] * b[to[i:j]], minlength=len(b))
            out += np.bincount(piece, weights=a[source] * p * b[to], minlength=self.size + 1)
        return out[: self.size]

    def log_forward(self, found: list[str], tables: np.ndarray) -> np.ndarray:
        """log P(word) by word and language; ``tables``: piece by language."""
        out = np.empty((len(found), *tables.shape[1:]))
        left = np.fromiter((len(w) > PLAIN_LETTERS for w in found), dtype=bool, count=len(found))
        plain = np.flatnonzero(~left)
        for at in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[at : at + WORDS_AT_ONCE]
            lattice = self.lattices([found[k] for k in some])
            p = self._forward(lattice, tables)[lattice[-1]]
            left[some] = (p < PLAIN_LEAST).any(axis=1)
            out[some] = np.log(np.maximum(p, PLAIN_LEAST))
        if left.any():
            with np.errstate(divide="ignore"):
                logs = np.log(tables)
            for part in self._in_parts(found, np.flatnonzero(left)):
                lattice = self.lattices([found[k] for k in part])
                out[part] = self._log_forward(lattice, logs)[lattice[-1]]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def release() -> None:
    """Drops what a worker keeps between tasks."""
    pieces.cache_clear()
    for m in Model.kept:
        m.at, m.rows = {}, m.rows[:0].copy()
    Model.kept.clear()


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


class Model:
    """Learned languages (sorted), their piece probabilities, and a bounded table of scored words.

    The table lives as long as a worker holds the model, so tasks that follow each other share it.
    """

    #: Models of this process that have scored words.
    kept: list = []

    def __init__(self, path: str, languages: list[str], tables: np.ndarray):
        self.path, self.languages, self.tables = path, languages, tables
        self.at: dict[str, int] = {}
        self.rows = np.empty((0, len(languages)))

    def totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """log P of each text (a list of words) in each language."""
        fresh = list({w for t in texts for w in t} - self.at.keys())
        if len(self.at) + len(fresh) > SCORED_WORDS:
            self.at, self.rows = {}, self.rows[:0]
            fresh = list({w for t in texts for w in t})
        if fresh:
            if self not in Model.kept:
                Model.kept.append(self)
            k = len(self.at)
            self.at.update(zip(fresh, range(k, k + len(fresh))))
            if k + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows[:k], np.empty((k // 2 + 2 * len(fresh), len(self.languages)))])
            self.rows[k : k + len(fresh)] = pieces(self.path).log_forward(fresh, self.tables)
        get = self.at.__getitem__
        return [self.rows[np.fromiter(map(get, t), dtype=np.int64, count=len(t))].sum(axis=0) for t in texts]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> Model:
    """Learns from all rows with a language; the driver receives one sum per language and piece."""
    path = path or default_vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hold("language_id", release)
        v = pieces(path)
        seen: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def fold():
            for name, c in seen.items():
                n = np.fromiter(c.values(), dtype=np.float64, count=len(c))
                sums[name] = sums.get(name, 0) + (v.expected(list(c), n) if c else np.zeros(v.size))
            seen.clear()

        for b in batches:
            for name, t in zip(b["lang"], b["text"]):
                seen.setdefault(name, Counter()).update(words(t))
                if sum(map(len, seen.values())) > COUNTED_WORDS:
                    fold()
        fold()
        for name, x in sums.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"lang": name, "piece": at.astype("int32"), "n": x[at]})

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInPandas(count, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    v = pieces(path)
    languages = sorted(sums["lang"].unique())
    tables = []
    for name in languages:
        mine = sums[sums["lang"] == name]
        c = np.full(v.size, ALPHA)
        # Sums of doubles depend on their order in the last digits; rounding makes reruns agree.
        c[mine["piece"].to_numpy()] += mine["n"].round(3).to_numpy()
        tables.append(np.append(c / c.sum(), UNKNOWN))
    return Model(path, languages, np.stack(tables, axis=1) if tables else np.zeros((v.size + 1, 0)))


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``, the posterior under equal priors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("language_id", release)
        m = shared.value

        def judged(texts: list[list[str]]) -> Iterator[tuple[str, float]]:
            for t, x in zip(texts, m.totals(texts)):
                best = int(x.argmax()) if t else 0
                yield (m.languages[best], float(1 / np.exp(x - x[best]).sum())) if t else (UNDETERMINED, 0.0)

        for s in batches:
            out, held, n = [], [], 0
            for t in s:
                held.append(words(t) if m.languages else [])
                n += len(held[-1])
                if n >= TOGETHER:
                    out += judged(held)
                    held, n = [], 0
            out += judged(held)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return unwrapped(wrapped(docs, text).select("_doc", f("_text").alias("_lid")).select("_doc", "_lid.*"), docs, ["lang_pred", "score"])


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % FOLDS == 0


def op4(docs: DataFrame) -> DataFrame:
    model = train(docs.where(~held_out()))
    return identified(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")

"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two symbols that stand side by side inside some vocabulary token.  So a pair of
neighbouring bytes that occurs inside no token is a certain cut: the fragments on its two sides can be
encoded on their own and their ids concatenated: merging costs by the fragment, however long the word.
No word, composition or lower-casing reaches over white space either, so a text is split there first, and each
Python worker keeps bounded tables of the runs between blanks and of the words it has put together.

The vocabulary is a tokenizer file whose path is a parameter: byte-level BPE with word ends, NFC and
lower case, special tokens matched in the raw text, and no decoder (tokens are joined by one space).

Defined results: a null text is empty; an empty text has no ids and decodes to the empty text;
repeated rows give equal rows; extra columns pass through ``encoded`` and ``digested`` unless named like a
result, which then replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, unwrapped, wrapped

END = "</w>"
#: Entries of a worker's tables, of runs between blanks and of words (about 200 bytes each), in two halves.
TABLE_SIZE = 600_000
#: Longer words are encoded each time rather than kept.
KEPT_LENGTH = 64
#: Fragments of more symbols are merged with a heap.
SHORT, NEVER = 48, 1 << 60

#: Code points that this regex engine's Unicode (17) calls letters or numbers and that of
#: the tokenizers library (16) does not; there they are symbols.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
SYMBOL = "!"
#: Capitals that the library lower-cases and this Python (Unicode 15.1) does not know.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: What Python's ``split`` takes for white space and the library does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
CAPITAL = re.compile("[" + "".join(map(chr, CAPITALS)) + "]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 up."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Table(dict):
    """A bounded cache: missing keys are computed and, if short, kept.

    When it is half full, its entries become the older half and those that were the older half go, unless they are used again.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            if len(self) >= TABLE_SIZE // 2:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["end_of_word_suffix"] == END and not model["continuing_subword_prefix"], "another kind of BPE"
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.number = {t: str(i) for t, i in self.vocab.items()}
        self.token = {str(i): t for t, i in (self.vocab | self.special).items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.blanks = regex.compile(r"\s+")
        self.later = re.compile(f"[{LATER}]")
        self.symbols = _byte_symbols()
        self.inside = {p for t in self.vocab for p in self._pairs(self._split(t))}
        self.words, self.runs = _Table(self._encode_word), _Table(self._encode_run)

    @staticmethod
    def _split(token: str) -> list[str]:
        """A token's byte symbols, the word end being part of the last one."""
        ends = token.endswith(END) and len(token) > len(END)
        s = list(token[: -len(END)] if ends else token)
        if ends:
            s[-1] += END
        return s

    @staticmethod
    def _pairs(s: list[str]):
        return zip(s, s[1:])

    def _encode_fragment(self, sym: list[str]) -> list[str]:
        """Ids (as decimal text) of one fragment: lowest rank first, leftmost first among equals."""
        if len(sym) > SHORT:
            return self._encode_long(sym)
        rank = self.ranks.get
        ranks = [rank(p, NEVER) for p in self._pairs(sym)]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((sym[i - 1], sym[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank((sym[i], sym[i + 1]), NEVER)
        return [self.number[s] for s in sym]

    def _encode_long(self, sym: list[str]) -> list[str]:
        """The same for a long fragment: a heap of pairs over a linked list, n log n steps."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, p) for i, p in enumerate(self._pairs(sym)) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] >= 0 and (r := self.ranks.get(p := (sym[k], sym[right[k]]))) is not None:
                    heapq.heappush(heap, (r, k, p))
        return [self.number[s] for s in sym if s is not None]

    def cuts(self, s: list[str]) -> list[int]:
        """Places between symbols that no token spans."""
        inside = self.inside
        return [i for i, p in enumerate(zip(s, s[1:]), 1) if p not in inside]

    def _encode_word(self, word: str) -> str:
        s = list(word) if word.isascii() and word.isprintable() else [self.symbols[b] for b in word.encode()]
        s[-1] += END
        at = [0, *self.cuts(s), len(s)]
        return " ".join([i for a, b in zip(at, at[1:]) for i in self._encode_fragment(s[a:b])])

    def words_in(self, text: str) -> list[str]:
        if max(text) < LATER[0] or not self.later.search(text):
            return self.word.findall(text)
        return [text[a:b] for a, b in (m.span() for m in self.word.finditer(self.later.sub(SYMBOL, text)))]

    def _encode_run(self, run: str) -> str:
        # The library lower-cases character by character: a final sigma is not a special case.
        low = run.lower() if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ").lower()
        if max(low) < LATER[0]:
            if low.isalpha():
                return self.words[low]
        elif CAPITAL.search(low):
            low = low.translate(CAPITALS)
        return " ".join(map(self.words.__getitem__, self.words_in(low)))

    def runs_in(self, text: str) -> list[str]:
        """The stretches of a text between white space."""
        return [r for r in self.blanks.split(text) if r] if SEPARATORS.search(text) else text.split()

    def parts(self, text: str | None) -> list[str]:
        """Ids of a whole text, as decimal text with blanks between, one entry for each run between blanks or special token."""
        text = text or ""
        if not any(s in text for s in self.special):
            return list(map(self.runs.__getitem__, self.runs_in(text)))
        out: list[str] = []
        for part in self.cut_special.split(text):
            if part in self.special:
                out.append(str(self.special[part]))
            else:
                out += map(self.runs.__getitem__, self.runs_in(part))
        return out

    def encode(self, text: str | None) -> list[str]:
        """Ids of a whole text, as decimal text."""
        parts = self.parts(text)
        return " ".join(parts).split(" ") if parts else []

    def decode(self, ids: list[str]) -> str:
        """The tokens of the ids, special ones included, joined by one space; entries may hold several ids, as ``parts`` gives them."""
        return " ".join(map(self.token.__getitem__, " ".join(ids).split(" "))) if ids else ""


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` plus ``ids`` (array of int) and ``decoded`` (text)."""
    path = path or default_vocabulary()

    @F.pandas_udf("struct<ids:array<int>,decoded:string>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("bpe", codec.cache_clear)
        c = codec(path)
        for s in batches:
            ids = [c.encode(t) for t in s]
            yield pd.DataFrame({"ids": [[int(i) for i in x] for x in ids], "decoded": [c.decode(x) for x in ids]})

    return unwrapped(wrapped(docs, text).select("_doc", f("_text").alias("_bpe")).select("_doc", "_bpe.*"), docs, ["ids", "decoded"])


def digested(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without its text, plus n_tokens and digests of ids and decoded text.

    The same codec as ``encoded``; ids stay in the worker, so only digests cross back to the JVM.
    """
    path = path or default_vocabulary()

    @F.pandas_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hold("bpe", codec.cache_clear)
        c = codec(path)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for s in batches:
            rows = []
            for t in s:
                parts = c.parts(t)
                ids = " ".join(parts)
                rows.append((ids.count(" ") + 1 if parts else 0, sha(ids), sha(c.decode(parts))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    d = wrapped(docs, text).select("_doc", f("_text").alias("_bpe")).select("_doc", "_bpe.*")
    return unwrapped(d, docs, ["n_tokens", "ids_sha256", "decoded_sha256"], [text])


def op3(docs: DataFrame) -> DataFrame:
    return digested(docs.select("doc_id", "text"))

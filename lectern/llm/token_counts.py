"""Token counts of whole texts by a map-side look-up in two tiers.

A byte-level BPE encodes each pre-token on its own, so the number of tokens of a text is the sum of the lengths of its
pre-tokens.  The first tier is a table of frequent pre-tokens and their lengths, broadcast once: the entries of
the vocabulary that are pre-tokens themselves, and the ``KEPT`` most frequent ones of ``SAMPLE_ROWS`` texts of one partition.  What
misses it is encoded and kept in the same hash table of the worker, bounded by ``MISSES``: a full one starts anew from the
broadcast part.  No pre-token is shuffled, and the sample decides about speed only: every text is counted in full.

The broadcast table has at most the vocabulary's size plus ``KEPT`` entries of ``KEPT_LENGTH`` characters at most (under 8 MB).
The tokenizer file's path is a parameter: byte-level BPE without normaliser; strings of its added tokens count as one token.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; repeated rows give equal rows; extra
columns pass through ``counted`` unless named like a result, which then replaces them; an empty table gives an empty result.
Long texts are split in stretches, at blanks between two other characters (there a pre-token ends for certain).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATER, SYMBOL, _byte_symbols
from .common import hold, unwrapped, wrapped

#: Fixed value: the pattern of byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SURE_CUT = regex.compile(r"(?<=\S) (?=\S)")
LATER_LETTER = re.compile(f"[{LATER}]")
#: Characters taken at once; texts and pre-tokens looked at for the first tier; entries of either tier and their length.
STRETCH = 1 << 20
SAMPLE_ROWS, KEPT, MISSES, KEPT_LENGTH = 2_000, 20_000, 400_000, 64
COUNTS = ["n_bytes", "n_tokens", "over_limit"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pre_tokens(text: str) -> list[str]:
    if max(text, default="") < LATER[0] or not LATER_LETTER.search(text):
        return PRE_TOKEN.findall(text)
    return [text[a:b] for a, b in (m.span() for m in PRE_TOKEN.finditer(LATER_LETTER.sub(SYMBOL, text)))]


def stretches(text: str) -> Iterator[str]:
    """The text in parts of about STRETCH characters, cut where no pre-token spans the cut."""
    at = 0
    while len(text) - at > STRETCH and (m := SURE_CUT.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class Lengths(dict):
    """Tokens of each pre-token: the broadcast tier, and misses beside it while there is room."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        tokenizer = Tokenizer.from_file(path)
        self.frequent, self.model, self.symbols = frequent, tokenizer.model, _byte_symbols()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        assert spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"], "another kind of BPE"
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        byte = {c: b for b, c in enumerate(self.symbols)}
        self.entries = [bytes(byte[c] for c in t) for t in tokenizer.get_vocab(with_added_tokens=False) if all(c in byte for c in t)]

    def length(self, pre_token: str) -> int:
        return len(self.model.tokenize("".join([self.symbols[b] for b in pre_token.encode()])))

    def __missing__(self, pre_token: str) -> int:
        n = self.length(pre_token)
        if len(pre_token) <= KEPT_LENGTH:
            if len(self) >= len(self.frequent) + MISSES:
                self.clear()
                self.update(self.frequent)
            self[pre_token] = n
        return n

    def pieces(self, text: str | None) -> Iterator[list[str]]:
        """Pre-tokens of what lies between the strings of added tokens."""
        for part in self.added.split(text or "") if self.added else [text or ""]:
            for stretch in stretches(part):
                yield pre_tokens(stretch)

    def tokens(self, text: str | None) -> int:
        added = len(self.added.findall(text)) if self.added and text else 0
        return added + sum(sum(map(self.__getitem__, p)) for p in self.pieces(text))


def _sampled(path: str):
    """The most frequent pre-tokens of the first rows of a task; rare ones are let go when there are many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen, rows = Lengths(path, {}), Counter(), 0
        for b in batches:
            for text in b["t"][: max(0, SAMPLE_ROWS - rows)]:
                for p in table.pieces(text):
                    seen.update(p)
                    if len(seen) > 20 * KEPT:
                        seen = Counter(dict(seen.most_common(10 * KEPT)))
            rows += len(b)
        if rows:
            yield pd.DataFrame({"w": [[w for w, _ in seen.most_common() if len(w) <= KEPT_LENGTH][:KEPT]]})

    return run


def frequent_lengths(docs: DataFrame, text: str, path: str) -> dict[str, int]:
    """The first tier.  ``first`` runs tasks until one has rows, so a single partition is looked into, and nothing is shuffled."""
    table = Lengths(path, {})
    whole = [w for e in table.entries if len(w := e.decode("utf-8", "ignore")) <= KEPT_LENGTH and w.encode() == e and pre_tokens(w) == [w]]
    seen = docs.select(F.col(f"`{text}`").alias("t")).mapInPandas(_sampled(path), "w array<string>").first()
    return {w: table.length(w) for w in {*whole, *(seen["w"] if seen else ())}}


_tables: dict[str, Lengths] = {}


def _table(run: str, path: str, frequent) -> Lengths:
    if run not in _tables:
        _tables.clear()
        _tables[run] = Lengths(path, frequent.value)
    return _tables[run]


def counted(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """``docs`` without the text, plus n_bytes (UTF-8), n_tokens and whether they are more than ``limit``."""
    path, run = path or default_vocabulary(), uuid4().hex
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hold("token_counts", _tables.clear)
        table = _table(run, path, frequent)
        for s in batches:
            yield pd.Series([table.tokens(t) for t in s], dtype="int64")

    d = wrapped(docs, text, keep=False)
    d = d.select("_doc", F.octet_length(F.coalesce("_text", F.lit(""))).cast("long").alias("n_bytes"), n_tokens("_text").alias("n_tokens"))
    return unwrapped(d.withColumn("over_limit", F.col("n_tokens") > limit), docs, COUNTS, [text])


def op13(docs: DataFrame) -> DataFrame:
    return counted(docs.select("doc_id", "text"))

"""Plain Python versions of operators, by their definitions and one row at a time."""

import math
import re
from collections import Counter, defaultdict

import regex
from lectern.llm import language_id, secret_scan, simhash


class Languages:
    """Unigram tables from one expectation step over all training words, and the posterior of a text."""

    def __init__(self, rows):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=language_id.default_vocabulary())
        own = {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            bare = p.removeprefix("▁")
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i)) and (not bare or bare.isalpha() and p == p.lower()):
                own[p] = len(own)
        weight = {p: 1 / (100 + k) for p, k in own.items()}
        self.size, self.start = sp.get_piece_size(), {p: w / sum(weight.values()) for p, w in weight.items()}
        self.longest = max(map(len, own))
        seen = defaultdict(Counter)
        for text, lang in rows:
            if lang is not None:
                seen[lang].update(self.words(text))
        self.tables = {}
        for lang in sorted(seen):
            uses = Counter()
            for word, n in seen[lang].items():
                for p, x in self.expected(word).items():
                    uses[p] += n * x
            total = sum(round(x, 3) for x in uses.values()) + language_id.ALPHA * self.size
            self.tables[lang] = {p: (language_id.ALPHA + round(uses[p], 3)) / total for p in own}

    @staticmethod
    def words(text):
        return regex.findall(r"\p{L}+", (text or "").lower())

    def steps(self, word, p):
        s = "▁" + word
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + self.longest) + 1):
                if s[i:j] in p:
                    yield i, j, s[i:j], p[s[i:j]]
                elif j == i + 1:
                    yield i, j, None, language_id.UNKNOWN

    def forward(self, word, p):
        a = [1.0] + [0.0] * (len(word) + 1)
        for i, j, _, x in self.steps(word, p):
            a[j] += a[i] * x
        return a

    def expected(self, word):
        a = self.forward(word, self.start)
        b = [0.0] * (len(word) + 1) + [1.0]
        every = list(self.steps(word, self.start))
        for i, j, _, x in reversed(every):
            b[i] += x * b[j]
        out = Counter()
        for i, j, piece, x in every:
            if piece is not None:
                out[piece] += a[i] * x * b[j] / a[-1]
        return out

    def judged(self, text, memo={}):  # noqa: B006
        words = self.words(text)
        if not words or not self.tables:
            return "und", 0.0
        logs = {}
        for lang, p in self.tables.items():
            for w in set(words):
                if (id(self), lang, w) not in memo:
                    memo[id(self), lang, w] = math.log(self.forward(w, p)[-1])
            logs[lang] = math.fsum(memo[id(self), lang, w] for w in words)
        best = max(logs, key=logs.get)
        return best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())


def components(nodes, linked):
    """Least member of each node's component, by comparing every pair."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near(a, b):
    """Whether two sketches link."""
    (p, k), (q, m) = a, b
    return bool(set(k) & set(m)) and sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(p, q)) <= 64 * simhash.LANES // 5


def spans(text, table):
    """(start, kind, end) of all secrets in a text, base ones first in the order of kinds."""
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) >= 20 and not any(m.start() < e and s < m.end() for s, _, e in base):
            at = [secret_scan.ALPHABET.index("-" if c in secret_scan.OTHERS else c) for c in m[0]]
            ratio = sum(table[a * secret_scan.N + b] for a, b in zip(at, at[1:]))
            if ratio >= secret_scan.MIN_TOTAL and ratio >= secret_scan.MIN_MEAN * (len(m[0]) - 1):
                out.append((m.start(), 3, m.end()))
    return sorted(base), sorted(out)


def masked(text, table):
    out, at = [], 0
    for s, _, e in spans(text, table)[1]:
        if s >= at:
            out += [text[at:s], secret_scan.MASK]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text

"""Plain, slow versions of the operators, one row at a time."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "One  two three\n\nOne  two three\n",
    "a b c " * 3000,
    "ß É 日本 ́x 'tis don't <|endoftext|> 42!",
    "x" * 5000,
]


def edge_documents(spark):
    """Odd texts, a null id, a repeated row, and columns with names that operators add."""
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id here"), (3, "one"), (3, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    for name in ("n_lines", "kept", "score", "rank", "part", "fp", "component_id", "lang"):
        df = df.withColumn(name, F.lit("taken"))
    return df


def components(n, near):
    """Least index reachable over pairs for which ``near`` holds."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def lines(texts, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    texts = [t or "" for t in texts]
    counts = collections.Counter(k for t in texts for k in {key(x) for x in t.split("\n")} if k)
    out = []
    for t in texts:
        all_lines = t.split("\n")
        kept = [x for x in all_lines if not (key(x) and counts[key(x)] >= min_docs)]
        out.append((len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {
        i + d for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for d in range(3)
    }
    worded = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(worded) - len(set(worded)),
        len(repeated),
        n < 50 or 100 * len(repeated) > 50 * n,
    )


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(data):
    return hashlib.sha256(data).hexdigest()


class Model:
    """Interpolated absolute discounting over dictionaries."""

    def __init__(self, texts, order, discount):
        self.order, self.d = order, discount
        self.grams = [collections.Counter() for _ in range(order)]
        for t in texts:
            words = self.tokens(t)
            for i in range(len(words)):
                self.grams[0][(words[i],)] += 1
                before = [b"", *words[:i]]
                for k in range(1, order):
                    if len(before) >= k:
                        self.grams[k][(*before[-k:], words[i])] += 1
        self.n, self.v = sum(self.grams[0].values()), len(self.grams[0])
        self.follow = [collections.Counter(g[:-1] for g in grams) for grams in self.grams]

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), b""]

    def scores(self, text):
        words = self.tokens(text)
        base = score = 0.0
        for i, w in enumerate(words):
            p = (self.grams[0][(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
            base += math.log10(p)
            before = [b"", *words[:i]]
            for k in range(1, self.order):
                context = tuple(before[-k:]) if len(before) >= k else None
                if context is None or not self.follow[k][context]:
                    continue
                # a document's start counts as often as its end
                seen = self.grams[k - 1][context] if k > 1 or context != (b"",) else self.grams[0][(b"",)]
                share = max(self.grams[k][(*context, w)] - self.d, 0) / seen
                p = share + self.d * self.follow[k][context] / seen * p
            score += math.log10(p)
        return len(words), sum(self.grams[0][(w,)] > 0 for w in words), base, score

"""Plain versions of the operators, and documents that hold the cases each of them has to take."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, block int, shard int, w string, id string, kind string, row long, _k int, _y int, n_lines int, n_dropped int, `a.b` string, c0 int"


def documents(spark, texts, ids=None):
    """With columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(k, t, "xx", 1, 2, "w", "i", "k", 7, 3, 0, 5, 6, "dot", 9) for k, t in zip(ids, texts)], SCHEMA)


def some_texts(seed: int, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta.", "THETA", "iota", "kappa"]
    line = lambda k: " ".join(rng.choices(words, k=k))
    shared = [line(12) for _ in range(5)]
    out: list[str | None] = [None, "", "  \n\t", "one", "x" * 200_000, ("alpha " * 3000).strip()]
    for _ in range(n):
        parts = [line(rng.randint(0, 20)) for _ in range(rng.randint(1, 6))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        out.append(rng.choice(["\n", "\n\n", " "]).join(parts))
    return out + out[6:16] + ["\n".join([shared[0]] * 3)]


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", az(text or ""))


def lines(ids, texts):
    key = lambda x: az(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, t in zip(ids, texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(k)
    least = lambda ks: None if None in ks else min(ks)
    out = []
    for k, t in zip(ids, texts):
        own = (t or "").split("\n")
        kept = [x for x in own if len(held[key(x)]) < 2 or k == least(held[key(x)])]
        out.append((k, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def repeats(ids, texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for k, w in zip(ids, words):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def benchmark_hits(ids, texts, items, n=10):
    windows = defaultdict(set)
    for k, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[i : i + n])] |= {str(k)} if k is not None else set()
    out = []
    for k, t in zip(ids, texts):
        w, hit, found = plain_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (who := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= who
        out.append((k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)

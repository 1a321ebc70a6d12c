"""Small documents with every edge that the operators state a result for, and brute force to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return text.encode().lower().decode()


def words(text, fold=True):
    return WORD.findall((lower(text) if fold else text) if text else "")


def prose(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 4, 5, 6, 7, 12, 40, 90, 200, 700)]
    texts = [*base, *base[4:8], None, "", " \t\n ", "Ein Wort \x0b\x0cNUL\x00x ÄÖ", "one", "one", "a " * 60, "a " * 61]
    for t in base[5:]:
        for k in (1, 2, 5):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(w))
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 20)} {shared}\n{prose(rng, 15)}" for _ in range(6)]
    texts += [prose(rng, 30000, 4000)]
    rows = [(i, t, ("en", "de", None)[i % 3], "s" if i % 3 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, base[7], "en", "s", 1), (None, None, None, None, None)]


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: find(parent, n) for n in nodes}

"""Operator 4: greedy longest-match token counts by a linear automaton.

The vocabulary is a trie over marked words; every node that cannot go on has a
failure link and the number of tokens that following it completes, both
precomputed, so a word of n characters takes O(n) steps and no piece is built.
A word with a character that no piece covers counts as one unknown token.

The vocabulary is that of a SentencePiece model: a piece that begins with the
marker begins words, the others continue them. Null or empty texts have no
words and no tokens; null ids and repeated rows are kept as they are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tracklens.llm.pieces import MARK
from tracklens.llm.words import slices

TABLE_ENTRIES = 500_000


class Automaton:
    def __init__(self, vocabulary: Iterable[str]):
        """Pieces that begin with the marker begin a word; the marker alone is no piece."""
        self.next: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: after a piece
        leaf = [False, False]
        for piece in vocabulary:
            node, rest = (0, piece[len(MARK) :]) if piece.startswith(MARK) else (1, piece)
            if not rest or MARK in rest:
                continue
            for c in rest:
                node = self.next[node].setdefault(c, len(leaf))
                if node == len(leaf):
                    leaf.append(False)
                    self.next.append({})
            leaf[node] = True
        self.fail, self.pops = [-1] * len(leaf), [0] * len(leaf)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                if leaf[child]:
                    self.fail[child], self.pops[child] = 1, 1
                else:
                    at, pops = self.fail[node], self.pops[node]
                    while at >= 0 and c not in self.next[at]:
                        at, pops = self.fail[at], pops + self.pops[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][c], pops
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of the word, or 0 where greedy matching cannot cover it."""
        node, n = 0, 0
        following, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while c not in following[node]:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = following[node][c]
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 0
        return n


@lru_cache(2)
def automaton(model: str) -> Automaton:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return Automaton(sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of every whole text; an unknown word is one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, known = automaton(model), {}
        for b in batches:
            words, tokens, unknown = [], [], []
            for s in slices(b.column(1)):
                if len(known) > TABLE_ENTRIES:
                    known.clear()
                raw, first = s.data.tobytes(), s.first.tolist()
                spans = list(zip(s.start.tolist(), s.end.tolist(), strict=True))
                for d in range(len(first) - 1):
                    t = u = 0
                    for i, j in spans[first[d] : first[d + 1]]:
                        w = raw[i:j]
                        n = known.get(w)
                        if n is None:
                            n = known[w] = a.count(w.decode("utf-8", "replace"))
                        t += n or 1
                        u += not n
                    words.append(first[d + 1] - first[d])
                    tokens.append(t)
                    unknown.append(u)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_words long, n_tokens long, n_unknown long")

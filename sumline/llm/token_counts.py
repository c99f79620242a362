"""Token counts by a linear longest-match automaton.

Method. The vocabulary is a trie over bytes. Each trie node has a failure link to the node that
the rest of its string leads to once the longest pieces at its front are popped, and the number of
pieces popped on that way, both computed once, breadth first. A word is then read byte by byte;
where the trie has no edge, the link is followed and its count added. That gives the number of
pieces of greedy longest-match tokenisation in linear time without building a piece.

A word starts with a start symbol: a space for byte vocabularies whose word-initial pieces begin
with one, START for vocabularies that mark continuations instead ("##"). A word that the
vocabulary can't spell counts as one unknown token.

The automaton is broadcast; its size is that of the vocabulary file. Counts of short words are
remembered in a table of at most MEMO words.

Defined cases. Null and empty texts have no words and no tokens. Repeated rows give repeated
results. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

START = 256
MEMO, MEMO_BYTES = 200_000, 48
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Automaton:
    def __init__(self, pieces: Iterable[tuple[int, ...]], start: int):
        """pieces: as symbols, bytes or START; word-initial ones begin with start."""
        self.start = start
        self.edge: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[]]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                to = self.edge.get(at << 9 | s)
                if to is None:
                    to = len(children)
                    children.append([])
                    is_piece.append(False)
                    self.edge[at << 9 | s] = to
                    children[at].append((s, to))
                at = to
            is_piece[at] = at > 0
        self.link, self.pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for s, to in children[at]:
                queue.append(to)
                if is_piece[to]:
                    self.link[to], self.pops[to] = 0, 1
                    continue
                z, n = self.link[at], self.pops[at]
                while z >= 0 and (z << 9 | s) not in self.edge:
                    n += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[to], self.pops[to] = self.edge[z << 9 | s], n

    @classmethod
    def of_bytes(cls, tokens: Iterable[bytes]) -> Automaton:
        return cls((tuple(t) for t in tokens), 32)

    @classmethod
    def of_wordpieces(cls, tokens: Iterable[str], mark: str = "##") -> Automaton:
        return cls((tuple(t[len(mark) :].encode()) if t.startswith(mark) else (START, *t.encode()) for t in tokens), START)

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if the vocabulary can't spell it."""
        edge, link, pops, n = self.edge, self.link, self.pops, 0
        at = edge.get(self.start, -1)
        if at < 0:
            return -1
        for s in word:
            to = edge.get(at << 9 | s)
            while to is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return -1
                to = edge.get(at << 9 | s)
            at = to
        while at:
            n += pops[at]
            at = link[at]
            if at < 0:
                return -1
        return n


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def count_tokens(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row; unknown words count as one token."""
    held = docs.sparkSession.sparkContext.broadcast(automaton)

    def measure(batches):
        count = held.value.count

        class Memo(dict):
            def __missing__(self, word):
                n = count(word)
                if len(word) <= MEMO_BYTES:
                    if len(self) >= MEMO:
                        self.clear()
                    self[word] = n
                return n

        seen = Memo()
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                data, words, tokens, unknown = raw.tobytes(), [], [], []
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    each = [seen[w] for w in data[a:b].split()]
                    lost = each.count(-1)
                    words.append(len(each))
                    tokens.append(sum(each) + 2 * lost)
                    unknown.append(lost)
                yield pa.record_batch([piece.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, n_words long, n_tokens long, n_unknown long")

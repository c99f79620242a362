"""Benchmark decontamination by latent semantic retrieval.

Method. Texts are cut into passages of BLOCK words. The TF-IDF matrix of all passages over the
benchmark's words is reduced by a randomised SVD: one distributed pass counts words and multiplies
the Gram matrix of the passages by a random matrix, and the driver finishes with a Nystrom step on a
matrix of features x RANK. A second pass slides windows of each item's length and some slack
(width_of) over every document, from every word on. The answer check, at least half of the item's
rarest words in the window, comes first, by the places of those words: it drops no window that it
would pass later. What is left is projected and compared with the item by cosine in the latent
space, the best place of a stretch counting; candidates are checked by the longest common
subsequence of words, which finds paraphrases with words changed, added or left out.

Words are compared with A-Z lower-cased and by 64-bit hashes. What is broadcast is bounded by the
benchmark: features x RANK numbers and the items' words.

Defined cases. Null and empty texts and items match nothing; items that repeat a text are found
each; an item with a null id is searched for as any other and reported under null. Texts may be of any length. Rows are judged one by one, whatever their id; repeated rows give repeated results. Without
benchmark items nothing is contaminated. An empty table gives an empty result. Other columns pass
through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import put_back, set_aside

BLOCK, STEP, RANK, SPARE = 32, 4, 48, 8
COSINE = 0.5
#: Places of answer words looked at together.
PLACES = 2_000_000
#: Share of an item's words in the common subsequence; items of up to SHORT words must be found whole.
SUBSEQUENCE, SHORT = 0.6, 8
HITS = "hits"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _slice_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[raw]
    starts, ends, first = tk.words(low, offs)
    return tk.word_hashes(low, starts, ends), first


@dataclass
class Items:
    """The benchmark and its words. A word's feature is found by a slot of its hash; after: the next feature of the same slot, -1 for none."""

    ids: list
    words: list[np.ndarray]  # features of each item's words
    vocabulary: np.ndarray
    after: np.ndarray
    bits: int

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        kept = sorted(((i, t) for i, t in rows if t), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        hashes = []
        for _, t in kept:
            data = np.frombuffer(t.encode(), np.uint8)
            hashes.append(_slice_words(data, np.array([0, len(data)]))[0])
        full = [k for k, h in enumerate(hashes) if len(h)]
        vocabulary = np.unique(np.concatenate([hashes[k] for k in full])) if full else np.empty(0, np.uint64)
        n = len(vocabulary)
        self = cls([kept[k][0] for k in full], [], vocabulary, np.full(n, -1, np.int32), max(16, n.bit_length() + 4))
        slots = self.slots(vocabulary)
        order = np.argsort(slots, kind="stable")
        same = np.flatnonzero(np.diff(slots[order]) == 0)
        self.after[order[same]] = order[same + 1]
        table = self.table()
        self.words = [self.features(hashes[k], table) for k in full]
        return self

    def slots(self, w: np.ndarray) -> np.ndarray:
        return ((w * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def table(self) -> np.ndarray:
        """The first feature of each slot, -1 for none; the slots grow with the vocabulary alone."""
        out = np.full(1 << self.bits, -1, np.int32)
        out[self.slots(self.vocabulary)[::-1]] = np.arange(len(self.vocabulary))[::-1]
        return out

    def features(self, w: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """The feature of each word, -1 for others."""
        at = (self.table() if table is None else table)[self.slots(w)]
        astray = np.flatnonzero(at >= 0)
        while len(astray := astray[self.vocabulary[at[astray]] != w[astray]]):
            at[astray] = self.after[at[astray]]
            astray = astray[at[astray] >= 0]
        return at


@dataclass
class Space:
    """IDF by feature and the latent basis, IDF included."""

    idf: np.ndarray
    basis: np.ndarray


def fit_space(docs: DataFrame, items: Items, rank: int = RANK, seed: int = 5) -> Space:
    n = len(items.vocabulary)
    width = rank + SPARE
    omega = np.random.Generator(np.random.PCG64(seed)).standard_normal((n, width)).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((items, omega))
    chunk = 512

    def multiply(batches):
        items, omega = held.value
        table = items.table()
        wide_omega = np.vstack([omega, np.zeros((1, omega.shape[1]), np.float32)])
        gram, counts, total = np.zeros(omega.shape, np.float64), np.zeros(n, np.int64), 0
        for batch in batches:
            for _, raw, offs in tk.slices(batch, "text", 1 << 20):
                w, first = _slice_words(raw, offs)
                total += len(w)
                f = items.features(w, table)
                known = np.flatnonzero(f >= 0)
                if not len(known):
                    continue
                f, own = f[known], tk.owners(first)[known]
                counts += np.bincount(f, minlength=n)
                passage = (known - first[own]) // BLOCK + first[own]  # ascending, and of one text each
                edge = np.flatnonzero(np.diff(passage, prepend=-1))
                length = np.diff(np.append(edge, len(f)))
                nth = np.repeat(np.arange(len(edge)), length)
                padded = np.full((len(edge), BLOCK), n, np.int32)
                padded[nth, np.arange(len(f)) - edge[nth]] = f
                y = np.concatenate([wide_omega[padded[a : a + 256]].sum(1) for a in range(0, len(edge), 256)])
                order = np.argsort(f, kind="stable")
                g = f[order]
                turn = np.flatnonzero(np.diff(g, prepend=-1))
                gram[g[turn]] += np.add.reduceat(y[nth[order]], turn, axis=0)
        for a in range(0, n, chunk):
            yield pa.record_batch([pa.array([a // chunk], pa.int32()), pa.array([gram[a : a + chunk].tobytes()], pa.binary()), pa.array([counts[a : a + chunk].tobytes()], pa.binary()), pa.array([total if a == 0 else 0], pa.int64())], names=["part", "gram", "counts", "total"])

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for part, gram, counts, total in zip(*(c.to_pylist() for c in batch.columns)):
                g, c, t = sums.get(part, (0, 0, 0))
                sums[part] = (g + np.frombuffer(gram), c + np.frombuffer(counts, np.int64), t + total)
        parts = sorted(sums)
        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array([sums[p][0].tobytes() for p in parts], pa.binary()), pa.array([sums[p][1].tobytes() for p in parts], pa.binary()), pa.array([sums[p][2] for p in parts], pa.int64())], names=["part", "gram", "counts", "total"])

    schema = "part int, gram binary, counts binary, total long"
    rows = sorted(docs.select("text").mapInArrow(multiply, schema).repartition(16, "part").mapInArrow(add, schema).collect())
    total = sum(r.total for r in rows)
    counts = np.concatenate([np.frombuffer(r.counts, np.int64) for r in rows]) if rows else np.zeros(n, np.int64)
    gram = np.concatenate([np.frombuffer(r.gram).reshape(-1, width) for r in rows]) if rows else np.zeros(omega.shape)
    every = np.concatenate(items.words)
    counts = counts + np.bincount(every, minlength=n)
    idf = np.log(1 + (total + 1) / np.maximum(counts, 1))
    # The items' own passages belong to the matrix as well, heavy enough to be seen in the basis.
    gram = gram / max(total / BLOCK, 1)
    for f in items.words:
        np.add.at(gram, f, omega[f].sum(0) / len(items.words))
    z, test = idf[:, None] * gram, omega / idf[:, None]
    q, _ = np.linalg.qr(z)
    core = (q.T @ z) @ np.linalg.pinv(q.T @ test)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    basis = q @ vectors[:, np.argsort(-values)[:rank]]
    return Space(idf, (idf[:, None] * basis).astype(np.float32))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one bit per word of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        both = row & masks.get(x, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def needed(n: int) -> int:
    return n if n <= SHORT else max(SHORT, int(np.ceil(SUBSEQUENCE * n)))


def width_of(n: int) -> int:
    """Words in a window for an item of n words: its length and slack for words added."""
    return -(-n // STEP) * STEP + 2 * (STEP + n // 8)


def with_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with hits (a column of that name is replaced): for each benchmark item found in the text item_id, lcs_words, item_words, answer_hits and answer_words, by item."""
    docs = docs.drop(HITS)
    items = Items.of([(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().collect()])
    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "lcs_words", "item_words", "answer_hits", "answer_words")]))
    if not items.ids:
        return docs.withColumn(HITS, F.array().cast(kind))
    space = fit_space(docs, items)
    held = docs.sparkSession.sparkContext.broadcast((items, space))
    arrow = pa.list_(pa.struct([(f.name, pa.int64()) for f in kind.elementType.fields]))

    def search(batches):
        items, space = held.value
        table = items.table()
        answers = []
        for f in items.words:
            once = np.unique(f)
            answers.append(set(once[np.argsort(-space.idf[once], kind="stable")][: max(3, len(once) // 3)].tolist()))
        half, sizes, widths = (np.array([g(k) for k in range(len(answers))]) for g in (lambda k: (len(answers[k]) + 1) // 2, lambda k: len(items.words[k]), lambda k: width_of(len(items.words[k]))))
        asked = np.array(sorted((x, k) for k, held_words in enumerate(answers) for x in held_words))
        vectors = np.stack([space.basis[f].sum(0) for f in items.words])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        basis = np.vstack([space.basis, np.zeros((1, space.basis.shape[1]), np.float32)])  # other words, feature -1, add nothing

        def answered(f, first):
            """(text, item, low, high): every window that passes the answer check begins in one of these stretches."""
            own, known = tk.owners(first), np.flatnonzero(f >= 0)
            times = np.bincount(f[known], minlength=len(space.idf))
            group = (np.cumsum(np.bincount(asked[:, 1], times[asked[:, 0]], len(answers))) // PLACES).astype(np.int64)
            for g in np.unique(group).tolist():
                word, item = asked[group[asked[:, 1]] == g].T
                turn = np.searchsorted(word, np.arange(len(space.idf) + 1))
                many = np.diff(turn)[f[known]]
                place, nth = np.repeat(known, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                item = item[turn[f[place]] + nth]
                pair = own[place] * len(answers) + item
                order = np.argsort(pair, kind="stable")
                place, item, pair = place[order], item[order], pair[order]
                last = np.arange(len(place)) + half[item] - 1
                begin = np.flatnonzero(last < len(place))
                last = last[begin]
                near = (pair[last] == pair[begin]) & (place[last] - place[begin] < widths[item[begin]])
                begin, last = begin[near], last[near]
                k, doc = item[begin], own[place[begin]]
                low = np.maximum(first[doc], place[last] - widths[k] + 1)
                high = np.minimum(place[begin], np.maximum(first[doc], first[doc + 1] - widths[k]))
                # Stretches of a pair that touch are one.
                fresh = np.flatnonzero((np.diff(pair[begin], prepend=-1) != 0) | (low > np.concatenate(([-1], high[:-1])) + 1))
                yield from zip(doc[fresh].tolist(), k[fresh].tolist(), low[fresh].tolist(), high[np.append(fresh[1:], len(high)) - 1].tolist() if len(fresh) else [])

        def similar(f, k):
            """Whether a window of the item's length, or of it with slack, comes near the item in the latent space."""
            sums = np.concatenate((np.zeros((1, basis.shape[1])), np.cumsum(basis[f], axis=0, dtype=np.float64)))
            for size in (sizes[k], -(-sizes[k] // STEP) * STEP, widths[k]):
                size = min(size, len(f))
                latent = sums[size:] - sums[: len(sums) - size]
                if ((latent @ vectors[k]) >= COSINE * np.maximum(np.linalg.norm(latent, axis=1), 1e-12)).any():
                    return True
            return False

        def best(words, k, starts):
            """The most words in common subsequence, then answers, among windows from the first starts places of words on; None if none passes."""
            item, width, out = items.words[k].tolist(), int(widths[k]), None
            block = max(1, width // 2)
            for a in range(0, starts, block):
                # The windows of a block hold no more than what they span together.
                if common_subsequence(item, words[a : a + block - 1 + width]) < needed(len(item)):
                    continue
                for s in range(a, min(a + block, starts)):
                    window = words[s : s + width]
                    n_held = len(answers[k].intersection(window))
                    if n_held < half[k]:
                        continue
                    n = common_subsequence(item, window)
                    if n >= needed(len(item)) and (out is None or (n, n_held) > out):
                        out = n, n_held
                        if out == (len(item), len(answers[k])):
                            return out
            return out

        def found(f, first):
            """Hits by text: {(text, item): row}."""
            out: dict = {}
            for doc, k, low, high in answered(f, first):
                if (doc, k) in out:
                    continue
                stretch = f[low : min(first[doc + 1], high + widths[k])]
                top = best(stretch.tolist(), k, high - low + 1) if similar(stretch, k) else None
                if top:
                    out[doc, k] = (items.ids[k], top[0], len(items.words[k]), top[1], len(answers[k]))
            return out

        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text", 2 << 20):
                w, first = _slice_words(raw, offs)
                hits = [[] for _ in range(len(piece))]
                if len(w):
                    for (doc, _), row in found(items.features(w, table), first).items():
                        hits[doc].append(dict(zip((x.name for x in arrow.value_type), row)))
                for h in hits:
                    h.sort(key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["item_words"], x["lcs_words"]))
                yield pa.record_batch([*piece.columns, pa.array(hits, arrow)], names=[*piece.schema.names, HITS])

    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, T.StructField(HITS, kind)]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_hits(rows, benchmark).select("doc_id", F.inline(HITS))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, unchanged."""
    return put_back(with_hits(set_aside(docs, [HITS]), benchmark).filter(F.size(HITS) == 0), docs.columns)

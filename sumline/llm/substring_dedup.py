"""Substring dedup: windows of k words that start earlier elsewhere are removed.

Method. Pass 1: each partition fills a count-min sketch (two rows of 2**log2_width saturating
cells) and the partition sketches are merged by cell. A window is not entered itself but by its
anchor, the leftmost smallest (k // 2)-word hash inside it: equal windows have equal anchors at
equal distances, so the merged count of its anchor never falls below the window's own count and
no repeated window is lost. Pass 2: windows whose estimate is two or more go to an exact grouping
by a 96-bit fingerprint of all k words; every window but the earliest of its group is a repeat.
Pass 3: the words that repeats cover are taken out of each text.

Only the merged sketch is broadcast, 2**(log2_width + 1) bits. Its width follows the words counted in the input,
about eight cells an anchor, up to 2**MAX_WIDTH cells (128 MB of bits); a sketch that is too narrow
for a corpus loses no window but sends more of them to pass 2.

Defined cases. Null and empty texts have no words. Rows with equal document ids are one document:
equal windows at equal positions of it are not repeats of each other, and a start that is a
repeat in one row counts for all of them. A null id sorts before all others. An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import total_words

SEGMENT = 16  # log2 of cells in a segment of the sketch
#: log2 of the cells up to which a task counts in whole rows, and of the widest sketch; hashes sent on together.
DENSE, MAX_WIDTH, TOGETHER = 24, 29, 1 << 21
#: Bytes of a merged sketch that the driver fetches in one job.
AT_ONCE = 32 << 20
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = -(1 << 63)  # stands for a null id inside the passes


def _anchors(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the short runs; for each window start of k words the position of its anchor, and the valid window starts."""
    short = max(1, k // 2)
    g = tk.run_hashes(w, short, 2)
    span = k - short + 1
    n = len(w) - k + 1
    if n <= 0:
        return g, np.empty(0, np.int64), np.empty(0, np.int64)
    best, at, width = g.copy(), np.arange(len(g), dtype=np.int32), 1
    while width < span:  # the leftmost minimum over a growing width
        step = min(width, span - width)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        width += step
    return g, at[:n].astype(np.int64), np.flatnonzero(tk.inside(first, k))


def _cells(g: np.ndarray, log2_width: int) -> list[np.ndarray]:
    shift = np.uint64(64 - log2_width)
    return [(g * np.uint64(odd)) >> shift for odd in _ODD]


def _dense_rows(counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What is counted in whole rows of cells, by segment."""
    found = []
    for row, cells in enumerate(counts):
        at = np.flatnonzero(cells)
        found.append((row, at, cells[at] > 1))
    yield from _sparse_rows(found, [len(c) for c in counts])


def _sparse_rows(found: list[tuple[int, np.ndarray, np.ndarray]], widths: list[int]) -> Iterator[pa.RecordBatch]:
    """found: row, cells ascending, and whether each was counted more than once."""
    seg, once, more = [], [], []
    for (row, at, many), width in zip(found, widths):
        of = at >> SEGMENT
        low = (at & ((1 << SEGMENT) - 1)).astype(np.uint16)
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
            seg.append(row * (width >> SEGMENT) + int(of[a]))
            once.append(low[a:b][~many[a:b]].tobytes())
            more.append(low[a:b][many[a:b]].tobytes())
    yield pa.record_batch([pa.array(seg, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["seg", "once", "more"])


def merged_sketch(hashes: DataFrame, fill, log2_width: int) -> np.ndarray:
    """Bits of the cells that were counted twice or more. fill(batch) gives arrays of hashes to count.

    Up to 2**DENSE cells a task counts in whole rows of cells; beyond, it sends on what each array hits, so that its memory stays the array's."""

    def counted(g):
        out = []
        for row, idx in enumerate(_cells(g, log2_width)):
            idx.sort()
            edge = np.flatnonzero(np.diff(idx, prepend=np.uint64(1 << 63)))
            out.append((row, idx[edge].astype(np.int64), np.diff(np.append(edge, len(idx))) > 1))
        return out

    def build(batches):
        widths = [1 << log2_width for _ in _ODD]
        if log2_width > DENSE:
            held: list[np.ndarray] = []
            for batch in batches:
                for g in fill(batch):
                    held.append(g)
                    if sum(map(len, held)) >= TOGETHER:
                        yield from _sparse_rows(counted(np.concatenate(held)), widths)
                        held = []
            if held:
                yield from _sparse_rows(counted(np.concatenate(held)), widths)
            return
        counts = [np.zeros(n, np.uint8) for n in widths]
        for batch in batches:
            for g in fill(batch):
                for row, at, many in counted(g):
                    counts[row][at] = np.minimum(counts[row][at] + np.where(many, 2, 1).astype(np.uint8), 2)
        yield from _dense_rows(counts)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                cells = held.setdefault(seg, np.zeros(1 << SEGMENT, np.uint8))
                u = np.frombuffer(once, np.uint16)
                cells[u] = np.minimum(cells[u] + 1, 2)
                cells[np.frombuffer(more, np.uint16)] = 2
        segs = sorted(held)
        yield pa.record_batch([pa.array(segs, pa.int32()), pa.array([np.packbits(held[s] > 1).tobytes() for s in segs], pa.binary())], names=["seg", "bits"])

    parts = hashes.mapInArrow(build, "seg int, once binary, more binary")
    merged = parts.repartition(64, "seg").mapInArrow(merge, "seg int, bits binary")
    out = np.zeros((len(_ODD) << log2_width) >> 3, np.uint8)
    size = (1 << SEGMENT) >> 3
    # A number of segments fixed by the width: up to AT_ONCE bytes in one job, more a partition at a time, one job for each.
    for seg, bits in merged.collect() if len(out) <= AT_ONCE else merged.toLocalIterator(prefetchPartitions=True):
        out[seg * size : (seg + 1) * size] = np.frombuffer(bits, np.uint8)
    return out


def estimated_twice(bits: np.ndarray, g: np.ndarray, log2_width: int) -> np.ndarray:
    good = np.ones(len(g), bool)
    for row, idx in enumerate(_cells(g, log2_width)):
        at = idx.astype(np.int64) + (row << log2_width)
        good &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return good


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def sketch_width(n_words: int) -> int:
    """log2 of the cells in a row of the sketch: eight for each of about n_words / 6 anchors."""
    return min(MAX_WIDTH, max(SEGMENT, (4 * n_words // 3).bit_length()))


def repeated_starts(docs: DataFrame, k: int = 20, log2_width: int | None = None) -> DataFrame:
    """(doc_id, starts): for documents with repeats, the starts of repeated windows as runs, start << 32 | length."""
    sc = docs.sparkSession.sparkContext
    log2_width = log2_width or sketch_width(total_words(docs))

    def fill(batch):
        for _, raw, offs in tk.slices(batch, "text"):
            starts, ends, first = tk.words(raw, offs)
            g, at, ok = _anchors(tk.word_hashes(raw, starts, ends), first, k)
            yield g[np.unique(at[ok])]

    sketch = sc.broadcast(merged_sketch(docs.select("text"), fill, log2_width))

    def candidates(batches):
        bits = sketch.value
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                starts, ends, first = tk.words(raw, offs)
                w, other = tk.word_hash_pair(raw, starts, ends)
                g, at, ok = _anchors(w, first, k)
                if not len(ok):
                    continue
                seen = np.zeros(len(g), bool)
                used = np.unique(at[ok])
                seen[used] = estimated_twice(bits, g[used], log2_width)
                ok = ok[seen[at[ok]]]
                if not len(ok):
                    continue
                h1 = tk.run_hashes(w, k, 1)[ok].view(np.int64)
                h2 = (tk.run_hashes(other, k, 2)[ok] >> np.uint64(32)).astype(np.int64)
                own = tk.owners(first)[ok]
                doc, pos = _ids(piece)[own], ok - first[own]
                order = np.lexsort((pos, doc, h2, h1))
                a, b, d, p = h1[order], h2[order], doc[order], pos[order]
                same = np.zeros(len(a), bool)
                same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
                later = same & ((d != d[head]) | (p != p[head]))
                keep = np.sort(order[~later])
                yield pa.record_batch([pa.array(h1[keep]), pa.array(h2[keep], pa.int64()), pa.array(doc[keep]), pa.array(pos[keep] << 32 | 1, pa.int64())], names=["h1", "h2", "doc", "run"])
                if later.any():  # an earlier start stands in this very slice: no need to compare these further
                    gone = np.sort(order[later])
                    doc, pos = doc[gone], pos[gone]
                    turn = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1))))
                    length = np.diff(np.append(turn, len(doc)))
                    doc, pos = doc[turn], pos[turn]
                    yield pa.record_batch([pa.array(pos * 0x9E3779B1 + doc), pa.array(np.full(len(doc), -1, np.int64)), pa.array(doc), pa.array(pos << 32 | length, pa.int64())], names=["h1", "h2", "doc", "run"])

    found = docs.select("doc_id", "text").mapInArrow(candidates, "h1 long, h2 long, doc long, run long")
    order = Window.partitionBy("h1", "h2").orderBy("doc", "run")
    repeats = found.withColumn("nth", F.rank().over(order)).filter((F.col("h2") < 0) | (F.col("nth") > 1))
    return repeats.groupBy("doc").agg(F.collect_list("run").alias("starts")).select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "starts")


def dedup_substrings(docs: DataFrame, k: int = 20, log2_width: int | None = None, with_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, and with with_text the kept text (null for a null text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = repeated_starts(docs, k, log2_width).withColumnRenamed("doc_id", "runs_of")
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("runs_of")), "left").select("doc_id", "text", "starts")

    def strip(batches):
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                starts, ends, first = tk.words(raw, offs)
                gone = np.zeros(len(starts) + 1, np.int32)
                held = piece.column("starts")
                held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
                for i in np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False)):
                    run = held[int(i)].values.to_numpy(zero_copy_only=False)
                    a = run >> 32
                    b = np.minimum(a + (run & 0xFFFFFFFF) + (k - 1), first[i + 1] - first[i])
                    fits = a < b
                    np.add.at(gone, first[i] + a[fits], 1)
                    np.add.at(gone, first[i] + b[fits], -1)
                removed = np.cumsum(gone)[:-1] > 0
                sums = np.concatenate(([0], np.cumsum(removed)))
                data, n_words, n_removed, digests, kept_texts = raw.tobytes(), np.diff(first), sums[first[1:]] - sums[first[:-1]], [], []
                for i in range(len(piece)):
                    a, b = first[i], first[i + 1]
                    if n_removed[i]:
                        left = np.flatnonzero(~removed[a:b]) + a
                        kept = b" ".join([data[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist())])
                    else:
                        kept = b" ".join(data[offs[i] : offs[i + 1]].split())
                    digests.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_texts.append(kept)
                cols = [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                if with_text:
                    known = piece.column("text").is_valid().to_pylist()
                    cols.append(pa.array([t if ok else None for t, ok in zip(kept_texts, known)], pa.binary()).cast(pa.string()))
                yield pa.record_batch(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)

"""Exact n-gram Jaccard join in the Jaccard metric space, by pivots, windows and recursion.

The Jaccard distance d is a metric on finite sets, and so is its multiset form on histograms of shingles
over BINS bins, which never exceeds d. With radius r, sets link at d <= r.

Method. (1) Texts with equal shingle sets become one class. (2) Voronoi regions of the first level
have one-shingle sets as pivots: d(x, {s}) < 1 only where s is in x, and ties go by one global
order of shingles, rare ones first (by a count sketch of the corpus) and then by hash. Whole documents
don't work as pivots of this level: unrelated texts are all at a distance near 1 from one another, so a window
of 2 r around any of them holds everything. What lies within r of a set of n shares all but a fraction of its
shingles, so its region is among the first n - ceil((1 - r) n) + 1: the set is replicated to those and
no others, and two sets need comparing only in the region of their first common shingle, where their
places in their own orders bound what they can share. (3) Inside a region pivots are documents.
First round: cells around document pivots within reach; members are compared exactly with the cell's
centre, and links make components. Later rounds, for sets of different components only: the region is split
by its document pivots (farthest first) into Voronoi cells by the histogram metric; a set is
replicated to every cell whose pivot is at most 2 r farther than its own (triangle
inequality), and cells are split again until they have at most CELL sets or splitting no longer helps;
then blocks of pairs are held against the bounds. The second round compares each set with its
nearest ones, the third every pair that is left, so that no link between components is lost. Pairs inside a
component can't change the result and are not compared.

Regions of a shingle that the sketch holds for common are cut into blocks of some HOT sets, and every pair of
blocks is a task's work of its own. Sketches are sized by the words counted in the input, up to MAX_CELLS
and MAX_WIDTH; beyond, they only send more sets to the shuffle by regions, which drops those that are alone.

Defined cases. Texts without words, null texts and null ids have no links; a null id's component
is null. Rows that share an id are one document that has the links of all of them. An empty table
gives an empty result. Texts may be of any length. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import discard, stash, total_words
from .components import components
from .substring_dedup import estimated_twice, merged_sketch

#: Bins of the coarse histogram, which travels with each replica, and of the fine one, which is fetched for pairs.
BINS, FINE = 32, 256
#: Small regions' pairs are all bounded at once; cells of up to CELL sets are not split; PIVOTS documents split a larger one.
FEW, CELL, PIVOTS = 12, 256, 8
#: Sets that one block of a common shingle's region holds, about.
HOT = 4096
MIN_CELLS, MAX_CELLS, MAX_WIDTH = 20, 24, 28
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NEAREST = 4


def _shingle_lists(raw: np.ndarray, offs: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    raw = _LOWER[raw]
    starts, ends, first = tk.words(raw, offs)
    w = tk.word_hashes(raw, starts, ends)
    runs: dict[int, np.ndarray] = {}
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = min(k, b - a)
        if n and n not in runs:
            runs[n] = tk.run_hashes(w, n, 2)
        yield np.unique(runs[n][a : b - n + 1]) if n else np.empty(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def frequency_classes(docs: DataFrame, k: int, log2_cells: int) -> tuple[np.ndarray, dict[int, int]]:
    """For each cell of a count sketch of all shingles, by how many powers of two it is above four times the mean; and into how many
    blocks the regions of its shingles are cut, for cells where that is more than one."""
    size = 1 << 16

    def count(batches):
        held = np.zeros(1 << log2_cells, np.uint32)
        for batch in batches:
            for _, raw, offs in tk.slices(batch, "text"):
                raw = _LOWER[raw]
                starts, ends, first = tk.words(raw, offs)
                h = tk.run_hashes(tk.word_hashes(raw, starts, ends), k, 2)[tk.inside(first, k)]
                cells, n = np.unique(h >> np.uint64(64 - log2_cells), return_counts=True)
                held[cells.astype(np.int64)] += n.astype(np.uint32)
        rows = [(s, np.flatnonzero(part), part) for s in range(len(held) // size) if (part := held[s * size : (s + 1) * size]).any()]
        places = [u.astype(np.uint16).tobytes() for _, u, _ in rows]
        counts = [p[u].astype(np.uint8 if p.max() < 256 else np.uint32).tobytes() for _, u, p in rows]
        yield pa.record_batch([pa.array([s for s, _, _ in rows], pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["seg", "at", "n"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(seg, np.zeros(size, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint8 if 2 * len(n) == len(at) else np.uint32)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["seg", "n"])

    total = np.zeros(1 << log2_cells, np.int64)
    parts = docs.select("text").mapInArrow(count, "seg int, at binary, n binary").repartition(16, "seg").mapInArrow(merge, "seg int, n binary")
    for seg, n in parts.collect():  # 2**log2_cells counts, whatever the input
        total[seg * size : (seg + 1) * size] = np.frombuffer(n, np.int64)
    over = total / max(total.mean() * 4, 8)
    blocks = np.ceil((total - total.mean()) / HOT).astype(np.int64)
    cut = np.flatnonzero((over > 1) & (blocks > 1))
    return np.where(over > 1, np.ceil(np.log2(np.maximum(over, 1))), 0).astype(np.uint8), dict(zip(cut.tolist(), blocks[cut].tolist()))


def signatures(docs: DataFrame, k: int, percent: int, ranks, log2_cells: int) -> DataFrame:
    """(doc_id, n, set1, set2, prefix, bins, fine) of each row: size, a 128-bit fingerprint of the set, its first shingles and its histograms.

    ranks: the broadcast result of frequency_classes."""
    shift = np.uint64(64 - log2_cells)

    def sign(batches):
        of = ranks.value[0]
        for batch in batches:
            for piece, raw, offs in tk.slices(batch, "text"):
                n, one, two, prefix, bins, fine = [], [], [], [], [], []
                for s in _shingle_lists(raw, offs, k):
                    n.append(len(s))
                    one.append(int(np.add.reduce(tk.mix(s + np.uint64(11)), dtype=np.uint64).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(tk.mix(s + np.uint64(13)), dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    t = prefix_length(len(s), percent) if len(s) else 0
                    rank = of[(s >> shift).astype(np.int64)]
                    plain = np.flatnonzero(rank == 0)  # ascending by hash already
                    order = plain[:t] if len(plain) >= t else np.lexsort((s, rank))[:t]
                    prefix.append(s[order].view(np.int64))
                    histogram = np.bincount((tk.mix(s) >> np.uint64(56)).astype(np.int64), minlength=FINE)
                    fine.append(np.minimum(histogram, 255).astype(np.uint8).tobytes())
                    bins.append(np.minimum(histogram.reshape(BINS, -1).sum(1), 255).astype(np.uint8).tobytes())
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix) if prefix else np.empty(0, np.int64), pa.int64()))
                yield pa.record_batch([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, pa.array(bins, pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "n", "set1", "set2", "prefix", "bins", "fine"])

    return docs.mapInArrow(sign, "doc_id long, n long, set1 long, set2 long, prefix array<long>, bins binary, fine binary")


def _complete(batches: Iterator[pa.RecordBatch], names: list[str], of: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted rows in pieces that end where a group (equal in the columns of) ends. Groups are of bounded size."""
    held = None

    def column(batch, c):
        if c == "bins":
            return np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS)
        return batch.column(c).to_numpy(zero_copy_only=False)

    for batch in batches:
        if not len(batch):
            continue
        cols = {c: column(batch, c) for c in names}
        if held is not None:
            cols = {c: np.concatenate((held[c], x)) for c, x in cols.items()}
        last = np.ones(len(cols[names[0]]), bool)
        for c in of:
            last &= cols[c] == cols[c][-1]
        split = len(last) - int(last[::-1].argmin()) if not last.all() else 0  # the last group may go on in the next batch
        if split:
            yield {c: x[:split] for c, x in cols.items()}
        held = {c: x[split:] for c, x in cols.items()}
    if held is not None:
        yield held


def _edges(cols: dict[str, np.ndarray], of: list[str]) -> np.ndarray:
    """Where groups of equal rows begin."""
    fresh = np.zeros(len(cols[of[0]]), bool)
    fresh[:1] = True
    for c in of:
        fresh[1:] |= cols[c][1:] != cols[c][:-1]
    return np.flatnonzero(fresh)


def regions(classes: DataFrame, percent: int, ranks, log2_cells: int, log2_width: int) -> DataFrame:
    """(pivot, blocks, block, doc, n, pos): each class in the regions that its window reaches, but for regions in which nothing can link.

    pos: how many of the set's shingles come before the pivot. blocks: into how many the region is cut; block: the class's own."""

    def fill(batch):
        yield batch.column("prefix").flatten().to_numpy(zero_copy_only=False).view(np.uint64).copy()

    bits = classes.sparkSession.sparkContext.broadcast(merged_sketch(classes.select("prefix"), fill, log2_width))

    def spread(batches):
        cut = ranks.value[1]
        hot = np.array(sorted(cut), np.int64)
        parts = np.array([cut[c] for c in hot.tolist()], np.int32)
        for batch in batches:
            lists = batch.column("prefix")
            pivots = lists.flatten().to_numpy(zero_copy_only=False)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(batch)), length)
            pos = np.arange(len(pivots)) - np.repeat(np.cumsum(length) - length, length)
            good = np.flatnonzero(estimated_twice(bits.value, pivots.view(np.uint64), log2_width))
            doc, n = (batch.column(c).to_numpy() for c in ("doc_id", "n"))
            for a in range(0, len(good), 50_000):
                at = good[a : a + 50_000]
                cell = (pivots[at].view(np.uint64) >> np.uint64(64 - log2_cells)).astype(np.int64)
                blocks = np.ones(len(at), np.int32)
                if len(hot):
                    nth = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
                    blocks = np.where(hot[nth] == cell, parts[nth], 1).astype(np.int32)
                d = doc[own[at]]
                block = (tk.mix(d.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int32)
                yield pa.record_batch([pa.array(x) for x in (pivots[at], blocks, block, d, n[own[at]].astype(np.int32), pos[at].astype(np.int32))], names=["pivot", "blocks", "block", "doc", "n", "pos"])

    def company(batches):
        """Drops regions with one set, and those where no set could be the smaller one of a pair. Blocks stay, as others of their region may link."""
        names, of = ["pivot", "blocks", "block", "doc", "n", "pos"], ["pivot", "block"]
        for cols in _complete(batches, names, of):
            edge = _edges(cols, of)
            length = np.diff(np.append(edge, len(cols["doc"])))
            smaller = cols["pos"] * (100 + percent) <= cols["n"].astype(np.int64) * (100 - percent)
            keep = (length > 1) & np.logical_or.reduceat(smaller, edge) | (cols["blocks"][edge] > 1)
            at = np.flatnonzero(np.repeat(keep, length))
            yield pa.record_batch([pa.array(cols[c][at]) for c in names], names=names)

    schema = "pivot long, blocks int, block int, doc long, n int, pos int"
    rows = classes.select("doc_id", "n", "prefix").mapInArrow(spread, schema)
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block").mapInArrow(company, schema)


def _near(bins_a, bins_b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether pairs may link: the symmetric difference of linked sets is at most (1 - t) / (1 + t) of their sizes' sum."""
    off = np.abs(bins_a.astype(np.int16) - bins_b.astype(np.int16)).sum(-1)
    fits = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return fits & (off * (100 + percent) <= (100 - percent) * (n_a + n_b))


class Region:
    """The rows of one piece of regions, and what its pairs must meet."""

    def __init__(self, cols: dict[str, np.ndarray], percent: int):
        self.doc, self.bins, self.root, self.percent = cols["doc"], cols["bins"], cols["root"], percent
        self.size, self.pos = cols["n"].astype(np.int64), cols["pos"].astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows that may link here: of different roots, near by size, histogram and places of the common shingle."""
        good = self.root[a] != self.root[b]
        a, b = a[good], b[good]
        # The first common shingle and all after it must be enough.
        after = np.minimum(self.size[a] - self.pos[a], self.size[b] - self.pos[b])
        good = after * (100 + self.percent) >= self.percent * (self.size[a] + self.size[b])
        a, b = a[good], b[good]
        good = np.empty(len(a), bool)
        for i in range(0, len(a), 65_536):
            x, y = a[i : i + 65_536], b[i : i + 65_536]
            good[i : i + 65_536] = _near(self.bins[x], self.bins[y], self.size[x], self.size[y], self.percent)
        return a[good], b[good]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        bins = self.bins[rows].astype(np.int64)
        return np.column_stack((bins, self.size[rows] - bins.sum(1)))

    def distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        """The histogram metric, which is never above the Jaccard distance: one minus the sum of least by the sum of largest counts.

        What the bins' bytes can't count is a bin of its own."""
        x, y = self.counts(rows), self.counts(np.array([pivot]))
        return 1 - np.minimum(x, y).sum(1) / np.maximum(np.maximum(x, y).sum(1), 1)

    def cells(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First round, rows ascending by size: a cell's centre with each of its members."""
        free = np.ones(len(rows), bool)
        size, bins = self.size[rows], self.bins[rows]
        for i in range(len(rows)):
            if not free[i]:
                continue
            free[i] = False
            at = np.arange(i + 1, np.searchsorted(size, 100 * size[i] // self.percent, "right"))
            cell = at[_near(bins[at], bins[i], size[at], size[i], self.percent)]
            if not len(cell):
                continue
            free[cell] = False
            cell = np.concatenate(([i], cell))
            centre = int(cell[np.abs(bins[cell] - bins[cell].astype(np.float32).mean(0)).sum(1).argmin()])
            cell = cell[cell != centre]
            yield np.full(len(cell), rows[centre]), rows[cell]

    def split(self, home: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home, others) of cells in which every pair of a home row and another within the radius is met. others holds home."""
        if len(others) <= CELL:
            yield home, others
            return
        pivots, least = [int(others[0])], self.distance(others, int(others[0]))
        away = [least]
        while len(pivots) < PIVOTS:  # the farthest from those before
            pivots.append(int(others[least.argmax()]))
            away.append(self.distance(others, pivots[-1]))
            least = np.minimum(least, away[-1])
        own = np.argmin(away, axis=0)
        at_home = np.isin(others, home)
        for c, far in enumerate(away):
            mine = others[at_home & (own == c)]
            reach = others[far <= least + 2 * (1 - self.percent / 100) + 1e-9]
            if not len(mine):
                continue
            if len(reach) > 0.7 * len(others):  # splitting doesn't help: blocks of pairs
                yield mine, reach
            else:
                yield from self.split(mine, reach)

    def across(self, rows: np.ndarray, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Later rounds: pairs of rows of different roots, each row outside the main component with its nearest ones or with all."""
        values, counts = np.unique(self.root[rows], return_counts=True)
        main = values[counts.argmax()]
        for home, others in self.split(rows, rows):
            home = home[self.root[home] != main]
            step = max(1, (1 << 20) // max(len(others), 1))
            for i in range(0, len(home), step):
                some = home[i : i + step]
                a, b = self.pairs(np.repeat(some, len(others)), np.tile(others, len(some)))
                if every:
                    good = (self.root[b] == main) | (a < b) | ~np.isin(b, home)
                    yield a[good], b[good]
                    continue
                off = np.abs(self.bins[a].astype(np.int16) - self.bins[b].astype(np.int16)).sum(1)
                order = np.lexsort((off, a))
                a, b = a[order], b[order]
                turn = np.flatnonzero(np.diff(a, prepend=-1))
                nth = np.arange(len(a)) - np.repeat(turn, np.diff(np.append(turn, len(a))))
                yield a[nth < NEAREST], b[nth < NEAREST]


def _pairs_of_regions(region: Region, edge: np.ndarray, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare in whole regions, which start at the rows of edge."""
    length = np.diff(np.append(edge, len(region.doc)))
    mixed = (length > 1) & (np.minimum.reduceat(region.root, edge) != np.maximum.reduceat(region.root, edge))
    small = FEW if turn > 1 else 2
    for m in range(2, small + 1):
        first = edge[mixed & (length == m)]
        for i in range(m):
            for j in range(i + 1, m):
                yield region.pairs(first + i, first + j)
    for a, m in zip(edge[mixed & (length > small)].tolist(), length[mixed & (length > small)].tolist()):
        rows = np.arange(a, a + m)
        yield from region.cells(rows) if turn == 1 else region.across(rows, turn == 3)


def _candidate_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """rows: pivot, one, two (the blocks met), doc, n, pos, bins, root. Distinct pairs (a, b), a < b, to compare."""
    names, of = ["pivot", "one", "two", "doc", "n", "pos", "bins", "root"], ["pivot", "one", "two"]

    def search(batches):
        for cols in _complete(batches, names, of):
            region = Region(cols, percent)
            found = list(_pairs_of_regions(region, _edges(cols, of), turn))
            a, b = (region.doc[np.concatenate(x)] for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
            yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    pairs = rows.select(*names).repartition(*of).sortWithinPartitions(*of, "n", "doc").mapInArrow(search, "a long, b long")
    return pairs.filter("a < b").distinct()


def _met(spread: DataFrame, heads: DataFrame, rooted: DataFrame | None) -> DataFrame:
    """What _candidate_pairs takes. Before there are roots, each class in the first of its regions that is left; then all, and each block with every other."""
    bins = heads.select(F.col("doc_id").alias("doc"), "bins")
    if rooted is None:
        least = spread.groupBy("doc").agg(F.min(F.struct("pos", "pivot", "block", "n")).alias("x"))
        rows = least.select("doc", "x.*").withColumn("one", F.col("block")).withColumn("two", F.col("block"))
        return rows.withColumn("root", F.col("doc")).join(bins, "doc")
    named = bins.join(rooted.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "bins", F.coalesce("root", "doc").alias("root"))
    rows = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    return rows.join(named, "doc")


def _closer(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Those of pairs that may link by their fine histograms."""

    def prune(batches):
        for batch in batches:
            if len(batch):
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, FINE) for c in ("fine_a", "fine_b"))
                keep = np.concatenate([_near(one[i : i + 8192], two[i : i + 8192], *(batch.column(c).to_numpy()[i : i + 8192] for c in ("n_a", "n_b")), percent) for i in range(0, len(batch), 8192)])
                yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    fine = lambda x: heads.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}"))
    return pairs.join(fine("b"), "b").join(fine("a"), "a").mapInArrow(prune, "a long, b long").distinct()


def _texts_of(docs: DataFrame, pairs: DataFrame, log2_width: int = 23) -> DataFrame:
    """docs that stand in pairs. A Bloom filter of fixed size keeps most others out of the shuffle."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    hashed = lambda c: tk.mix(c.to_numpy(zero_copy_only=False).view(np.uint64))

    def fill(batch):
        yield np.repeat(hashed(batch.column("doc_id")), 2)  # a cell counted twice is a bit that is set

    bits = docs.sparkSession.sparkContext.broadcast(merged_sketch(wanted, fill, log2_width))

    def sieve(batches):
        for batch in batches:
            yield batch.filter(pa.array(estimated_twice(bits.value, hashed(batch.column("doc_id")), log2_width)))

    return docs.filter("doc_id is not null and text is not null").mapInArrow(sieve, docs.schema).join(wanted, "doc_id", "left_semi").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs whose whole texts are within the radius, compared exactly."""
    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def compare(batches):
        last, mine = None, None
        for batch in batches:
            keep = []
            for part, raw, offs in tk.slices(batch, "text_b"):
                a, theirs = part.column("text_a"), _shingle_lists(raw, offs, k)
                for i, s in enumerate(theirs):
                    text = a[i].as_py()
                    if text != last:
                        data = np.frombuffer(text.encode(), np.uint8)
                        last, mine = text, next(_shingle_lists(data, np.array([0, len(data)]), k))
                    at = np.searchsorted(mine, s)
                    both = int((mine[np.minimum(at, len(mine) - 1)] == s).sum()) if len(mine) else 0
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(mine) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(two, "b").join(one, "a").mapInArrow(compare, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, log2_width: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs. Sets of k-word shingles link at percent / 100 or more.

    log2_width: of the sketch that leaves out shingles of one set; by default as the words ask for."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_words = max(1, total_words(docs))
    log2_cells = min(MAX_CELLS, max(MIN_CELLS, (n_words // 32).bit_length()))
    log2_width = log2_width or min(MAX_WIDTH, max(16, (8 * n_words * (100 - percent) // 100).bit_length()))
    ranks = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, k, log2_cells))
    wide = stash(signatures(docs, k, percent, ranks, log2_cells), "jaccard-sets")
    # Rows of a class have the same set, and so the same prefix and histograms.
    of, known = ["set1", "set2", "n"], "doc_id is not null and n > 0"
    heads = wide.filter(known).groupBy(*of).agg(F.min("doc_id").alias("doc_id"), *[F.any_value(c).alias(c) for c in ("prefix", "bins", "fine")])
    heads = stash(heads, "jaccard-heads")
    signed = stash(wide.select("doc_id", *of), "jaccard-sizes")
    discard(wide)
    member = signed.filter(known).join(heads.select(*of, F.col("doc_id").alias("head")), of).select("doc_id", "head").distinct()
    member = stash(member, "jaccard-classes")
    spread = stash(regions(heads, percent, ranks, log2_cells, log2_width), "jaccard-regions")
    # Only classes with company are met again. An id whose rows have several sets heads several classes.
    few, heads_before = heads.select("doc_id", "n", "bins", "fine").join(spread.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), heads
    heads = stash(few, "jaccard-heads")
    discard(heads_before)
    # Rows of one id are one node: each is tied to the heads of all its rows' classes.
    ties = member.filter("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    tried = rooted = None
    for turn in (1, 2, 3):
        pairs = _candidate_pairs(_met(spread, heads, rooted), turn, percent)
        pairs = stash(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        close = stash(_closer(pairs, heads, percent), "jaccard-close")
        if not close.isEmpty():
            found = stash(_linked(close, _texts_of(docs, close), k, percent), "jaccard-links")
            # Components so far are stars; what is new links their roots.
            links = found if rooted is None else found.unionByName(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")))
            rooted = stash(components(links), "jaccard-roots")
        elif turn == 1:
            rooted = heads.sparkSession.createDataFrame([], "node long, root long")
    links = ties.unionByName(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    discard(spread)
    discard(heads)
    roots = stash(components(links), "jaccard-roots").select(F.col("node").alias("__node"), "root")
    sizes = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(roots, F.col("doc_id") == F.col("__node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs with one row of each group of linked ones, the one with the least id.

    An id that repeats stands for rows of their own: rows equal in id and text leave one, others go only if they link. Rows with null ids stay."""
    known = docs.filter("doc_id is not null")
    own = F.col("doc_id").cast("long")
    repeated = stash(known.groupBy(own.alias("__repeated")).count().filter("count > 1").select("__repeated"), "repeated")
    if repeated.isEmpty():
        nodes, node = known, own
    else:  # a row of a repeated id goes under a hash of id and text
        nodes = known.join(repeated, own == F.col("__repeated"), "left")
        node = F.when(F.col("__repeated").isNull(), own).otherwise(F.xxhash64("doc_id", "text"))
    heads = jaccard_components(nodes.select(node.alias("doc_id"), "text"), k, percent).filter("component_id = doc_id").select(F.col("doc_id").alias("__head")).distinct()
    kept = nodes.join(heads, node == F.col("__head"), "left_semi")
    if nodes is not known:
        kept = kept.filter("__repeated is null").unionByName(kept.filter("__repeated is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))

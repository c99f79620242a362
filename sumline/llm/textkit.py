"""Word splitting and rolling hashes over whole Arrow batches of texts, in numpy.

Words are maximal runs of bytes other than space and \\x09-\\x0D, which on UTF-8 is the same as
on code points. A word has two 64-bit hashes under independent keys, mixed after every eight bytes,
so that no algebra of the bytes makes words collide; a run of k words is hashed as a polynomial over them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
_KEYS = tuple(np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 2, dtype=np.uint64))
LONG_WORD = 512
_MASK = (1 << 64) - 1
BASES = (0x9E3779B97F4A7C15 | 5, 0xD1B54A32D192ED03 | 5, 0x8CB92BA72F3D8DD7 | 5)
SLICE_BYTES = 4 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base & _MASK
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step & _MASK
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n or more."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held = _powers[base] = (_geometric(base, size), _geometric(pow(base, -1, 1 << 64), size))
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of the batch with at most about limit bytes of text: the piece, its bytes, its offsets. Null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield batch.slice(a, b - a), raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and for each text the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    solid = SOLID[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = solid[cuts]
    finish[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hash_pair(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 2) -> tuple[np.ndarray, ...]:
    """Two hashes of each word (or one, for one lane) under independent keys: eight bytes at a time, each put through the finaliser.

    Words of more than LONG_WORD bytes, of which there are few, take the halves of a keyed BLAKE2b digest."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    out = tuple(mix(length ^ key) for key in _KEYS[:lanes])
    rows = np.flatnonzero(length <= LONG_WORD)
    done = 0
    while len(rows):
        at = starts[rows] + done
        chunk = eight[at]
        left = ends[rows] - at
        last = left < 8
        chunk[last] &= (np.uint64(1) << (left[last] * 8).astype(np.uint64)) - np.uint64(1)
        for h, key in zip(out, _KEYS):
            h[rows] = mix((h[rows] ^ chunk) + key)
        rows, done = rows[left > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=16, key=b"sumline words").digest()
        for h, half in zip(out, np.frombuffer(digest, np.uint64)):
            h[i] = half
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hash_pair(raw, starts, ends, 1)[0]


def run_hashes(w: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of the k words from each position on; positions run over all words, whatever text they are in.

    which: the base; hashes of one w under different bases aren't independent, those of a pair's two halves are."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(BASES[which], len(w) + 1)
    sums = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n] + np.uint64(k))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For the positions of run_hashes: whether the k words lie within one text. first: as from words()."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    good = np.ones(n, bool)
    if n and k > 1:  # the last k - 1 positions before each text's end are cut
        for back in range(1, k):
            at = first[1:] - back
            at = at[(at >= 0) & (at < n)]
            good[at] = False
    return good


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

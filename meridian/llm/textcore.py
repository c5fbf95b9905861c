"""Words and hashes of whole Arrow text columns in NumPy, without a Python step per word; byte classes; local groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Salts of independent hash functions, and the multipliers of mixing.
SALTS = (U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F))
MIX_A, MIX_B, JOIN = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93)
#: The six ASCII white-space characters that separate words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes; bytes of non-ASCII characters count as letters.
LETTER, UPPER, DIGIT = (np.zeros(256, bool) for _ in range(3))
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER[65:91] = True
DIGIT[48:58] = True
SIGN = ~(LETTER | DIGIT | WHITE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Text handled at once; a longer single document is a piece of its own.
CHUNK_BYTES = 1 << 19


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text: (slice, bytes, offsets)."""
    for batch in batches:
        data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of each document's words among them.

    A word is a maximal run of bytes that aren't white space, or of those that ``inside`` (256 booleans) holds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~WHITE[data] if inside is None else inside[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    edges = offs[:-1][offs[:-1] < offs[1:]]
    begin[edges] = solid[edges]
    stop[edges[1:] - 1] = solid[edges[1:] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX_A
        x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


#: Places in a word whose terms are looked up; later places are mixed one by one, to the same effect.
_PLACES = 64
_TERMS = [mix(np.arange(_PLACES << 8, dtype=U64) + salt) for salt in SALTS]


def word_sums(data: np.ndarray, starts: np.ndarray, salt: int = 0) -> np.ndarray:
    """Running sums of a random number for each (byte, place in its word): the difference of two within a word tells its bytes.

    The numbers have no algebra between places, unlike the powers of a polynomial hash, so no family of texts collides.
    """
    total = np.zeros(len(data) + 1, U64)
    if not len(starts):
        return total
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data)))).astype(place.dtype)
    terms = _TERMS[salt][np.minimum(place, _PLACES - 1) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        terms[far] = mix((place[far].astype(U64) << U64(8) | data[far]) + SALTS[salt])
    np.cumsum(terms, out=total[1:])
    return total


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, total: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; with ``total`` (of word_sums), of its bytes up to ``ends``."""
    total = word_sums(data, starts, salt) if total is None else total
    with np.errstate(over="ignore"):
        return mix(total[ends] - total[starts] + (ends - starts).astype(U64))


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x + (y << U64(23) | y >> U64(41)) * JOIN)


def window_hashes(words_: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words (len - size + 1 of them), joined from halves, quarters and so on."""
    out, have, block, k = None, 0, words_, 1
    while have < size:
        if size & k:
            out = block if out is None else _join(out[: max(0, len(block) - have)], block[have:])
            have += k
        k *= 2
        if have < size:
            block = _join(block[: max(0, len(block) - k // 2)], block[k // 2 :])
    return out[: max(0, len(words_) - size + 1)]


def whole_hashes(words_: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each document's words, whose offsets are ``at``."""
    n = np.diff(at)
    total = np.zeros(len(words_) + 1, U64)
    with np.errstate(over="ignore"):
        place = np.arange(len(words_), dtype=np.int64) - np.repeat(at[:-1], n)
        np.cumsum(mix(words_ + (place + 1).astype(U64) * SALTS[salt]), out=total[1:])
        return mix(total[at[1:]] - total[at[:-1]] + n.astype(U64) + SALTS[salt])


def kept_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words given by the spans, joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    to = np.cumsum(size)
    src = np.arange(int(to[-1]), dtype=np.int64) + np.repeat(starts - (to - size), size)
    src[to - 1] = starts[0]
    out = data[src]
    out[to - 1] = 32
    return out[:-1].tobytes()


def hook(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the roots of all pairs together until they agree; the smaller number is the root."""
    while len(i):
        a, b = parent[i], parent[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        open_ = parent[i] != parent[j]
        i, j = i[open_], j[open_]

"""Word shingles of whole texts as sorted 64-bit sets, and fast similarity sketches of them."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))
#: Bound of a worker's memo of word hashes; a full one is emptied.
MAX_WORDS = 250_000
_WORDS: dict[bytes, int] = {}
_EMPTY = np.iinfo(np.uint64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def words(text: str) -> list[bytes]:
    """Maximal runs of other than blanks and 0x09-0x0D, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `width` words; of the whole sequence where there are fewer."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    known = _WORDS
    if len(known) > MAX_WORDS:
        known.clear()
    try:
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    except KeyError:
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = min(width, len(ids))
    runs = np.full(len(ids) - n + 1, np.uint64(n))
    for k in range(n):
        runs = mix(runs * _GOLD + ids[k : len(ids) - n + 1 + k])
    return np.unique(runs)


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """A fast similarity sketch: one value for each bin, equal in two sketches with the sets' Jaccard similarity.

    In round i < bins every element is hashed into one bin with the value (i, hash); only bins that earlier rounds
    left empty take values, so early rounds always win. Round bins + b hashes all elements into bin b alone, hence
    after twice `bins` rounds every bin is full.
    """
    out = np.full(bins, _EMPTY)
    size = np.uint64(bins)
    for i in range(2 * bins):
        r = mix(elements ^ mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        value = (r >> _S32) | np.uint64(i << 32)
        if i >= bins:
            if out[i - bins] == _EMPTY:
                out[i - bins] = value.min()
        else:
            at = ((r & np.uint64(0xFFFFFFFF)) * size) >> _S32
            if i:
                open_ = out[at] == _EMPTY
                at, value = at[open_], value[open_]
            np.minimum.at(out, at.astype(np.intp), value)
        if (out != _EMPTY).all():
            break
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` bins."""
    at = values.reshape(-1, rows)
    key = mix(np.arange(len(at), dtype=np.uint64) + _GOLD)
    for k in range(rows):
        key = mix(key * _GOLD + at[:, k])
    return key.view(np.int64)

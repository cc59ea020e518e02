"""Word and shingle hashes of whole Arrow text columns, with numpy.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. A word's hash is a polynomial of its UTF-8
bytes modulo 2**64 with a final mix; a shingle's hash combines the hashes of its words in order. All words of a batch are
hashed in a few array passes, so there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SHINGLE = 5
THRESHOLD = 0.8

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[name] = np.multiply.accumulate(have)
    out = _powers[name][:n]
    if n > 4 * CHUNK_BYTES:
        del _powers[name]  # a single huge text: don't hold its tables
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads low and high bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a text column into (first row, end row, bytes, offsets) of about CHUNK_BYTES; nulls are empty.

    One longer text makes a chunk of its own: a text is never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and per text the index of its first word (one more entry than texts)."""
    inside = ~_SEPARATOR[data]
    n = len(data)
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, A-Z lower-cased."""
    with np.errstate(over="ignore"):
        terms = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        h = (total[e] - total[s]) * _power("down", _INVERSE, len(data) + 1)[s]
        return mix(h ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and per text the index of its first word."""
    s, e, first = word_spans(data, offsets)
    return span_hashes(data, s, e), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word shingles in text order, repeats kept, and per text the index of its first one.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    count = np.diff(first)
    own = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(own)))
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        out = np.zeros(begin[-1], np.uint64)
        at = np.repeat(first[:-1] - begin[:-1], own) + np.arange(begin[-1])
        size = np.repeat(np.minimum(count, width), own)
        for k in range(width):
            use = size > k
            if use.all():
                out += words[at + k] * factors[k]
            else:
                out[use] += words[at[use] + k] * factors[k]
        return mix(out + size.astype(np.uint64)), begin


def run_hashes(words: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words that begin at the given places, whatever the width, in one pass."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * _power("up", _BASE, len(words)), out=total[1:])
        return mix((total[begin + width] - total[begin]) * _power("down", _INVERSE, len(words) + 1)[begin])


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text in order."""
    for at, end, data, offsets in chunks(texts):
        grams, begin = shingle_hashes(*word_hashes(data, offsets), width)
        for i in range(end - at):
            yield at + i, np.unique(grams[begin[i] : begin[i + 1]])

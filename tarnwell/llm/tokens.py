"""Words as 64-bit hashes, in numpy, from whole texts.

A word is a longest run of ASCII letters and digits and of characters beyond ASCII, in lower case. Null and
empty texts have no words. The same word has the same hash in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while done < n:
            out[done : 2 * done] = out[: min(done, n - done)] * step
            done, step = 2 * done, step * step
    return out


_POW = _powers(int(_R), _SEGMENT + 1)
_INV = _powers(pow(int(_R), -1, 1 << 64), _SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of at most _SEGMENT bytes."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = _WORD[buf]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _POW[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _INV[starts]), starts, ends


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): text i has hashes[offsets[i]:offsets[i + 1]]."""
    hashes, _, _, offsets = words_at(texts)
    return hashes, offsets


def words_at(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends (in the lower-case UTF-8 of the own text), offsets."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    buf = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    del raw
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(buf):
        end = min(at + _SEGMENT, len(buf))
        if end < len(buf):  # cut behind the last byte that is in no word; a word longer than a segment is cut
            gaps = np.flatnonzero(~_WORD[buf[max(at, end - 4096) : end]])
            if not len(gaps):
                gaps = np.flatnonzero(~_WORD[buf[at:end]])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end
            else:
                end = max(at, end - 4096) + int(gaps[-1]) + 1
        h, s, e = _segment(buf[at:end])
        found.append((h, s + at, e + at))
        at = end
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64)
    h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
    offsets = np.searchsorted(s, begin)
    own = np.repeat(begin[:-1], np.diff(offsets))
    return h, s - own, e - own, offsets


_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, 65)], np.uint64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row, and offsets; a text of 1 to n - 1 words has one shingle of all of them."""
    counts = np.diff(offsets)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    total = len(hashes)
    acc = np.zeros(total, np.uint64)
    left = np.repeat(offsets[1:], counts) - np.arange(total)  # words from here to the end of the text
    for k in range(min(n, total)):
        part = np.zeros(total, np.uint64)
        part[: total - k] = hashes[k:] * _STEP[k]
        acc += np.where(left > k, part, np.uint64(0))
    first = np.zeros(total, bool)
    first[offsets[:-1][counts > 0]] = True
    keep = (left >= n) | (first & (np.repeat(counts, counts) < n))
    acc = mix(acc + np.minimum(left, n).astype(np.uint64))
    return acc[keep], np.concatenate([[0], np.cumsum(np.where(counts >= n, counts - n + 1, np.minimum(counts, 1)))])


def batches(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters; one text is never cut."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n + 1
    if start < len(texts):
        yield start, len(texts)

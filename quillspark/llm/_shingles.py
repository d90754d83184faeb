"""Words and word n-grams of whole batches of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: The first 0 to 8 bytes of a lane.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of the first word of each text, and of the end).

    A-Z are lower-cased; words are the runs between the bytes 9 to 13 and 32. Words are mixed eight bytes at a time, all words
    of a batch together; the few longer than LONG bytes go through xxh64.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    whole = b"\n".join(raw) + b"\n" + bytes(8)
    data = np.frombuffer(whole, np.uint8)[:-8]
    edge = np.diff((~_SPACE[data]).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    lanes = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))  # the eight bytes from each place on
    hashes = mix(size.astype(np.uint64) * _STEPS[0])
    for k in range(LONG // 8):
        at = np.flatnonzero(size > 8 * k)
        if not len(at):
            break
        lane = lanes[starts[at] + 8 * k] & _MASKS[np.minimum(size[at] - 8 * k, 8)]
        hashes[at] = mix(hashes[at] * _STEPS[0] + lane * _STEPS[1] + np.uint64(k))
    for i in np.flatnonzero(size > LONG):
        hashes[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]])
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, firsts


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place; shorter by n - 1."""
    out = words[: len(words) - n + 1] if len(words) >= n else words[:0]
    for k in range(1, n):
        out = mix(out * _STEPS[0] + words[k : len(words) - n + 1 + k] * _STEPS[1] + np.uint64(k))
    return out


def slices(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `most` characters together, or one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; all its words as one where it has fewer; empty without words."""
    for a, b in slices(texts):
        hashes, firsts = word_hashes(texts[a:b])
        grams = gram_hashes(hashes, n)
        for i in range(b - a):
            lo, hi = firsts[i], firsts[i + 1]
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield mix(gram_hashes(hashes[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield hashes[:0]

"""Words of a text as rows of a table that a worker fills as it meets them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

FIRST, LAST = 2, 3  # marks before and after a word; no word has them


def ngram_buckets(words: Sequence[str], sizes: Sequence[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of the marked words.

    All words are hashed at once over one array of code points; a word shorter
    than every size still has the gram of its marks.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    joined = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = (np.cumsum(codes == FIRST) - 1).astype(np.int32)
    owners, found = [], []
    for size in sizes:
        if len(codes) < size:
            continue
        count = len(codes) - size + 1
        value = np.full(count, size, np.uint64)
        for j in range(size):
            value = value * np.uint64(0x100000001B3) + codes[j : j + count]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        whole = owner[:count] == owner[size - 1 :]
        owners.append(owner[:count][whole])
        found.append(((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)[whole])
    return np.concatenate(owners), np.concatenate(found)


class WordRows:
    """Row number of each distinct word; ``compute`` makes the rows of new ones.

    Row 0 is all zero (padding). At ``most`` words the table starts anew, which
    bounds a worker's memory and changes no value.
    """

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, most: int, dtype=np.float32):
        self.compute, self.width, self.most, self.dtype = compute, width, most, dtype
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), self.dtype)

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """Row numbers of all words, one after another; valid until the next call."""
        words = [w for text in texts for w in text]
        fresh = [w for w in set(words) if w not in self.place]
        if fresh and len(self.place) + len(fresh) > self.most:
            self._clear()
            fresh = list(set(words))
        if fresh:
            at = len(self.place) + 1
            while len(self.rows) < at + len(fresh):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for start in range(0, len(fresh), 50_000):
                part = fresh[start : start + 50_000]
                self.rows[at + start : at + start + len(part)] = self.compute(part)
            self.place.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))


def runs(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs whose sizes add up to ``most`` at most, one item at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def in_groups(texts: list[list[str]], words: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with at most ``words`` words together, one text at least."""
    return runs([len(text) for text in texts], words)

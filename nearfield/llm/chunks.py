"""Texts of an Arrow batch cut into chunks, each distinct chunk of a few megabytes looked up once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at a time; bounds what is held beside the batch.
SLICE = 4 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of about ``SLICE`` bytes, nulls as empty texts; a longer text is a run of its own."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + SLICE, side="right")))
        yield texts.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()  # workers outlive tasks


def distinct(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct chunks, the number of each row's chunks among them in order, and the rows' offsets."""
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


def spread(parts: list[bytes], kind: str, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in order (``parts`` holds each distinct chunk's), and the rows' offsets among them."""
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    flat, starts = np.frombuffer(b"".join(parts), kind), np.cumsum(sizes) - sizes
    each = sizes[places]
    ends = np.concatenate([[0], np.cumsum(each)])
    source = np.repeat(starts[places] - ends[:-1], each) + np.arange(ends[-1])
    return flat[source], ends[offsets]


class Memory(dict):
    """What ``make`` returns for a key, remembered for two generations of ``limit`` keys: what is not asked for in a whole
    generation is forgotten, so memory is bounded and common keys stay. Long keys are made anew each time."""

    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = self.copy()
                self.clear()
            self[key] = found
        return found

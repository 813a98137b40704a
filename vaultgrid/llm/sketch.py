"""Word hashes and count-min sketches that are merged over the tasks of a cluster.

A sketch here answers one question: can a key occur in two documents or more?
It is cut into chunks by a hash of the key; a chunk has ``DEPTH`` rows of
``CHUNK`` cells, and all cells of a key are in its chunk. The number of chunks
grows with the number of keys, so the share of keys that pass by chance does not
depend on the corpus's size. Each task sends the cells that its documents touch,
with counts, packed by chunk; a chunk's cells are added up in one task, which
leaves a bit for each cell that reached two. A key is estimated repeated if its
cell is set in every row; estimates are never too low, so no repeated key is
lost.

Up to ``BROADCAST`` bytes the bits are broadcast as one filter; beyond, they stay
where they are, one row a chunk, and keys are sent to them (``looked_up``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 2
CHUNK = 1 << 16
#: Cells of a row for each key, the fewest chunks, and bytes of bits that are broadcast.
ROOM, LEAST_CHUNKS, BROADCAST = 6, 4, 32 << 20
#: Words whose hashes a worker keeps at most.
KEPT_WORDS = 200_000
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: The one table of a worker; tasks empty it when they end.
HASHES = WordHashes()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = 1 << (n - 1).bit_length()
            ones = np.full(self.n, self.base, np.uint64)
            ones[0] = 1
            self.up = np.multiply.accumulate(ones)
            ones = np.full(self.n, self.inverse, np.uint64)
            ones[0] = 1
            self.down = np.multiply.accumulate(ones)

    def windows(self, h: np.ndarray, length: int) -> np.ndarray:
        """A hash of each run of ``length`` word hashes (rolling polynomial, scattered)."""
        n = len(h)
        if n < length:
            return np.zeros(0, np.uint64)
        total = self.totals(h)
        return mixed((total[length:] - total[:-length]) * self.down[: n - length + 1])

    def totals(self, h: np.ndarray) -> np.ndarray:
        self.grow(len(h) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h * self.up[: len(h)])])

    def spans(self, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of word hashes from ``begin`` up to ``end``; of runs of one length, the same as by ``windows``."""
        total = self.totals(h)
        return mixed((total[end] - total[begin]) * self.down[begin])


def running_min(x: np.ndarray, length: int) -> np.ndarray:
    """Minimum of each run of ``length`` values."""
    have = 1
    while have * 2 <= length:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = length - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunks_for(keys: float) -> int:
    return max(LEAST_CHUNKS, int(np.ceil(ROOM * keys / CHUNK)))


def places(keys: np.ndarray, chunks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each key's chunk, and its place in the chunk in each row."""
    chunk = (mixed(keys, 17) % np.uint64(chunks)).astype(np.int64)
    return chunk, [((mixed(keys, 11 + row) & np.uint64(CHUNK - 1)) + np.uint64(row * CHUNK)).astype(np.int64) for row in range(DEPTH)]


class Touched:
    """What a task's documents add to the sketch."""

    def __init__(self, chunks: int):
        self.chunks, self.parts, self.held = chunks, [], 0

    def add(self, keys: np.ndarray) -> None:
        """The distinct keys of one document."""
        chunk, at = places(keys, self.chunks)
        self.parts += [chunk * (DEPTH * CHUNK) + x for x in at]
        self.held += DEPTH * len(keys)

    def batch(self) -> pa.RecordBatch:
        at = np.sort(np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64))
        self.parts, self.held = [], 0
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        n = np.minimum(np.diff(np.append(first, len(at))), 2).astype(np.uint8)
        at = at[first]
        ids, first = np.unique(at // (DEPTH * CHUNK), return_index=True)
        ends = np.append(first, len(at))
        place = (at % (DEPTH * CHUNK)).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([place[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
            ["chunk", "places", "counts"],
        )


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DEPTH * CHUNK, np.uint8)
    for batch in batches:
        for at, counts in zip(batch["places"], batch["counts"]):
            at = np.frombuffer(at.as_py(), np.uint32)
            total[at] = np.minimum(total[at] + np.frombuffer(counts.as_py(), np.uint8), 2)
    words = np.packbits(total >= 2, bitorder="little").view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([words], pa.list_(pa.int64()))], ["chunk", "bits"])


def repeated_bits(touched: DataFrame) -> DataFrame:
    """(chunk, bits): 64 cells a number, a bit for each that two documents or more touch; a chunk that nothing touched has no row."""
    return touched.groupBy("chunk").applyInArrow(_merged, "chunk long, bits array<long>")


def gathered(bits: DataFrame, chunks: int) -> np.ndarray:
    """The whole filter, for a number of chunks whose bits are within BROADCAST bytes."""
    got = bits.toArrow()
    out = np.zeros((chunks, DEPTH * CHUNK // 64), np.int64)
    for chunk, words in zip(got["chunk"].to_pylist(), got["bits"].combine_chunks() if got.num_rows else ()):
        out[chunk] = words.values.to_numpy()
    return out.view(np.uint8).ravel()


def maybe_repeated(keys: np.ndarray, filter_: np.ndarray, chunks: int) -> np.ndarray:
    chunk, at = places(keys, chunks)
    out = np.ones(len(keys), bool)
    for x in at:
        cell = chunk * (DEPTH * CHUNK) + x
        out &= (filter_[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def looked_up(keys: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of ``keys`` (with chunk and the places at0, at1, ...) that are estimated repeated."""
    bit = lambda at: F.getbit(F.element_at("bits", (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
    met = keys.join(bits, "chunk")
    ok: Column = F.lit(True)
    for row in range(DEPTH):
        ok = ok & bit(F.col(f"at{row}"))
    return met.where(ok).drop("bits", "chunk", *[f"at{row}" for row in range(DEPTH)])

"""Unbranched pieces of a word graph, made within tasks: words are dealt by their joints, so that a task sees all words of its joints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.codes import codes, dealt, turned_codes
from strandloom.sources.tables import partitions

#: Sides of a word that a row stands for, and rows of a batch that is given out.
LEFT, RIGHT, ROWS = 1, 2, 1 << 14

_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _joints(code: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k - 1 bases at the left end, their reverse complement, and the same of the right end, which is read turned."""
    left, right = code >> np.uint64(2), code & np.uint64((1 << 2 * (k - 1)) - 1)
    return left, turned_codes(left, k - 1), turned_codes(right, k - 1), right


def _by_joint(counts: DataFrame, k: int) -> DataFrame:
    """A row for each word and part of its two joints, one where these have the same: `part`, `code`, `more` (4 `n` and the sides)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = (batch.column(c).to_numpy() for c in range(2))
            a, at, b, bt = _joints(code.astype(np.uint64), k)
            left, right = dealt(a, at, k - 1), dealt(b, bt, k - 1)
            two = left != right
            more = np.concatenate([4 * n + np.where(two, LEFT, LEFT + RIGHT), 4 * n[two] + RIGHT])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([left, right[two]])), pa.array(np.concatenate([code, code[two]])), pa.array(more)], ["part", "code", "more"])

    return counts.select("code", "n").mapInArrow(run, "part int, code long, more long")


def _walked(prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each state the one that its walk back ends at and the steps to it, by doubling; states of rings never come to an end."""
    root, dist = np.where(prev < 0, np.arange(len(prev)), prev), (prev >= 0).astype(np.int64)
    open_ = np.flatnonzero(prev[root] >= 0)
    while len(open_):
        dist[open_], root[open_] = dist[open_] + dist[root[open_]], root[root[open_]]
        left = open_[prev[root[open_]] >= 0]
        if len(left) == len(open_):
            break
        open_ = left
    return root, dist


def _opened(prev: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_walked`, with every ring opened at its lowest word, on both strands."""
    root, dist = _walked(prev)
    ring = np.flatnonzero(prev[root] >= 0)
    if len(ring):
        low, far = np.tile(code, 2), prev.copy()
        for _ in range(int(len(ring)).bit_length() + 1):
            low[ring], far[ring] = np.minimum(low[ring], low[far[ring]]), far[far[ring]]
        prev = prev.copy()
        prev[ring[low[ring] == np.tile(code, 2)[ring]]] = -1
        root, dist = _walked(prev)
    return root, dist


def _chained(code: np.ndarray, n: np.ndarray, sides: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The words of a task in the order of its pieces, as they are read there, `n`, and where pieces begin.

    A state is a word that is entered from the left (its number) or from the right (its number plus all words).
    """
    size = len(code)
    a, at, b, bt = _joints(code, k)
    head, turned = np.concatenate([a, b]), np.concatenate([at, bt])
    use = np.flatnonzero(np.concatenate([sides & LEFT > 0, sides & RIGHT > 0]) & (head != turned))
    joint, same = np.minimum(head, turned)[use], (head < turned)[use]
    order = np.argsort(joint, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(joint[order]) != 0])) if len(use) else np.zeros(0, np.int64)
    pair = first[np.diff(np.append(first, len(use))) == 2]
    pair = pair[same[order[pair]] != same[order[pair + 1]]]
    x, y = use[order[pair]], use[order[pair + 1]]
    keep = x % size != y % size
    x, y = x[keep], y[keep]
    prev = np.full(2 * size, -1, np.int64)
    prev[x], prev[y] = (y + size) % (2 * size), (x + size) % (2 * size)
    root, dist = _opened(prev, code)
    # Each word is read on one strand: that of its piece whose beginning has the lower number; its other copy is left out.
    state = np.where(root[:size] < root[size:], np.arange(size), np.arange(size) + size)[sides & LEFT > 0]
    state = state[np.lexsort((dist[state], root[state]))]
    word = np.where(state < size, code[state % size], turned_codes(code[state % size], k))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(root[state]) != 0])) if len(state) else np.zeros(0, np.int64)
    return word, n[state % size], begin


def _spelled(word: np.ndarray, begin: np.ndarray, k: int) -> pa.Array:
    """The text of pieces whose words follow each other."""
    length = np.diff(np.append(begin, len(word))) + k - 1
    end = np.cumsum(length)
    piece = np.repeat(np.arange(len(begin)), length - k + 1)
    out = np.empty(int(end[-1]), np.uint8)
    out[np.arange(len(word)) + (piece + 1) * (k - 1)] = _LETTERS[(word & np.uint64(3)).astype(np.int64)]
    for i in range(k - 1):
        out[end - length + i] = _LETTERS[(word[begin] >> np.uint64(2 * (k - 1 - i)) & np.uint64(3)).astype(np.int64)]
    return pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(out))


def pieces(counts: DataFrame, k: int = 21) -> DataFrame:
    """Pieces of the unbranched stretches of a word graph: `unitig` (code of the lowest word), `bases`, `n_words`, `total` (sum of `n`).

    Words go to the part (`dealt`) of either joint, mostly one. A task joins words at joints that have one word on either side; of
    a word in two parts the right one only takes its neighbour, so that pieces share no word and meet where one would go on.
    """
    names = ["unitig", "bases", "n_words", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        code, more = (np.concatenate([h[c] for h in held]) for c in range(2))
        del held
        word, n, begin = _chained(code.astype(np.uint64), more >> 2, more & 3, k)
        low = np.minimum(word, turned_codes(word, k))
        for i in range(0, len(begin), ROWS):
            own = begin[i : i + ROWS]
            a, b = own[0], begin[i + ROWS] if i + ROWS < len(begin) else len(word)
            at = own - a
            values = [pa.array(np.minimum.reduceat(low[a:b], at).astype(np.int64)), _spelled(word[a:b], at, k), pa.array(np.diff(np.append(at, b - a)).astype(np.int64)), pa.array(np.add.reduceat(n[a:b], at).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(values, names)

    dealt_ = _by_joint(counts, k).repartition(partitions(counts.sparkSession), "part").select("code", "more")
    return dealt_.mapInArrow(run, "unitig long, bases string, n_words long, total long")


def joint_ends(units: DataFrame, k: int = 21) -> DataFrame:
    """The joints of k - 1 bases at both ends of every unitig, where they hold no N: `unitig`, `side` (L, R), `joint` (canonical), `same`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = codes("".join(s for c in (1, 2) for s in batch.column(c).to_pylist())).reshape(-1, k - 1)
            x = np.zeros(len(v), np.uint64)
            for i in range(k - 1):
                x = x << np.uint64(2) | v[:, i] & np.uint64(3)
            back, right = turned_codes(x, k - 1), np.arange(len(v)) >= batch.num_rows
            x, back = np.where(right, back, x), np.where(right, x, back)
            keep = np.flatnonzero((v < 4).all(1))
            own = pa.concat_arrays([batch.column(0), batch.column(0)])
            values = [own, pa.array(np.where(right, "R", "L")), pa.array(np.minimum(x, back).astype(np.int64)), pa.array(x <= back)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in values], ["unitig", "side", "joint", "same"])

    ends = units.where(F.length("bases") >= k - 1).select("unitig", F.left("bases", F.lit(k - 1)), F.right("bases", F.lit(k - 1)))
    return ends.mapInArrow(run, "unitig long, side string, joint long, same boolean")

"""Hashes of any stretch of a sequence's text, on either strand, from sums over it: polynomials in 64 bits, made with numpy over Arrow batches.

Equal texts have equal hashes; what has equal hashes must still be compared where the text decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.functions.codes import mixed
from strandloom.sources.tables import partitions

#: Bases that are hashed at once, and the bits that a filter has at most.
BLOCK, MOST_BITS = 1 << 18, 27
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_TURN = np.arange(256, dtype=np.uint8)
_TURN[list(b"ACGT")] = list(b"TGCA")
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
_CHUNK = 16


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), np.uint8)


def _sums(text: str, at: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Sums of either strand up to each place of a text that stands at `at`, and the powers of that place."""
    v, high, low = _letters(text), np.uint64(pow(_BASE, at, 1 << 64)), np.uint64(pow(_BACK, at, 1 << 64))
    zero = np.zeros(1, np.uint64)
    p = np.concatenate([zero, np.cumsum(_VALUE[v] * up[: len(v)])]) * high
    q = np.concatenate([zero, np.cumsum(_VALUE[_TURN[v]] * down[: len(v)])]) * low
    return p, q, high, low


def _together(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of at least k bases, about BLOCK bases at once; one of more than BLOCK bases alone."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for cid, text in zip(batch.column(0), batch.column(1)):
            cid, text = cid.as_py(), text.as_py() or ""
            if len(text) < k:
                continue
            if texts and held + len(text) > BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(cid)
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, texts


def end_hashes(seqs: DataFrame, k: int) -> DataFrame:
    """`hash` of the last k, 2 k, 4 k, ... bases of each sequence, up to BLOCK of them, and of the first ones' reverse complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(_BASE, 2 * BLOCK), _powers(_BACK, 2 * BLOCK)
        with np.errstate(over="ignore"):
            for _, texts in _together(batches, k):
                texts = texts if len(texts[0]) <= BLOCK else [texts[0][:BLOCK], texts[0][-BLOCK:]]  # more hashes than needed do no harm
                p, q, _, _ = _sums("".join(texts), 0, up, down)
                size = np.array([len(t) for t in texts])
                end = np.cumsum(size)
                begin, out, width = end - size, [], k
                while (pick := size >= width).any():
                    a, b = begin[pick], end[pick]
                    out += [(p[b] - p[b - width]) * down[b - width], (q[a + width] - q[a]) * up[a + width - 1]]
                    width *= 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["hash"])

    return seqs.select("contig_id", "bases").mapInArrow(run, "hash long")


def filter_of(hashes: DataFrame, n: int) -> np.ndarray:
    """A table of bits (at least 64 for each of the `n` hashes, as far as MOST_BITS go), set where a hash falls: 16 MB at most."""
    bits = min(MOST_BITS, max(_CHUNK, int(64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.sort(batch.column(1).to_numpy())
            chunk = slot >> _CHUNK
            at = np.flatnonzero(np.diff(chunk, prepend=-1))
            for a, b in zip(at, [*at[1:], len(slot)]):
                chunks.setdefault(int(chunk[a]), np.zeros(1 << _CHUNK, bool))[slot[a:b] & ((1 << _CHUNK) - 1)] = True
        for c, x in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique((mixed(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> _CHUNK).astype(np.int32)), pa.array(slot)], ["chunk", "slot"])

    rows = hashes.mapInArrow(slots, "chunk int, slot long").repartition(partitions(hashes.sparkSession), "chunk").mapInArrow(run, "chunk int, bits binary")
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for c, x in rows.collect():
        out[c << _CHUNK - 3 : (c + 1) << _CHUNK - 3] = np.frombuffer(x, np.uint8)
    return out


def held(rows: DataFrame, column: str, table: np.ndarray) -> DataFrame:
    """The rows whose long `column` falls where the filter `table` of `filter_of` has a bit: all of those it was made of, and few others."""
    shared, types = rows.sparkSession.sparkContext.broadcast(table), rows.schema  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = shared.value, np.uint64(64 - (len(shared.value) * 8).bit_length() + 1)
        for batch in batches:
            s = mixed(batch.column(column).to_numpy().view(np.uint64)) >> shift
            yield batch.filter(pa.array(((bits[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)))

    return rows.mapInArrow(run, types)


def end_stretches(seqs: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """Stretches from an end of a sequence (`contig_id`, `bases`) that may be an overlap by their inner bases: `contig_id`, `side`,
    `tail`, `n`, `hash`.

    From the beginning on where the last k bases of the stretch are in the filter `table` of `end_hashes`, and so the last 2 k, 4 k, ...
    that it has; up to the end where the reverse complement of its first ones is. Either is given as a head (not `tail`) of one strand
    (`side` 1 or -1), and as a tail of the other, if the k bases at that end of the sequence hold no N.
    """
    shared = seqs.sparkSession.sparkContext.broadcast(table)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = shared.value, np.uint64(64 - (len(shared.value) * 8).bit_length() + 1)
        up, down = _powers(_BASE, BLOCK + k), _powers(_BACK, BLOCK + k)
        known = lambda h: (bits[(s := mixed(h) >> shift) >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1

        def places(p: np.ndarray, q: np.ndarray, high: np.uint64, low: np.uint64) -> tuple[np.ndarray, np.ndarray]:
            """Where k bases may end a stretch of either kind."""
            m = max(len(p) - k, 0)
            turned = (q[k:] - q[:m]) * up[:m] * high * np.uint64(pow(_BASE, k - 1, 1 << 64))
            return np.flatnonzero(known((p[k:] - p[:m]) * down[:m] * low)), np.flatnonzero(known(turned))

        def further(side: int, x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray, high: np.uint64, low: np.uint64) -> np.ndarray:
            """Which of the stretches of `n` bases that end (side 1) or begin (-1) at `x` have the wider inner parts in the filter too.
            A part that is not in this text is not tested."""
            left, width = np.arange(len(x)), 2 * k
            while width <= BLOCK:
                y = x[left]
                here = np.flatnonzero((n[left] >= width) & (y >= width if side > 0 else y + width < len(p)))
                if not len(here):
                    break
                y = y[here]
                h = (p[y] - p[y - width]) * down[y - width] * low if side > 0 else (q[y + width] - q[y]) * up[y + width - 1] * high
                left = np.delete(left, here[known(h) == 0])
                width *= 2
            return left

        def rows(ids: np.ndarray, side: int, n: np.ndarray, ahead: np.ndarray, turned: np.ndarray, clean: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Heads of the strand `side`, and tails of the other."""
            h, t = (ahead, turned) if side > 0 else (turned, ahead)
            for s, tail, x, pick in ((side, False, h, slice(None)), (-side, True, t, clean)):
                if len(i := ids[pick]):
                    columns = (i, np.full(len(i), s, np.int32), np.full(len(i), tail), n[pick].astype(np.int32), x[pick].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["contig_id", "side", "tail", "n", "hash"])

        def short(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
            p, q, high, low = _sums("".join(texts), 0, up, down)
            size = np.array([len(t) for t in texts])
            end = np.cumsum(size)
            begin, own = end - size, np.array(ids, np.int64)
            for side, at in zip((1, -1), places(p, q, high, low)):
                of = np.searchsorted(end, at, "right")
                at, of = (x[at + k <= end[of]] for x in (at, of))
                a, b = (begin[of], at + k) if side > 0 else (at, end[of])
                good = further(side, b if side > 0 else a, b - a, p, q, high, low)
                a, b, of = a[good], b[good], of[good]
                clean = np.array(["N" not in (t[:k] if side > 0 else t[-k:]) for t in texts])[of]
                yield from rows(own[of], side, b - a, (p[b] - p[a]) * down[a], (q[b] - q[a]) * up[b - 1], clean)

        def long(cid: int, text: str) -> Iterator[pa.RecordBatch]:
            p0 = q0 = np.uint64(0)
            later = []
            for at in range(0, len(text) - k + 1, BLOCK):
                p, q, high, low = _sums(text[at : at + BLOCK + k - 1], at, up, down)
                first, second = places(p, q, high, low)
                b = first + k
                b = b[further(1, b, at + b, p, q, high, low)]
                second = second[further(-1, second, len(text) - at - second, p, q, high, low)]
                yield from rows(np.full(len(b), cid), 1, at + b, p[b] + p0, (q[b] + q0) * up[b - 1] * high, np.full(len(b), "N" not in text[:k]))
                later.append((at + second, p[second] + p0, q[second] + q0, down[second] * low))
                last = min(BLOCK, len(p) - 1) if at + BLOCK <= len(text) - k else len(p) - 1
                p0, q0 = p[last] + p0, q[last] + q0
            a, p, q, low = (np.concatenate(x) for x in zip(*later))
            yield from rows(np.full(len(a), cid), -1, len(text) - a, (p0 - p) * low, (q0 - q) * np.uint64(pow(_BASE, len(text) - 1, 1 << 64)), np.full(len(a), "N" not in text[-k:]))

        with np.errstate(over="ignore"):
            for ids, texts in _together(batches, k):
                yield from short(ids, texts) if len(texts[0]) <= BLOCK else long(ids[0], texts[0])

    return seqs.select("contig_id", "bases").mapInArrow(run, "contig_id long, side int, tail boolean, n int, hash long")

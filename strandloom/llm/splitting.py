"""Problem 1: splitting oversized sequences at natural boundaries, by recursive bisection.

A stretch that exceeds the limit minus the overlap is cut at the strongest boundary near its midpoint (the longest gap of its
middle half, then the one nearest the midpoint; the midpoint itself where there is none), and so are its halves, until all fit.
Two rules then place the pieces:

* `free`: the cuts of the bisection are the ends of the pieces, and the overlap is put in front of every piece but the first;
* `fixed`: the ends are those that TESTDATA.md fixes, the last gap middle that keeps a piece under the limit. They depend on
  where the piece before ended. So each stretch of the bisection, in order, gives the ends that lie in it for the start that
  reaches it and hands the start of the piece left open on to the next stretch.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, MIN_GAP = 4000, 150, 10


def gaps(seq: str, min_gap: int) -> list[tuple[int, int]]:
    """Maximal runs of at least `min_gap` N of a sequence in upper case, as [start, end)."""
    return [m.span() for m in re.finditer("N{%d,}" % min_gap, seq)]


def stretches(n: int, runs: list[tuple[int, int]], mids: list[int], limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """The stretches [lo, hi) of the recursive bisection, in order; a sequence within the limit is one. `runs` are the gaps."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if (lo, hi) == (0, n) else limit - overlap):
            yield lo, hi
            continue
        mid, quarter = (lo + hi) // 2, (hi - lo) // 4
        near = range(bisect_right(mids, mid - quarter - 1), bisect_right(mids, mid + quarter))
        best = min(near, key=lambda k: (runs[k][0] - runs[k][1], abs(mids[k] - mid), k), default=None)
        at = mid if best is None else mids[best]
        todo += [(at, hi), (lo, at)]


def pieces_of(n: int, runs: list[tuple[int, int]], rule: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces [start, end) in order; lengths include the overlap and stay within `limit`."""
    mids = [a + (b - a) // 2 for a, b in runs]
    if rule == "free":
        return [(max(0, lo - overlap), hi) for lo, hi in stretches(n, runs, mids, limit, overlap)]
    out, start = [], 0
    for _, hi in stretches(n, runs, mids, limit, overlap):
        while n - start > limit:
            k = bisect_right(mids, start + limit) - 1
            end = mids[k] if k >= 0 and mids[k] > start + overlap else start + limit
            if end > hi:
                break
            out.append((start, end))
            start = end - overlap
    return [*out, (start, n)]


def split(scaffolds: DataFrame, rule: str = "fixed", limit: int = LIMIT, overlap: int = OVERLAP, min_gap: int = MIN_GAP, text: bool = False) -> DataFrame:
    """The pieces of every sequence of more than `limit` bases, once per `scaffold_id`.

    Columns: `scaffold_id`, `piece_no` from 1, `name` of the fragment (first word of the scaffold's name without a leading '>',
    then ':::fragment_' and the number), `piece_start`, `piece_end` in the bases without white space and, with `text`, the bases
    `seq` in upper case. Null, empty and short sequences give no row; a null name counts as empty; redelivered rows give their
    pieces once (of rows that differ, the longest sequence counts, then the highest name). Other columns of the input are not
    read. One shuffle, of one row per sequence: its coordinates, and its text only if `text` asks for it.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    schema = "scaffold_id long, total long, word string, starts array<long>, ends array<long>" + ", texts array<string>" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + text)]
            for sid, name, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seq = "".join(raw.split()).upper() if raw else ""
                if len(seq) <= limit:
                    continue
                got = pieces_of(len(seq), gaps(seq, min_gap), rule, limit, overlap)
                word = ((name or "").strip().removeprefix(">").split() or [""])[0]
                starts, ends = map(list, zip(*got))
                for col, x in zip(cols, (sid, len(seq), word, starts, ends, *([[seq[a:b] for a, b in got]] * text))):
                    col.append(x)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.string(), longs, longs, *([pa.list_(pa.string())] * text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["scaffold_id", "total", "word", "starts", "ends", *(["texts"] * text)])

    rows = scaffolds.where("length(seq) > %d" % limit).select("scaffold_id", "name", "seq").mapInArrow(run, schema)
    order = F.struct("total", "word", "starts", "ends", *(["texts"] * text))
    best = rows.groupBy("scaffold_id").agg(F.max(order).alias("r"))
    at = best.select("scaffold_id", "r", F.posexplode("r.starts").alias("k", "piece_start"))
    pick = lambda c: F.get(f"r.{c}", F.col("k"))
    return at.select(
        "scaffold_id", (F.col("k") + 1).alias("piece_no"), F.concat("r.word", F.lit(":::fragment_"), (F.col("k") + 1).cast("string")).alias("name"),
        "piece_start", pick("ends").alias("piece_end"), *([pick("texts").alias("seq")] * text),
    )

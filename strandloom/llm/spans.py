"""Problem 3: long exact spans shared between records.

Words of WORD bases are hashed only at positions whose remainder modulo PERIOD lies in a difference cover: for any two
positions i, j there is a shift below PERIOD that takes both into the cover. As WORD + PERIOD <= SPAN + 1, two equal stretches
of SPAN bases always share an aligned anchor. The anchors are shuffled once, by their code; those found in one contig only end
there. The surroundings of the others meet by code and are extended: in pairs where few have the code, by sorting the
surroundings once for every way the SPAN bases can lie around the anchor where many have it. A code that would fill more than
a task's share of the anchors (told while the anchors are made, or by MANY places) is not gathered: its anchors are widened to
the whole SPAN, in every way they can lie, and the widened words are aggregated. All ways compare bases, none a digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.bases import clean, codes, mixed, pack, unpack, words
from strandloom.plans.shared import cut

SPAN = 100
#: A perfect difference cover, whose differences are all of 0..72.
PERIOD = 73
COVER = (1, 2, 4, 8, 16, 32, 37, 55, 64)
WORD = SPAN - PERIOD + 1
#: Bases beside an anchor that a stretch around it can reach.
AROUND = SPAN - WORD
#: Places of a code that are extended in pairs, and places that are handled in one task at all.
FEW, MANY = 64, 1 << 18
#: Anchors that are looked at together when they are made.
FLUSH = 1 << 20
#: Places of a code among them that are never too many for a task.
LEAST = 1024
#: The anchors in one chunk of a contig are handled together; long contigs spread over tasks.
CHUNK = 16_384


def anchors(contigs: DataFrame, tasks: int) -> DataFrame:
    """`code`, `contig_id`, `pos`, `kind` of the words at cover positions, without those that hold N.

    Of FLUSH anchors of a task, a code with more than a share of FLUSH / `tasks` (LEAST at least) that more than one contig has needs
    no shuffle to be known as shared: its places have kind 2, but for one of its lowest and its highest contig, which go to the others
    (kind 1). All else has kind 0.
    """
    most = max(LEAST, FLUSH // tasks)

    def flush(w: list[np.ndarray], ids: list[int], at: list[np.ndarray]) -> pa.RecordBatch:
        code, cid, pos = np.concatenate(w), np.repeat(np.array(ids, np.int64), [len(x) for x in at]), np.concatenate(at)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=~code[order[0]]))
        kind = np.zeros(len(code), np.int8)
        for a, b in zip(first, [*first[1:], len(code)]):
            if b - a > most:
                own = order[a:b]
                lo, hi = own[np.argmin(cid[own])], own[np.argmax(cid[own])]
                if cid[lo] != cid[hi]:
                    kind[own] = 2
                    kind[[lo, hi]] = 1
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(cid), pa.array(pos.astype(np.int64)), pa.array(kind)], ["code", "contig_id", "pos", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cover = np.array(COVER)
        w, ids, places, held = [], [], [], 0
        for batch in batches:
            for cid, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = codes(seq.as_py())
                if cid is None or len(v) < SPAN:
                    continue
                at = (np.arange(0, len(v), PERIOD)[:, None] + cover).ravel()
                at = at[at <= len(v) - WORD]
                at = at[clean(v, WORD)[at]]
                all_ = words(v, WORD)
                for k in range(0, len(at), FLUSH):
                    part = at[k : k + FLUSH]
                    w.append(all_[part])
                    ids.append(cid)
                    places.append(part)
                    held += len(part)
                    if held >= FLUSH:
                        yield flush(w, ids, places)
                        w, ids, places, held = [], [], [], 0
        if held:
            yield flush(w, ids, places)

    return contigs.select("contig_id", "seq").mapInArrow(run, "code long, contig_id long, pos long, kind byte")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors that more than one contig has: `contig_id`, `chunk`, `pos`, `hot`, from rows sorted by code."""

    def marks(code: np.ndarray, cid: np.ndarray, pos: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(code, prepend=~code[0]))
        n = np.diff(np.append(first, len(code)))
        several = np.minimum.reduceat(cid, first) < np.maximum.reduceat(cid, first)
        hot = (np.maximum.reduceat(kind, first) > 0) | (n > MANY)
        keep = np.repeat(several, n)
        keep |= kind > 0  # settled where they were made
        return pa.RecordBatch.from_arrays([pa.array(cid[keep]), pa.array(pos[keep] // CHUNK), pa.array(pos[keep]), pa.array(np.repeat(hot, n)[keep])], ["contig_id", "chunk", "pos", "hot"])

    open_: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(open_, cols)] if open_ else cols
        if not len(cols[0]):
            continue
        done = int(np.searchsorted(cols[0], cols[0][-1]))
        if done:
            yield marks(*(c[:done] for c in cols))
        open_ = [c[done:] for c in cols]
    if open_:
        yield marks(*open_)


def _gathered(parts: Iterator[tuple], names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Tuples of columns (arrays of numpy) as batches of at least `rows` rows, but for the last."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def chunks(contigs: DataFrame) -> DataFrame:
    """The contigs' packed bases in chunks (`contig_id`, `chunk`, `bases`) with the surroundings of their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["contig_id", "chunk", "bases"])
        rows = []
        for batch in batches:
            for cid, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = codes(seq.as_py())
                if cid is None or len(v) < SPAN:
                    continue
                for k in range(0, len(v), CHUNK):
                    rows.append((cid, k // CHUNK, pack(v[max(0, k - AROUND) : k + CHUNK + SPAN])))
                    if len(rows) == 1024:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return contigs.select("contig_id", "seq").mapInArrow(run, "contig_id long, chunk long, bases binary")


def _local(chunk: int, at: list[int]) -> tuple[int, np.ndarray]:
    """The position of a chunk's text in its contig, and the anchors' places in the text."""
    first = max(0, chunk * CHUNK - AROUND)
    return first, np.sort(np.array(at, np.int64)) - first


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _gathered(_stretch_columns(batches), [*_WIDE, "contig_id", "pos"])


def _stretch_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """All stretches of SPAN bases around anchors: `w0`..`w3` (25 bases each), `contig_id`, `pos`, from (contig_id, chunk, bases, anchors)."""
    for batch in batches:
        for cid, chunk, bases, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
            v = unpack(bases)
            n = len(v) - SPAN + 1
            if n <= 0:
                continue
            first, local = _local(chunk, at)
            wanted = np.zeros(n + 1, np.int64)
            np.add.at(wanted, np.clip(local - AROUND, 0, n), 1)
            np.add.at(wanted, np.clip(local + 1, 0, n), -1)
            start = np.flatnonzero((np.cumsum(wanted)[:n] > 0) & clean(v, SPAN))
            quarter = words(v, 25)
            yield (*(quarter[start + k].astype(np.int64) for k in (0, 25, 50, 75)), np.full(len(start), cid, np.int64), start + first)


_WIDE = ["w0", "w1", "w2", "w3"]
_SIDES = [f"{s}{k}" for s in "lr" for k in range(3)]
_CONTEXT = "code long, contig_id long, pos long, l0 long, l1 long, l2 long, r0 long, r1 long, r2 long, la int, ra int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _gathered(_context_columns(batches), ["code", "contig_id", "pos", *_SIDES, "la", "ra"])


def _context_columns(batches: Iterator[pa.RecordBatch], bases_at_once: int = 1 << 18) -> Iterator[tuple]:
    """Anchors with the AROUND bases on either side: three codes each, nearest base first, and how many are clean.

    Chunks are coded together, with undetermined bases between them.
    """
    third = AROUND // 3
    pad = np.full(AROUND, 4, np.uint64)

    def columns(pieces: list[np.ndarray], places: list[np.ndarray], ids: list[int], firsts: list[int]) -> tuple:
        v, p = np.concatenate(pieces), np.concatenate(places)
        count = [len(x) for x in places]
        cid, first = np.repeat(np.array(ids, np.int64), count), np.repeat(np.array(firsts, np.int64), count)
        ok = clean(v, WORD)[p]  # a contig may have been delivered with other bases too
        p, cid, first, n = p[ok], cid[ok], first[ok], len(v)
        bad, place = v == 4, np.arange(n)
        before = np.maximum.accumulate(np.where(bad, place, -1))
        after = np.minimum.accumulate(np.where(bad, place, n)[::-1])[::-1]
        back, ahead = words(v[::-1], third), words(v, third)
        cols = [words(v, WORD)[p].astype(np.int64), cid, p + first]
        cols += [back[n - p + third * k].astype(np.int64) for k in range(3)]
        cols += [ahead[p + WORD + third * k].astype(np.int64) for k in range(3)]
        cols += [np.minimum(p - 1 - before[p - 1], AROUND).astype(np.int32), np.minimum(after[p + WORD] - p - WORD, AROUND).astype(np.int32)]
        return tuple(cols)

    pieces, places, ids, firsts, held = [pad], [], [], [], AROUND
    for batch in batches:
        for cid, chunk, bases, at in zip(*(batch.column(k).to_pylist() for k in range(4))):
            first, p = _local(chunk, at)
            v = unpack(bases)
            places.append(p[(p >= 0) & (p + WORD <= len(v))] + held)
            pieces += [v, pad]
            ids.append(cid)
            firsts.append(first - held)
            held += len(v) + AROUND
            if held >= bases_at_once:
                yield columns(pieces, places, ids, firsts)
                pieces, places, ids, firsts, held = [pad], [], [], [], AROUND
    if ids:
        yield columns(pieces, places, ids, firsts)


def _common(x: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bases from the nearest on agree, by the three codes of one side."""
    third = AROUND // 3
    out, on = np.zeros(len(i), np.int64), np.ones(len(i), bool)
    for c in x:
        same = (2 * third - np.frexp((c[i] ^ c[j]).astype(float))[1]) // 2  # codes have less than 53 bits
        out += np.where(on, same, 0)
        on &= same == third
    return out


def _by_sorting(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far (to the left, to the right from the anchor on) each row of one code lies in stretches that another contig shares.

    For every number of bases to the left, rows are sorted by those bases and the rest of SPAN to the right; rows that agree are
    neighbours, and are shared if their contigs differ. Equal bases are compared, a hash only orders.
    """
    third, n = AROUND // 3, len(c["pos"])
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in range(AROUND + 1):
        b = AROUND - a
        own = np.flatnonzero((c["la"] >= a) & (c["ra"] >= b))
        if len(own) < 2:
            continue
        cut_, h = [], np.zeros(len(own), np.uint64)
        for names, size in ((_SIDES[:3], a), (_SIDES[3:], b)):
            for k, name in enumerate(names):
                have = min(max(size - k * third, 0), third)
                x = c[name][own].astype(np.uint64) >> np.uint64(2 * (third - have)) if have else np.zeros(len(own), np.uint64)
                cut_.append(x)
                h = mixed(h * np.uint64(3) + x)
        order = np.lexsort((c["contig_id"][own], h))
        cid = c["contig_id"][own][order]
        new = np.ones(len(own), bool)
        new[1:] = False
        for x in cut_:
            y = x[order]
            new[1:] |= y[1:] != y[:-1]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(cid, first) < np.maximum.reduceat(cid, first)
        hit = own[order[np.repeat(several, np.diff(np.append(first, len(own))))]]
        lo[hit] = np.maximum(lo[hit], a)
        hi[hit] = np.maximum(hi[hit], b + WORD)
    return lo, hi


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared intervals of the anchors of each code (rows sorted by code, at most MANY of one): pairs for FEW, else by sorting."""

    def in_pairs(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left, right = [c[k] for k in _SIDES[:3]], [c[k] for k in _SIDES[3:]]
        n = len(c["pos"])
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(1, n):
            i = np.flatnonzero(c["code"][d:] == c["code"][:-d])
            if not len(i):
                break
            i = i[c["contig_id"][i] != c["contig_id"][i + d]]
            j = i + d
            a = np.minimum(_common(left, i, j), np.minimum(c["la"][i], c["la"][j]))
            b = np.minimum(_common(right, i, j), np.minimum(c["ra"][i], c["ra"][j]))
            ok = a + b + WORD >= SPAN
            for t in (i[ok], j[ok]):
                np.maximum.at(lo, t, a[ok])
                np.maximum.at(hi, t, b[ok] + WORD)
        return lo, hi

    def intervals(rows: pa.Table) -> pa.RecordBatch:
        c = {k: rows.column(k).to_numpy() for k in rows.column_names}
        first = np.flatnonzero(np.diff(c["code"], prepend=~c["code"][0]))
        n = np.diff(np.append(first, len(c["code"])))
        few = np.repeat(n <= FEW, n)
        out = []
        groups = [({k: x[few] for k, x in c.items()}, in_pairs)] if few.any() else []
        groups += [({k: x[a : a + m] for k, x in c.items()}, _by_sorting) for a, m in zip(first[n > FEW], n[n > FEW])]
        for g, way in groups:
            lo, hi = way(g)
            t = np.flatnonzero(hi)
            out.append((g["contig_id"][t], g["pos"][t] - lo[t], g["pos"][t] + hi[t]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["contig_id", "pos", "end"])

    open_: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([open_, rows]).combine_chunks() if open_ is not None else rows
        if not rows.num_rows:
            continue
        code = rows.column("code").to_numpy()
        done = int(np.searchsorted(code, code[-1]))  # the last code may go on in the next batch
        open_ = rows.slice(done)
        if done:
            yield intervals(rows.slice(0, done))
    if open_ is not None and open_.num_rows:
        yield intervals(open_)


def shared_spans(contigs: DataFrame) -> DataFrame:
    """Maximal runs of shared positions: `contig_id`, `span_start`, `span_end` (0-based, end exclusive).

    A position is shared if it lies in SPAN bases, free of N, that another `contig_id` also holds (same strand, case and
    white space ignored). Redelivered rows of a contig count once; where they differ, each stretch of the contig is read from
    the row whose text there is highest. Null ids and null, empty or short sequences give no row.
    Contigs need `contig_id` and `seq`; other columns are not read.
    """
    tasks = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    route = F.when(F.col("kind") == 2, F.xxhash64("contig_id", "pos")).otherwise(F.xxhash64("code"))  # settled anchors go anywhere
    near = anchors(contigs, tasks).repartition(tasks, route).sortWithinPartitions("code").mapInArrow(_shared, "contig_id long, chunk long, pos long, hot boolean")
    marks = near.groupBy("contig_id", "chunk").agg(*[F.collect_set(F.when(F.col("hot") == hot, F.col("pos"))).alias(f"at_{hot}") for hot in (False, True)])  # at most a chunk's positions
    texts = cut(chunks(contigs).groupBy("contig_id", "chunk").agg(F.max("bases").alias("bases")).join(marks, ["contig_id", "chunk"]))
    at = lambda hot: texts.where(F.size(f"at_{hot}") > 0).select("contig_id", "chunk", "bases", f"at_{hot}")
    # The surroundings of anchors meet by code and are extended.
    extended = at(False).mapInArrow(_contexts, _CONTEXT).repartition(tasks, "code").sortWithinPartitions("code").mapInArrow(_extend, "contig_id long, pos long, end long")
    # Anchors of a hot code are widened to the whole span; the widened words are aggregated.
    rows = at(True).mapInArrow(_stretches, ", ".join(f"{w} long" for w in _WIDE) + ", contig_id long, pos long")
    twice = rows.groupBy(*_WIDE).agg(F.min("contig_id").alias("_lo"), F.max("contig_id").alias("_hi")).where("_lo < _hi").select(*_WIDE)
    matched = rows.join(twice, _WIDE, "left_semi").select("contig_id", "pos", (F.col("pos") + SPAN).alias("end"))
    # Runs are first closed within chunks, so that the windows over whole contigs see runs, not positions.
    runs = extended.unionByName(matched).withColumn("_chunk", F.floor(F.col("pos") / CHUNK))
    runs = _islands(runs, Window.partitionBy("contig_id", "_chunk").orderBy("pos"), ["contig_id", "_chunk"])
    return _islands(runs, Window.partitionBy("contig_id").orderBy("pos"), ["contig_id"]).select("contig_id", F.col("pos").alias("span_start"), F.col("end").alias("span_end"))


def _islands(df: DataFrame, w, keys: list[str]) -> DataFrame:
    """Intervals [pos, end) that overlap or touch, merged within `keys`."""
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(upto.isNull() | (F.col("pos") > upto), 1).otherwise(0)
    numbered = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("pos").alias("pos"), F.max("end").alias("end")).drop("_run")


def shared_share(contigs: DataFrame, spans: DataFrame) -> DataFrame:
    """For every contig its length without white space, how many bases lie in shared spans, and that share (6 digits).

    A contig without sequence has length 0 and share 0; of redelivered rows the longest counts.
    """
    n = F.length(F.regexp_replace(F.coalesce("seq", F.lit("")), r"\s+", ""))
    lengths = contigs.where("contig_id IS NOT NULL").groupBy("contig_id").agg(F.max(n).cast("long").alias("bases"))
    got = spans.groupBy("contig_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_bases"), F.count(F.lit(1)).alias("n_spans"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return lengths.join(got, "contig_id", "left").select(
        "contig_id", "bases", zero("shared_bases").alias("shared_bases"), zero("n_spans").alias("n_spans"),
        F.when(F.col("bases") > 0, F.round(zero("shared_bases") / F.col("bases"), 6)).otherwise(F.lit(0.0)).alias("share"),
    )

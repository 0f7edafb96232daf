"""Words of sequences as 2-bit codes in longs: made in one pass of numpy over Arrow batches, handled by built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 4, np.uint64)
for _k, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _k

#: Bases that are coded at once; longer sequences go in parts.
PART = 1 << 21


def codes(seq: str | None) -> np.ndarray:
    """2-bit codes of the bases (A=0, C=1, G=2, T=3, anything else 4), read without white space and regardless of case."""
    return _CODE[np.frombuffer("".join((seq or "").split()).encode("ascii", "replace"), np.uint8)]


def words(v: np.ndarray, k: int) -> np.ndarray:
    """The 2-bit code (first base highest) of the k <= 32 bases that start at each position; by doubling, in log2(k) steps."""
    n = len(v) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    block, size, out, have = v & np.uint64(3), 1, None, 0
    while True:
        if k & size:
            out = block if out is None else (out[: len(v) - have - size + 1] << np.uint64(2 * size)) | block[have : len(v) - size + 1]
            have += size
        if have == k:
            return out[:n]
        block = (block[: len(block) - size] << np.uint64(2 * size)) | block[size:]
        size *= 2


def clean(v: np.ndarray, k: int) -> np.ndarray:
    """Whether the k bases from each position are free of undetermined ones."""
    if len(v) < k:
        return np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(v == 4)])
    return upto[k:] == upto[:-k]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bases of the parts that words are dealt by, and words that one row of `runs` holds at most.
ANCHOR, RUN = 11, 21


def _ranks(parts: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """A pseudorandom 31-bit rank of each part, the same on either strand."""
    return (mixed(np.minimum(parts, turned) + np.uint64(1)) >> np.uint64(33)).astype(np.int32)


def turned_codes(code: np.ndarray, k: int) -> np.ndarray:
    """The code of each word's reverse complement."""
    back = np.zeros(len(code), np.uint64)
    for i in range(k):
        back = (back << np.uint64(2)) | (np.uint64(3) - ((code >> np.uint64(2 * i)) & np.uint64(3)))
    return back


def dealt(x: np.ndarray, back: np.ndarray, k: int) -> np.ndarray:
    """The least rank of the ANCHOR-base parts of each k-base word `x`, `back` turned; it is the same on either strand."""
    mask, best = np.uint64((1 << 2 * ANCHOR) - 1), np.full(len(x), 2**31 - 1, np.int32)
    for i in range(k - ANCHOR + 1):
        best = np.minimum(best, _ranks((x >> np.uint64(2 * i)) & mask, (back >> np.uint64(2 * (k - ANCHOR - i))) & mask))
    return best


def runs(df: DataFrame, keys: list[str], k: int = 31) -> DataFrame:
    """The k-base words of the column `bases` that are free of N, in runs that overlap and have the same `dealt`: `keys`, `part`
    (`dealt`), `at` (0-based place of the first word), `back` (its place on the other strand), `code` (of the first word), and
    `more`: the bases behind it (two bits each, 40 bits, the first highest) and, in the last 5 bits, the number of words.

    A run has at most RUN words. It takes a fraction of the room of its words, which `run_words` makes of it.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    behind = RUN - 1

    def emit(batch: pa.RecordBatch, parts: list[tuple[int, int, int, str]]) -> Iterator[pa.RecordBatch]:
        v = codes("N".join(p[3] for p in parts))
        at = np.flatnonzero(clean(v, k))
        if not len(at):
            return
        turned = np.where(v < 4, np.uint64(3) - (v & np.uint64(3)), np.uint64(0))[::-1]
        rank = _ranks(words(v, ANCHOR), words(turned, ANCHOR)[::-1])
        width, least = k - ANCHOR + 1, rank
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        part = least[at]
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])])
        begin = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        begin = np.flatnonzero(place % RUN == 0)
        n = np.diff(np.append(begin, len(at)))
        start = at[begin]
        tail = words(np.concatenate([v & np.uint64(3), np.zeros(k + behind, np.uint64)]), behind)[start + k]
        cut_ = (2 * (behind - (n - 1))).astype(np.uint64)
        more = ((tail >> cut_ << cut_) << np.uint64(5)) | n.astype(np.uint64)
        size = np.array([len(p[3]) + 1 for p in parts])
        base = np.cumsum(size) - size
        of = np.searchsorted(base, start, "right") - 1
        row, offset, total = (np.array([p[c] for p in parts], np.int64) for c in range(3))
        pos = start - base[of] + offset[of]
        own = pa.array(row[of])
        columns = [batch.column(c).take(own) for c in range(len(keys))]
        values = [part[begin], pos.astype(np.int32), (total[of] - k - pos).astype(np.int32), words(v, k)[start].astype(np.int64), more.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values)], [*keys, "part", "at", "back", "code", "more"])

    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "part int, at int, back int, code long, more long"])
    return df.select(*keys, "bases").mapInArrow(lambda batches: _in_parts(batches, len(keys), k, emit), schema)


def dealt_words(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """`keys`, and for the word `code`: `part`, the canonical `code`, `_same` (whether it is the word itself) and `_own` (whether the
    word is its own reverse complement), as `run_words` has them."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keys)).to_numpy().astype(np.uint64)
            back = turned_codes(x, k)
            values = [dealt(x, back, k), np.minimum(x, back).astype(np.int64), x < back, x == back]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, values)], [*keys, "part", "code", "_same", "_own"])

    return df.select(*keys, "code").mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in keys), "part int, code long, _same boolean, _own boolean"]))


def run_words(rows: DataFrame, keys: list[str], k: int = 31) -> DataFrame:
    """The words of `runs`, by built-in expressions that keep how rows are partitioned: `keys`, `part`, `code` (canonical), `same`
    (whether it is the word itself), `at` and `back`."""
    each = rows.select(*keys, "part", "at", "back", "code", "more", F.explode(F.sequence(F.lit(0), F.col("more").bitwiseAND(F.lit(31)).cast("int") - 1)).alias("i"))
    word = F.expr(f"(shiftleft(code, 2 * i) & {(1 << 2 * k) - 1}) | (shiftright(more, {5 + 2 * (RUN - 1)} - 2 * i) & (shiftleft(1L, 2 * i) - 1))")
    each = each.select(*keys, "part", word.alias("word"), (F.col("at") + F.col("i")).alias("at"), (F.col("back") - F.col("i")).alias("back"))
    rest = [*keys, "part", "at", "back", "word"]
    each = each.select(*rest, F.bitwise_not("word").alias("turned"))
    for swap in _SWAPS:  # a step at a time, as an expression of all steps doubles with each
        each = each.select(*rest, _swapped(F.col("turned"), *swap).alias("turned"))
    each = each.select(*rest, F.shiftrightunsigned("turned", 64 - 2 * k).alias("turned"))
    # Without nulls nothing is tested twice.
    return each.select(*keys, "part", F.coalesce(F.least("word", "turned"), F.lit(-1)).alias("code"), (F.col("word") < F.col("turned")).alias("same"), "at", "back")


def _in_parts(batches: Iterator[pa.RecordBatch], column: int, k: int, emit) -> Iterator[pa.RecordBatch]:
    """What `emit` makes of the batches' sequences: (row, place of its first base, length of the sequence, text), about PART bases at once."""
    for batch in batches:
        parts, held = [], 0
        for i, seq in enumerate(batch.column(column)):
            s = seq.as_py() or ""
            for a in range(0, max(len(s) - k + 1, 0), PART):
                parts.append((i, a, len(s), s[a : a + PART + k - 1]))
                held += len(parts[-1][3])
                if held >= PART:
                    yield from emit(batch, parts)
                    parts, held = [], 0
        if parts:
            yield from emit(batch, parts)


def coded_words(df: DataFrame, keys: list[str], k: int, both: bool = False) -> DataFrame:
    """`keys`, `strand` (1, and -1 for the reverse complement if `both`), `at` (0-based, in the strand's text) and `code` of every
    k-base word (k <= 31) of the column `bases` that is free of N.

    Many short sequences are coded together, with an undetermined base between them; long ones in parts.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def emit(batch: pa.RecordBatch, parts: list[tuple[int, int, int, str]]) -> Iterator[pa.RecordBatch]:
        v = codes("N".join(p[3] for p in parts))
        size = np.array([len(p[3]) + 1 for p in parts])
        first = np.cumsum(size) - size
        at = np.flatnonzero(clean(v, k))
        if not len(at):
            return
        of = np.searchsorted(first, at, "right") - 1
        row, offset, total = (np.array([p[c] for p in parts], np.int64) for c in range(3))
        pos = at - first[of] + offset[of]
        own = pa.array(row[of])
        columns = [batch.column(c).take(own) for c in range(len(keys))]
        names = [*keys, "strand", "at", "code"]
        one = lambda s, p, w: pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(p), s, np.int32)), pa.array(p.astype(np.int32)), pa.array(w.astype(np.int64))], names)
        yield one(1, pos, words(v, k)[at])
        if both:
            turned = np.where(v < 4, np.uint64(3) - (v & np.uint64(3)), np.uint64(4))[::-1]
            yield one(-1, total[of] - k - pos, words(turned, k)[len(v) - k - at])

    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "strand int, at int, code long"])
    return df.select(*keys, "bases").mapInArrow(lambda batches: _in_parts(batches, len(keys), k, emit), schema)


#: Groups of bits and the lower ones of each two.
_SWAPS = ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF))


def _swapped(x: Column, bits: int, mask: int) -> Column:
    return F.shiftleft(x.bitwiseAND(F.lit(mask)), bits).bitwiseOR(F.shiftrightunsigned(x, bits).bitwiseAND(F.lit(mask)))


def reversed_code(code: Column, k: int) -> Column:
    """The code of the reverse complement of a k-base word (k <= 31): complemented, groups of bits swapped, shifted down."""
    x = F.bitwise_not(code)
    for swap in _SWAPS:
        x = _swapped(x, *swap)
    return F.shiftrightunsigned(x, 64 - 2 * k)


def canonical_code(code: Column, k: int) -> Column:
    """The lesser of a word's code and that of its reverse complement; codes order as words do."""
    return F.least(code, reversed_code(code, k))


def word_text(code: Column, k: int) -> Column:
    """The k bases of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")

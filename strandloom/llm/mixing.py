"""Problem 7: mixing sources to target weights.

The tokens of each source are packed, in a pseudorandom order of its documents, into blocks of a fixed length; only the last
block of a source may be shorter. The mixture's size in tokens gives every source a quota, and so a number of slots: the k-th
slot of a source is mapped through a pseudorandom permutation of its full blocks (a new one for every round of repeats; the
short block ends a round), and the last slot is cut where the quota is reached, so that shares are exact to the token. Slots
are dealt to shards of a fixed number of blocks by multinomial draws from what is left of the quotas: first to at most
MAX_GROUPS groups of shards on the driver, then to the shards of a group within a task. Slots join blocks by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.tokens import count_tokens
from strandloom.plans.shared import cut
from strandloom.sources.tables import spread

BLOCK, SHARD_BLOCKS, MAX_GROUPS, SEED = 512, 256, 1024, 20240229


def source_key(col):
    """Sources are compared trimmed and in lower case."""
    return F.lower(F.trim(col))


def permuted(k: np.ndarray, n: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of range(n), elementwise: a four-round Feistel network, walked until it falls below n."""
    k, n, salt = k.astype(np.uint64), n.astype(np.uint64), salt.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.ones(len(k), bool)
    while todo.any():
        x, h, m, s = out[todo], half[todo], mask[todo], salt[todo]
        left, right = x >> h, x & m
        for r in range(4):
            z = (right + s + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(29))) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def drawn(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Multinomial counts of `size` slots by what is `left` of each source, never more than that."""
    got = np.minimum(rng.multinomial(size, left / left.sum()), left)
    while got.sum() < size:
        got = np.minimum(got + rng.multinomial(size - got.sum(), (left - got) / (left - got).sum()), left)
    return got


def quotas(sources: list[tuple[str, float, int, int]], total_tokens: int | None) -> dict[str, int]:
    """Tokens of each source in the mixture, from (source, share, max_repeat, tokens).

    Without `total_tokens` the mixture is the largest in which every source that has documents reaches its share; with it,
    a source that cannot supply its share falls short. Shares of sources without documents are spread over the others.
    """
    have = [(s, share, rep * tokens) for s, share, rep, tokens in sources if tokens and share > 0 and rep > 0]
    whole = sum(share for _, share, _ in have)
    if not have:
        return {}
    total = total_tokens if total_tokens else min(cap * whole / share for _, share, cap in have)
    return {s: min(cap, round(share / whole * total)) for s, share, cap in have}


def slots_of(quota: int, tokens: int, block: int) -> tuple[int, int]:
    """(slots, tokens of the last slot) that make up `quota`, of a source whose every round has `tokens` tokens."""
    turns, rest = divmod(quota, tokens)
    if not rest:
        turns, rest = turns - 1, tokens
    return turns * -(-tokens // block) + -(-rest // block), rest - (-(-rest // block) - 1) * block


def plan(quota: dict[str, int], tokens: dict[str, int], block: int, seed: int) -> list[tuple[int, list[str], list[int], list[int]]]:
    """Rows (group, sources, first slot of each, slots of each): at most MAX_GROUPS groups of whole shards."""
    names = [s for s in sorted(quota) if quota[s] > 0]
    left = np.array([slots_of(quota[s], tokens[s], block)[0] for s in names], np.int64)
    shards = -(-int(left.sum()) // SHARD_BLOCKS)
    per_group = SHARD_BLOCKS * -(-shards // MAX_GROUPS) if shards else 0
    rng, rows, used = np.random.default_rng(seed), [], np.zeros(len(names), np.int64)
    while left.sum():
        got = drawn(left, min(per_group, int(left.sum())), rng)
        rows.append((used.sum() // SHARD_BLOCKS, names, used.tolist(), got.tolist()))
        used, left = used + got, left - got
    return [(int(g), *r) for g, *r in rows]


def deal(seed: int):
    """Function for `mapInPandas`: the rows of `plan` as (shard, source, first, n), at most SHARD_BLOCKS slots in a shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for shard, names, first, n in df.itertuples(index=False):
                used, left, out = np.array(first, np.int64), np.array(n, np.int64), []
                rng = np.random.default_rng([seed, int(shard)])
                while left.sum():
                    got = drawn(left, min(SHARD_BLOCKS, int(left.sum())), rng)
                    out += [(shard, s, u, k) for s, u, k in zip(names, used.tolist(), got.tolist()) if k]
                    used, left, shard = used + got, left - got, shard + 1
                yield pd.DataFrame(out, columns=["shard", "source", "first", "n"])

    return run


def pack(counts: DataFrame, block: int) -> DataFrame:
    """The parts of documents in the blocks of their source: `source`, `block`, `in_block` (place there), `doc_id`, `from_token`, `n_tokens`.

    The running sum of tokens is taken in two steps, within hash buckets of a source and over the buckets' totals, so that
    no task orders a whole source. The totals that are broadcast are at most (buckets x sources) rows.
    """
    buckets = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id").alias("_h")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_t")).select("source", "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum("n_tokens").over(within)).join(F.broadcast(totals), ["source", "_bucket"])
    placed = placed.withColumn("_end", F.col("_base") + F.col("_end")).withColumn("_start", F.col("_end") - F.col("n_tokens"))
    last = F.floor((F.col("_end") - 1) / block)
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block), last)))
    lo, hi = F.greatest(F.col("_start"), F.col("block") * block), F.least(F.col("_end"), (F.col("block") + 1) * block)
    return parts.select("source", "block", (lo - F.col("block") * block).alias("in_block"), "doc_id", (lo - F.col("_start")).alias("from_token"), (hi - lo).alias("n_tokens"))


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: one row per use of a part of a document.

    Columns: `shard`, `source`, `slot` (of the source), `use_no` from 1, `block`, `doc_id`, `from_token`, `n_tokens`.
    `documents` needs unique `doc_id`, `source`, `text`; `targets` is a small table of `source`, `target_share`,
    `max_repeat`. Rows whose source is null or not listed, and texts without tokens, take no part. Shares or caps that are
    null count as 0 and 1. No documents, or no targets, give no rows.
    """
    spark = documents.sparkSession
    wanted = {r[0]: (r[1] or 0.0, 1 if r[2] is None else r[2]) for r in targets.where("source IS NOT NULL").select(source_key("source"), "target_share", "max_repeat").collect()}
    listed = documents.select("doc_id", source_key("source").alias("source"), "text").where(F.col("source").isin(list(wanted)))
    counts = cut(count_tokens(spread(listed), ["doc_id", "source"]).where("n_tokens > 0"))
    tokens = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("n_tokens")).collect()}
    quota = quotas([(s, *wanted[s], tokens.get(s, 0)) for s in sorted(wanted)], total_tokens)
    ends = [(s, *slots_of(q, tokens[s], block), tokens[s] // block, -(-tokens[s] // block)) for s, q in quota.items() if q > 0]
    last = spark.createDataFrame(ends, "source string, n_slots long, last_tokens long, n_full long, n_blocks long")  # a row per source
    groups = spark.createDataFrame(plan(quota, tokens, block, seed), "shard long, sources array<string>, first array<long>, n array<long>")
    shards = spread(groups).mapInPandas(deal(seed), "shard long, source string, first long, n long").join(F.broadcast(last), "source")

    @F.pandas_udf("long")
    def block_of(k: pd.Series, n: pd.Series, salt: pd.Series) -> pd.Series:
        full = (k < n).to_numpy()  # the short block stays at the end of the round
        out = k.to_numpy().copy()
        out[full] = permuted(k.to_numpy()[full], n.to_numpy()[full], salt.to_numpy()[full])
        return pd.Series(out)

    slots = shards.withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))  # at most SHARD_BLOCKS
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    limit = F.when(F.col("slot") == F.col("n_slots") - 1, F.col("last_tokens")).otherwise(F.lit(block))
    slots = slots.select("shard", "source", "slot", (turn + 1).alias("use_no"), block_of(F.col("slot") % F.col("n_blocks"), "n_full", F.xxhash64("source", turn, F.lit(seed))).alias("block"), limit.cast("long").alias("_limit"))
    rows = slots.join(pack(counts, block), ["source", "block"]).where("in_block < _limit")
    return rows.select("shard", "source", "slot", "use_no", "block", "doc_id", "from_token", F.least("n_tokens", F.col("_limit") - F.col("in_block")).alias("n_tokens"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of `targets`: `target_share`, `tokens`, `actual_share` (6 digits) and the most uses of a document's token."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("use_no").alias("most_uses"))
    total = got.agg(F.sum("tokens")).scalar()
    wanted = targets.where("source IS NOT NULL").select(source_key("source").alias("source"), "target_share", "max_repeat")
    return wanted.join(got, "source", "left").select(
        "source", "target_share", "max_repeat", F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.col("tokens") / total, F.lit(0.0)), 6).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )


def invariants(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of `targets`: whether it takes part, is within one token of its target among those that do, and within its cap."""
    got = shares(mixture, targets)
    total, whole = got.agg(F.sum("tokens")).scalar(), got.where("tokens > 0").agg(F.sum("target_share")).scalar()
    off = F.abs(F.col("tokens") - F.col("target_share") / whole * total)
    return got.select("source", (F.col("tokens") > 0).alias("takes_part"), ((F.col("tokens") == 0) | (off <= 1)).alias("on_target"), (F.col("most_uses") <= F.coalesce("max_repeat", F.lit(1))).alias("within_cap"))

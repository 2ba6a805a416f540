"""Sources mixed to target shares of all tokens, by packed blocks and index permutations.

The documents of each source form one stream of tokens, in an order given by a
hash, cut into blocks of ``BLOCK`` tokens.  Every output shard draws its source
counts from a multinomial distribution; a source's draws are numbered over all
shards, and each number is mapped through a pseudorandom permutation of the
source's block indexes (a new one for every repeat).  Slots and blocks are then
joined by index.  Draws are corrected to the planned totals, so shares come out as
near to their targets as blocks and repeat limits allow.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .visual import canonical_text

#: Tokenizer file (ranks of a byte-level BPE), its pattern (a fixed value), tokens of a block and blocks of a shard.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, SHARD = 256, 1024
#: Documents of a source are spread over chunks of about this many; prefix sums run within and over chunks.
CHUNK = 20_000
#: A table of more sources than this is no dimension table; the operator refuses.
MAX_SOURCES = 10_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """One spelling of a source's name: consistent characters, runs of anything but letters and digits as ``_``."""
    return F.regexp_replace(F.regexp_replace(canonical_text(source), r"[^\p{L}\p{N}\p{M}]+", "_"), r"^_+|_+$", "")


def token_counts(docs: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, source, tokens`` of every document with a source; whole texts are encoded, in chunks of bounded size."""

    def run(batches):
        e = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "source": b["s"], "tokens": [len(e.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b["t"]]})

    given = docs.select(F.col(key).cast("long").alias("k"), source_key(F.col(source)).alias("s"), F.col(text).alias("t")).where("s is not null and s <> ''")
    return given.mapInPandas(run, "k long, source string, tokens long").withColumnRenamed("k", key)


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of ``0..n-1`` applied to ``index``: a four-round Feistel network with cycle walking."""
    index, n, seed = index.astype(np.uint64).copy(), n.astype(np.uint64), seed.astype(np.uint64)
    half = np.ceil(np.ceil(np.log2(np.maximum(n.astype(float), 2))) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(index))
    while len(todo):
        left, right = index[todo] >> half[todo], index[todo] & mask[todo]
        for r in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + seed[todo] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(r * 0x94D049BB133111EB & (1 << 64) - 1)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            left, right = right, (left ^ x) & mask[todo]
        index[todo] = (left << half[todo]) | right
        todo = todo[index[todo] >= n[todo]]
    return index.astype(np.int64)


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> tuple[dict[str, int], int]:
    """Tokens to take of each source, and the total aimed at.

    Without a given total it is the largest at which every source that has tokens reaches its share.  With one,
    sources that can't reach their share give all they may, and the rest is shared out among the others by
    target (water-filling).
    """
    share = {s: t for s, (t, r) in targets.items() if t > 0 and tokens.get(s, 0) * r > 0}
    cap = {s: tokens[s] * targets[s][1] for s in share}
    if not share:
        return {}, 0
    if total is None:
        whole = sum(share.values())
        total = int(min(cap[s] * whole / t for s, t in share.items()))
    take: dict[str, float] = {}
    open_, left = dict(share), float(total)
    while open_:
        weight = sum(open_.values())
        full = [s for s, t in open_.items() if left * t / weight >= cap[s]]
        if not full:
            take |= {s: left * t / weight for s, t in open_.items()}
            break
        for s in full:
            take[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return {s: round(max(0.0, x)) for s, x in take.items()}, total


def _blocks(counted: DataFrame) -> DataFrame:
    """``source, block, key, first, n``: the parts of documents in each block of their source's stream."""
    size = F.ceil(F.count("*") / F.lit(CHUNK)).cast("int")
    chunks = counted.groupBy("source").agg(size.alias("_c"))
    spread = counted.where("tokens > 0").join(F.broadcast(chunks), "source").withColumn("_h", F.xxhash64("source", "_k")).withColumn("_chunk", F.pmod("_h", F.col("_c")))
    sums = spread.groupBy("source", "_chunk").agg(F.sum("tokens").alias("_n"))
    over = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_chunk", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("source", "_chunk").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)
    at = spread.withColumn("_in", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(sums, ["source", "_chunk"]).withColumn("_at", F.col("_base") + F.col("_in"))
    b, end = F.col("block"), F.col("_at") + F.col("tokens")
    parts = at.select("source", "_k", "tokens", "_at", F.explode(F.sequence(F.floor(F.col("_at") / BLOCK), F.floor((end - 1) / BLOCK))).alias("block"))
    first = F.greatest(b * BLOCK, F.col("_at"))
    return parts.select("source", b, "_k", (first - F.col("_at")).alias("first"), (F.least((b + 1) * BLOCK, end) - first).alias("n"))


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixed set and the report of shares.

    The set has ``shard, position, source, pass, block, key, first, n``: the tokens ``first .. first + n`` of a
    document stand at this position.  No document is used more than ``max_repeats`` times.  The report has
    ``source, target_share, max_repeats, tokens, planned, reached, reached_share, most_repeats`` for every source of
    ``targets``.

    Sources are matched however spelled; documents of sources without a target, without a source, or without text
    take no part.  Targets that are null, repeated (the first by source and share counts) or not positive count as 0.
    Empty tables give an empty set.  Actions: tokens per source and draws per source are collected (both bounded
    by ``MAX_SOURCES``); the token counts are written to the shared folder.
    """
    spark = docs.sparkSession
    rows = targets.select(source_key(F.col("source")).alias("s"), F.coalesce("target_share", F.lit(0.0)).alias("t"), F.coalesce("max_repeats", F.lit(0)).alias("r")).where("s is not null").orderBy("s", F.desc("t")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: not a dimension table")
    wanted: dict[str, tuple[float, int]] = {}
    for r in rows:
        wanted.setdefault(r["s"], (max(0.0, float(r["t"])), max(0, int(r["r"]))))
    dim = spark.createDataFrame([(s,) for s in wanted] or [("",)], "source string")
    counted = token_counts(docs, key, text, source, tokenizer).withColumnRenamed(key, "_k").join(F.broadcast(dim), "source")
    counted = materialize(counted, "tokens")
    tokens = {r["source"]: int(r["n"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    takes, _ = plan(tokens, wanted, total)
    names = sorted(takes)
    have = {s: math.ceil(tokens[s] / BLOCK) for s in names}
    slots = {s: min(round(takes[s] * have[s] / tokens[s]), have[s] * wanted[s][1]) for s in names}
    n_slots = sum(slots.values())
    p = np.array([slots[s] for s in names], float) / max(1, n_slots)

    def draw(batches):
        for b in batches:
            out = []
            for shard in b["id"]:
                size = min(SHARD, n_slots - shard * SHARD)
                got = np.random.default_rng([seed, int(shard)]).multinomial(size, p)
                out += [(int(shard), i, int(c)) for i, c in enumerate(got) if c]
            yield pd.DataFrame(out, columns=["shard", "i", "c"])

    drawn = spark.range(math.ceil(n_slots / SHARD)).mapInPandas(draw, "shard long, i int, c int")
    before = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    totals = {r["i"]: int(r["c"]) for r in drawn.groupBy("i").agg(F.sum("c").alias("c")).collect()}
    # draws beyond a source's plan are handed, by rank, to sources that were drawn too seldom
    surplus_at, short, rank = [0] * len(names), [], 0
    for i, s in enumerate(names):
        surplus_at[i] = rank
        rank += max(0, totals.get(i, 0) - slots[s])
    at = 0
    for i, s in enumerate(names):
        lack = max(0, slots[s] - totals.get(i, 0))
        short.append((at, at + lack, i, totals.get(i, 0)))
        at += lack
    starts = np.array([a for a, _, _, _ in short] or [0])
    planned, blocks, offset = (np.array(x or [0], np.int64) for x in ([slots[s] for s in names], [have[s] for s in names], surplus_at))

    def place(batches):
        for b in batches:
            i, c = b["i"].to_numpy(np.int64), b["c"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(b)), c)
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            src, slot = i[row], b["start"].to_numpy(np.int64)[row] + j
            over = slot >= planned[src]
            if over.any():
                r = offset[src[over]] + slot[over] - planned[src[over]]
                to = np.searchsorted(starts, r, side="right") - 1
                src[over], slot[over] = np.array([short[t][2] for t in to]), np.array([short[t][3] for t in to]) + r - starts[to]
            n = blocks[src]
            again = slot // n
            yield pd.DataFrame({"shard": b["shard"].to_numpy()[row], "i0": i[row], "j0": j, "source": np.array(names, dtype=object)[src], "pass": again, "block": permuted(slot % n, n, again * 1_000_003 + src + seed * 7919)})

    placed = numbered.mapInPandas(place, "shard long, i0 int, j0 long, source string, pass long, block long")
    placed = placed.withColumn("position", (F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("i0", "j0", "shard"), "i0", "j0")) - 1)).drop("i0", "j0")
    mixed = placed.join(_blocks(counted), ["source", "block"]).select("shard", "position", "source", "pass", "block", F.col("_k").alias(key), "first", "n")
    reached = mixed.groupBy("source").agg(F.sum("n").alias("reached"), (F.max("pass") + 1).alias("most_repeats"))
    report = spark.createDataFrame([(s, t, r, tokens.get(s, 0), takes.get(s, 0)) for s, (t, r) in sorted(wanted.items())], "source string, target_share double, max_repeats int, tokens long, planned long")
    report = report.join(F.broadcast(reached), "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    whole = F.sum("reached").over(Window.partitionBy(F.lit(0)))  # a row per source
    return mixed, report.withColumn("reached_share", F.when(whole > 0, F.col("reached") / whole)).withColumn("most_repeats", F.coalesce("most_repeats", F.lit(0)))

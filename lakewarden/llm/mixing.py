"""Mixing sources to target weights, in an order that keeps the shares all along.

The size of the mixture is the largest at which no source has to be used more often than
it may; a source then gives whole rounds of its documents and a part of one more.  Order
is by Pfair scheduling: each source's contribution is cut into blocks of equal size, block
j of a source with share w may start at slot (j - 1) / w and has to be done by slot j / w,
and in every slot the released block with the earliest deadline goes.  Up to any slot a
source is then less than one block away from its share.

Shares are fractions, so the schedule repeats after a period; the driver makes one period, and the
slot of any block follows by arithmetic, however large the mixture is.

Which documents are in, and where, follows from running totals of tokens in a fixed random
order.  They are made in two levels (totals per bucket, then within a bucket), so a source
with any share of the rows is never in one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import ceil, floor, isqrt, lcm
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions.numbers import slot
from lakewarden.functions.present import strip
from lakewarden.sources.tables import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the public byte-level rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a block.
BLOCK = 2048
#: Target shares are read to so many digits, which bounds the period of a schedule: 10 ** DIGITS blocks.
DIGITS = 5
#: Bytes of a tokenizer's file at most: it is sent to every executor.
TOKENIZER_BYTES = 256_000_000
#: Mixture sources at most: they and their schedule are held on the driver.
SOURCES = 10_000


def counter(tokenizer: str, data: bytes | None = None) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts: rank files (.tiktoken), tokenizer files (.json), piece models (.model).

    ``data`` is what the file holds, where it can't be read under its name.
    """
    if data is None:
        data = Path(tokenizer).read_bytes()
    if tokenizer.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        ranked = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(ranked.encode_ordinary(t)) for t in texts]
    if tokenizer.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(data.decode())
    model.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(documents: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """Adds BIGINT ``out``: the tokens of ``text`` by a public tokenizer's file (0 for null and empty texts).

    The file has to be on the driver only; it is sent along.
    """
    data = Path(tokenizer).read_bytes()
    if len(data) > TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer of more than {TOKENIZER_BYTES} bytes: {tokenizer}")
    sent = documents.sparkSession.sparkContext.broadcast(data)

    @F.pandas_udf("bigint")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(tokenizer, sent.value)
        for part in parts:
            sizes: list[int] = []
            for at in range(0, len(part), 256):
                sizes += count(part.iloc[at : at + 256].fillna("").tolist())
            yield pd.Series(sizes, index=part.index, dtype="int64")

    return documents.withColumn(out, tokens(F.col(text)))


def source_name(value: Column | str) -> Column:
    """A source as it is compared: without letter case and surrounding blanks."""
    return F.lower(strip(value))


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[int, dict[str, Fraction]]:
    """The size of the largest mixture, and the share of each source that has documents.

    ``sizes``: tokens per source, ``targets``: share (to DIGITS digits) and repeats allowed.  Shares
    of sources without documents (or with no repeats) go to the others in proportion.
    """
    able = {s: (Fraction(round(w * 10**DIGITS), 10**DIGITS), r) for s, (w, r) in targets.items() if w and round(w * 10**DIGITS) > 0 and r and r > 0 and sizes.get(s, 0) > 0}
    whole = sum(w for w, _ in able.values())
    shares = {s: w / whole for s, (w, _) in able.items()}
    if not shares:
        return 0, {}
    return floor(min(Fraction(sizes[s] * r) / shares[s] for s, (_, r) in able.items())), shares


def schedule(shares: dict[str, Fraction], wanted: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) in the order of slots; ``wanted``: blocks of each source.

    Block j of a source with share w is released at floor((j - 1) / w) and due at ceil(j / w).
    Should no block be released in a slot, the slot is skipped (rounding at the end of a source).
    """
    waiting = [(0, s, 1) for s, n in wanted.items() if n]
    heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: list[tuple[str, int]] = []
    slot = 0
    while waiting or ready:
        if not ready and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, j = heappop(waiting)
            heappush(ready, (ceil(j / shares[s]), s, j))
        _, s, j = heappop(ready)
        out.append((s, j - 1))
        if j < wanted[s]:
            heappush(waiting, (floor(j / shares[s]), s, j + 1))
        slot += 1
    return out


def period(shares: dict[str, Fraction]) -> tuple[int, list[tuple[str, int, int, int]]]:
    """The length of a schedule's period, and (source, its blocks in a period, block, slot) of each block in the first.

    After so many slots every source has its whole number of blocks, and all begins anew.
    """
    length = lcm(*[w.denominator for w in shares.values()]) if shares else 1
    often = {s: int(w * length) for s, w in shares.items()}
    return length, [(s, often[s], j, i) for i, (s, j) in enumerate(schedule(shares, often))]


def _target_rows(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where(F.col("source").isNotNull()).groupBy(source_name("source").alias("s")).agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} target sources")
    return {r.s: (r.w, r.r) for r in rows}


class Mixture:
    """What mix() gives.  ``rows``: one row per use of a document; ``report``: one per source."""

    def __init__(self, rows: DataFrame, report: DataFrame, size: int, block: int):
        self.rows, self.report, self.size, self.block = rows, report, size, block


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 42) -> Mixture:
    """A mixture of ``documents`` (doc_id, text, source) after ``targets`` (source, target_share, max_repeats).

    rows: doc_id, source, repeat (0 for the first use), tokens, slot, place (running tokens of the
    source before it); ordered by slot, then place, it is the mixture.  report: source,
    target_share, fair_share (of the sources that have documents), available_tokens,
    used_tokens, uses, documents_used, most_repeats, actual_share.

    Every document of a source is used once before any is used again.  A document belongs to the
    block in which it starts, so a source may be ahead by less than a block and a document.
    ``block`` doesn't depend on the size of the mixture; slots of blocks that a source no longer has
    at its end stay empty.  Null and empty texts have no tokens and are never used; sources that are null or have no
    target neither.  Rows with equal doc_id are separate documents.
    """
    spark = documents.sparkSession
    wanted = _target_rows(targets)
    known = spark.createDataFrame([(s,) for s in wanted], "source string")
    rows = documents.select("doc_id", "text", source_name("source").alias("source"))
    # At most SOURCES names.
    rows = rows.join(F.broadcast(known), "source", "left_semi").withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = cut(count_tokens(rows, tokenizer=tokenizer).drop("text").where(F.col("tokens") > 0))
    totals = {r.source: (r.t, r.n) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = {s: t for s, (t, _) in totals.items()}
    size, shares = plan(sizes, wanted)
    quota = {s: floor(w * size) for s, w in shares.items()}
    length, slots = period(shares)
    # At most 10 ** DIGITS blocks.
    slots = spark.createDataFrame(slots, "source string, often bigint, block bigint, _slot bigint")
    rounds = spark.createDataFrame(
        [(s, q, sizes[s], -(-q // sizes[s]), max(1, isqrt(totals[s][1])), int(shares[s] * length)) for s, q in quota.items()],
        "source string, quota bigint, all_tokens bigint, rounds bigint, buckets bigint, often bigint",
    )
    # At most SOURCES rows.
    own = rows.join(F.broadcast(rounds), "source").withColumn("_bucket", F.pmod("_key", "buckets"))
    sums = own.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum"))
    # As many buckets as rows in a bucket: both levels stay small.
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("_before", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(starts, ["source", "_bucket"])
    placed = placed.withColumn("_at", F.col("_start") + F.col("_before"))
    used = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rounds") - 1)).alias("repeat"))
    used = used.withColumn("place", F.col("_at") + F.col("repeat") * F.col("all_tokens")).where(F.col("place") < F.col("quota"))
    used = used.withColumn("_block", slot(F.col("place"), block)).withColumn("block", F.pmod("_block", "often")).join(F.broadcast(slots), ["source", "often", "block"])
    turn = ((F.col("_block") - F.col("block")) / F.col("often")).cast("bigint")
    used = used.select("doc_id", "source", F.col("repeat").cast("int").alias("repeat"), "tokens", (turn * length + F.col("_slot")).alias("slot"), "place")

    fair = spark.createDataFrame(
        [(s, float(w), float(shares.get(s, 0)), int(r or 0), int(sizes.get(s, 0))) for s, (w, r) in wanted.items()],
        "source string, target_share double, fair_share double, max_repeats int, available_tokens bigint",
    )
    got = used.groupBy("source").agg(
        F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), F.sum(F.when(F.col("repeat") == 0, 1).otherwise(0)).alias("documents_used"), (F.max("repeat") + 1).alias("most_repeats")
    )
    report = fair.join(got, "source", "left").fillna(0, ["used_tokens", "uses", "documents_used", "most_repeats"])
    # One row per source.
    report = report.withColumn("actual_share", F.col("used_tokens") / F.greatest(F.sum("used_tokens").over(Window.partitionBy(F.lit(0))), F.lit(1)))
    return Mixture(used, report, size, block)

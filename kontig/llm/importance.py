"""Resampling towards a target distribution by hashed n-gram importance weights (Xie et al., 2023) with Gumbel top-k.

Words and word pairs are hashed into buckets. A bucket's gain compares its share of the target's
features with its share of the pool's; both counts cover every text. A document's weight
is the mean gain of its features, read from one array of BUCKETS numbers. Adding Gumbel noise hashed from the key and
keeping the highest scores draws without replacement in proportion to the weights.

The draw needs the rank of every eligible row, which a distributed radix sort gives: for each digit of the
composite key (score falling, key rising), the least significant first, a stable counting sort. Rows lie in blocks of
consecutive places; counts of (block, digit) and their prefix sums over digits, then blocks, tell each
(block, digit) its first destination, so no task holds more than a block's rows of a digit.

Edge cases: null texts have no words, weight 0; a null key hashes as an empty one and comes after
all others of its score; rows equal in score and key get neighbouring ranks in the order of the written table; an empty
target or pool gives gains from the smoothing alone; an empty table gives an empty table; input columns named like an output
column are replaced. Very long texts are read in pieces.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kontig.llm.common import Scratch, drop_clashes

BUCKETS = 10_000
#: Bits of a digit of the radix sort and of the places of a block.
DIGIT_BITS, BLOCK_BITS = 8, 12
#: Bytes of a text that are cut into words at once.
PIECE_BYTES = 1 << 20

_WORD, _END = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, piece by piece; no word is cut."""
    begin = 0
    while begin < len(raw):
        end = _END.search(raw, min(len(raw), begin + PIECE_BYTES))
        stop = end.start() if end else len(raw)
        yield _WORD.findall(raw, begin, stop)
        begin = stop + 1


def bucket_runs(raw: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of each piece of a text: every word and every pair of neighbouring words."""
    last: list[int] = []
    for words in _pieces(raw.lower()):  # of bytes: A-Z only
        ones = list(map(zlib.crc32, words))
        before = last + ones[:-1] if words else []
        pairs = map(zlib.crc32, map(b" ".__add__, words[len(words) - len(before) :]), before)
        yield len(words), np.fromiter((*ones, *pairs), np.uint32) % buckets
        last = ones[-1:] or last


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. One row a bucket and task is shuffled."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _texts(batch.column(0)):
                for _, found in bucket_runs(raw, buckets):
                    counts += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    counted = df.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most one row a bucket
        out[row.bucket] = row.n
    return out


def bucket_gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 x the log ratio of a bucket's smoothed share of the target to that of the pool, floored."""
    s, t, n = int(pool.sum()), int(target.sum()), len(pool)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(pool.tolist(), target.tolist(), strict=True)], np.int64)


def _uniform(key: Column, seed: int) -> Column:
    """The first 8 digits of the hexadecimal sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def score(df: DataFrame, gains: np.ndarray, seed: int = 7, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight, score), all but the key long. Narrow: no shuffle."""
    buckets = len(gains)
    chosen = df.select(F.col(f"`{key}`"), F.col(f"`{text_col}`"), _uniform(F.col(f"`{key}`"), seed).alias("_h"))

    def run(batches):
        for batch in batches:
            rows = []
            for raw, h in zip(_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = features = total = 0
                for n, found in bucket_runs(raw, buckets):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum())
                weight = total // features if features else 0
                rows.append((words, features, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            columns = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [key, "n_words", "n_features", "weight", "score"])

    long = ("n_words", "n_features", "weight", "score")
    return chosen.mapInArrow(run, T.StructType([chosen.schema[key], *(T.StructField(n, T.LongType()) for n in long)]))


def _digits(value: Column, bits: int) -> list[Column]:
    """The digits of a number of so many bits, the least significant first."""
    mask = (1 << DIGIT_BITS) - 1
    return [F.shiftrightunsigned(value, at).bitwiseAND(F.lit(mask)).cast("int") for at in range(0, bits, DIGIT_BITS)]


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """``rows`` with the place ``_at`` that a stable counting sort by ``digit`` gives them."""
    placed = rows.withColumns({"_digit": digit, "_block": F.shiftright("_at", BLOCK_BITS)})
    counts = placed.groupBy("_block", "_digit").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))  # at most 2 ** DIGIT_BITS rows
    before = W.orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("_digit", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    earlier = W.partitionBy("_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.join(F.broadcast(starts), "_digit").select("_block", "_digit", (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_offset"))
    inside = F.row_number().over(W.partitionBy("_block", "_digit").orderBy("_at")) - 1
    numbered = placed.withColumn("_inside", inside).join(offsets, ["_block", "_digit"])
    return numbered.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_at"], (F.col("_offset") + F.col("_inside")).cast("long").alias("_at"))


def radix_order(rows: DataFrame, key: str, score_col: str, scratch: Scratch) -> DataFrame:
    """``rows`` (of a written table) with ``_at``, their places from 0 by score falling, then key rising, null keys last.

    One pass for each digit of DIGIT_BITS in the range that scores and keys really have; each is written, as its rows are
    read for the counts and for the move.
    """
    k, s = F.col(f"`{key}`").cast("long"), F.col(score_col)
    low, high, least, most, nulls, n = rows.agg(F.min(s), F.max(s), F.min(k), F.max(k), F.count_if(k.isNull()), F.count("*")).first()
    out = rows.withColumn("_at", F.monotonically_increasing_id())
    if not n:
        return out
    digits = []
    if least is not None:
        whole = most - least >= 1 << 63
        digits += _digits(F.coalesce(k.bitwiseXOR(F.lit(-(1 << 63))) if whole else k - F.lit(least), F.lit(0)), 64 if whole else (most - least).bit_length())
        digits += [k.isNull().cast("int")] if nulls else []
    digits += _digits(F.lit(high) - s, (high - low).bit_length())
    written = None
    for i, digit in enumerate(digits or [F.lit(0)]):
        before, written = written, scratch.write(counting_pass(out, digit), f"digit-{i}")
        if before is not None:
            scratch.drop(before)
        out = written
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, key: str = "doc_id", text_col: str = "text", target_text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): every document; rank from 1 for the drawn ones, else null.

    Of the documents with ``min_words`` or more, ``percent`` per cent are drawn, rounded down.
    """
    docs = drop_clashes(docs, *({"n_words", "n_features", "weight", "score", "rank", "_at", "_h"} - {key, text_col}))
    scratch = scratch or Scratch(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text))
    scored = scratch.write(score(docs, gains, seed, key, text_col), "scored")
    eligible, others = scored.where(F.col("n_words") >= min_words), scored.where(F.col("n_words") < min_words)
    drawn = eligible.count() * percent // 100
    ranked = radix_order(eligible, key, "score", scratch)
    rank = F.when(F.col("_at") < drawn, F.col("_at") + 1).cast("long")
    return ranked.select(*scored.columns, rank.alias("rank")).unionByName(others.withColumn("rank", F.lit(None).cast("long")))

"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Items are partitioned by their number of shingles, doubling from class to class. The signature of an
item is its k smallest shingle hashes, with k = floor((1 - threshold) * largest size of its class) + 1
(all of them, if it has fewer). A document that contains the stated share of the item misses fewer
than k of its shingles, so it holds at least one of the signature: the search loses nothing. Long
documents need no signature of their own; their hashes probe the signatures, which are few.
Candidates are verified on the shingles themselves: shared distinct shingles / the item's shingles.

Words are runs of letters and digits, lower-cased; a shingle is five words, an item with fewer words
is one shingle of all of them and is sought as such.

Edge cases: null texts count as empty; an item or document without words matches nothing; documents
with a null key are skipped; rows that repeat a key count as one document, rows that repeat an
item_id as one item; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import small, written

WORDS, THRESHOLD = 5, 0.75


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _windows(words: Column, size: int, make) -> Column:
    """``make`` of every run of ``size`` words; an empty array if there are fewer."""
    count = F.size(words) - size
    each = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: make([F.get(words, i + k) for k in range(size)]))
    return F.when(count >= 0, each)


def _hash(run: list[Column]) -> Column:
    return F.xxhash64(*run)


def _text(run: list[Column]) -> Column:
    return F.concat_ws(" ", *run)


def _item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, size, shingle, h), distinct; size is the number of words of the item's shingles."""
    worded = items.select("item_id", words_of(F.col("text")).alias("w")).where("item_id is not null and size(w) > 0")
    parts = []
    for size in range(1, width + 1):
        mine = worded.where(F.size("w") >= width if size == width else F.size("w") == size)
        pair = _windows(F.col("w"), size, lambda run: F.struct(_text(run).alias("shingle"), _hash(run).alias("h")))
        parts.append(mine.select("item_id", F.lit(size).alias("size"), F.explode(pair).alias("s")).select("item_id", "size", "s.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def _doc_windows(words: Column, sizes: list[int], make) -> Column:
    return F.flatten(F.array_compact(F.array(*[_windows(words, s, make) for s in sizes])))


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """(key, item_id, n_item, n_shared, containment) of every pair with containment >= threshold."""
    shingles = written(_item_shingles(items, width), "items")
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())  # 1 to width
    counts = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    classed = shingles.join(counts, "item_id").withColumn("upper", F.pow(F.lit(2.0), F.floor(F.log2(F.col("n_item").cast("double"))) + 1))
    k = F.floor((1 - F.lit(threshold)) * F.col("upper")) + 1
    ranked = classed.groupBy("item_id", k.alias("k")).agg(F.sort_array(F.collect_set("h")).alias("hs"))
    signatures = written(ranked.select(F.explode(F.slice("hs", F.lit(1), F.col("k").cast("int"))).alias("h")).distinct(), "signatures")
    docs = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text")).where("_key is not null and _text is not null")
    if not sizes:
        sizes = [width]
    words = docs.select("_key", words_of(F.col("_text")).alias("w"))
    probes = words.select("_key", F.explode(_doc_windows(F.col("w"), sizes, _hash)).alias("h"))
    candidates = written(probes.join(small(signatures, signatures.count()), "h", "left_semi").select("_key").distinct(), "candidates")
    held = docs.join(small(candidates, candidates.count()), "_key", "left_semi").select("_key", words_of(F.col("_text")).alias("w"))
    runs = held.select("_key", F.explode(F.array_distinct(_doc_windows(F.col("w"), sizes, _text))).alias("shingle"))
    item_side = shingles.select("item_id", "shingle")
    shared = runs.join(small(item_side, item_side.count()), "shingle").distinct().groupBy("_key", "item_id").agg(F.count("*").alias("n_shared"))
    out = shared.join(small(counts, counts.count()), "item_id").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return out.where(F.col("containment") >= threshold).select(F.col("_key").alias(key), "item_id", "n_item", "n_shared", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; a null key stays."""
    leaks = written(find_leaks(docs, items, key, threshold, width).select(key).distinct(), "leaks")
    return docs.join(small(leaks, leaks.count()), key, "left_anti")

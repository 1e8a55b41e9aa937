"""Read mates: pairing, insert size, uniqueness and placement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.functions.sequences import reverse_complement
from kontig.operators import alignment
from kontig.params import INSERT_SAMPLE, PAIR_SD

#: A rescued mate's mismatches at most, and the least share of it that overlaps its window.
RESCUE_MISMATCHES, RESCUE_OVERLAP = 3, 0.6


def hit_ranks(hits: DataFrame, read: str, mismatches: str, order: tuple[str, ...]) -> DataFrame:
    """``hits`` with ``rank``, their place among those of their read by mismatches, then ``order``."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy(read).orderBy(mismatches, *order)).cast("long"))


def pair_id(read_id: Column) -> Column:
    """Mates 2p-1 and 2p are pair p."""
    return F.floor((read_id + 1) / 2).cast("long")


def insert_size(pairs: DataFrame, order: str, frag: str, sample: int = INSERT_SAMPLE) -> DataFrame:
    """(n, mean, sd) of the first ``sample`` fragments; the population deviation of those under twice the mean."""
    first = pairs.select(order, frag).orderBy(order).limit(sample)
    mean = first.agg(F.count("*").alias("n"), F.avg(frag).alias("mean"))
    near = first.crossJoin(F.broadcast(mean)).where(F.col(frag) < 2 * F.col("mean"))  # one row
    return near.groupBy("n", "mean").agg(F.sqrt(F.avg((F.col(frag) - F.col("mean")) ** 2)).alias("sd"))


def mates(hits: DataFrame, read: str, target: str, pos: str, mean: float, sd: float, far: float = PAIR_SD) -> DataFrame:
    """For each pair and target the two placements whose distance is closest to ``mean``, within ``far`` deviations."""
    left, right = (hits.where(F.col(read) % 2 == m).select(pair_id(F.col(read)).alias("pair"), target, F.col(read).alias(f"r{k}"), F.col(pos).alias(f"p{k}")) for m, k in ((1, 1), (0, 2)))
    off = F.abs(F.abs(F.col("p1") - F.col("p2")) - mean)
    close = left.join(right, ["pair", target]).withColumn("off", off).where(F.col("off") <= far * sd)
    best = F.row_number().over(W.partitionBy("pair", target).orderBy("off", "r1", "r2", "p1", "p2"))
    return close.withColumn("_k", best).where("_k = 1").drop("_k")


def unique_flags(hits: DataFrame, read: str) -> DataFrame:
    return hits.groupBy(read).agg(F.count("*").alias("n_hits")).withColumn("is_unique", F.when(F.col("n_hits") <= 1, 1).otherwise(0))


def sole_best(hits: DataFrame, read: str, mismatch: str) -> DataFrame:
    """Placements with the fewest mismatches of their read, where only one has so few."""
    w = W.partitionBy(read)
    low = hits.withColumn("_low", F.min(mismatch).over(w)).where(F.col(mismatch) == F.col("_low"))
    return low.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n", "_low")


def not_yet_placed(reads: DataFrame, placed: DataFrame, read: str) -> DataFrame:
    return reads.join(placed.select(read).distinct(), read, "left_anti")


# hits are (read_id, key, strand, start, size, skip, mismatches, len): candidate placements of reads, ``size`` of whose ``len`` bases lie on
# the query from ``start`` on, behind ``skip`` ones (as they lie there) that don't


_SIDE = ("strand", "start", "size", "skip", "mismatches", "len")


def _sides(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second mates as (pair, key, h1 or h2)."""
    hit = F.struct(*[F.col(c).cast("long").alias(c) for c in _SIDE])
    first, second = (hits.where(F.col("read_id") % 2 == odd).select(pair_id(F.col("read_id")).alias("pair"), "key", hit.alias(name)) for odd, name in ((1, "h1"), (0, "h2")))
    return first, second


def fragment(plus_start: Column, minus_start: Column, minus_len: Column) -> Column:
    """Length from the begin of the mate on the plus strand to the end of the one on the minus strand."""
    return minus_start + minus_len - plus_start


def _pair_fragment() -> Column:
    return F.when(F.col("h1.strand") == 0, fragment(F.col("h1.start"), F.col("h2.start"), F.col("h2.len"))).otherwise(fragment(F.col("h2.start"), F.col("h1.start"), F.col("h1.len")))


def facing_fragments(hits: DataFrame) -> DataFrame:
    """(pair, frag) of pairs whose mates have one hit each, without mismatch, on the same query, on opposite strands and facing."""
    only = hits.withColumn("_n", F.count("*").over(W.partitionBy("read_id"))).where("_n = 1 and mismatches = 0")
    first, second = _sides(only)
    both = first.join(second, ["pair", "key"]).where("h1.strand != h2.strand")
    faces = F.when(F.col("h1.strand") == 0, F.col("h1.start") <= F.col("h2.start")).otherwise(F.col("h1.start") >= F.col("h2.start"))
    return both.where(faces).select("pair", _pair_fragment().alias("frag"))


def mated_hits(hits: DataFrame, mean: float, sd: float) -> DataFrame:
    """(pair, key, h1, h2, frag): for each hit of a first mate the best one of its mate on the same query and the other strand.

    Fragments lie within PAIR_SD deviations of the mean; of several, the one with fewer mismatches, then the closest one.
    """
    first, second = _sides(hits)
    off = F.abs(F.col("frag") - mean)
    near = first.join(second, ["pair", "key"]).where("h1.strand != h2.strand").withColumn("frag", _pair_fragment()).where(off <= PAIR_SD * sd)
    best = F.min_by(F.struct("h2", "frag"), F.struct(F.col("h2.mismatches"), off, F.col("h2.start"), F.col("h2.strand")))
    return near.groupBy("pair", "key", "h1").agg(best.alias("_b")).select("pair", "key", "h1", "_b.h2", "_b.frag")


def rescued_mates(hits: DataFrame, mated: DataFrame, reads: DataFrame, queries: DataFrame, mean: float, sd: float) -> DataFrame:
    """(pair, key, h1, h2, frag) for pairs without mated hits: a mate that overlaps the query's end, aligned where it must lie.

    The window goes from a hit over the mean and PAIR_SD deviations; only windows that the query's end cuts off are searched, so that
    no more of a query (key, seq) than its ends is joined to the hits. A mate (``reads``: read_id, seq) is accepted without gaps, with RESCUE_MISMATCHES at most.
    """
    reach = math.ceil(mean + PAIR_SD * sd) + 1
    alone = hits.withColumn("pair", pair_id(F.col("read_id"))).join(mated.select("pair").distinct(), "pair", "left_anti")
    ends = queries.select("key", F.length("seq").cast("long").alias("_len"), F.substring("seq", 1, reach).alias("_head"), F.expr(f"right(seq, {reach})").alias("_tail"))
    c = F.col
    based = alone.join(ends, "key").withColumn("_end", c("start") + c("size") - 1)
    plus = (c("strand") == 0) & (c("start") + mean + PAIR_SD * sd > c("_len"))
    minus = (c("strand") == 1) & (c("_end") - mean - PAIR_SD * sd < 1)
    window = F.when(plus, F.substr("_tail", F.greatest(F.lit(1), F.length("_tail") - (c("_len") - c("start"))).cast("int"), F.lit(reach))).when(minus, F.substr("_head", F.lit(1), c("_end").cast("int")))
    cut = based.withColumn("_window", window).where("_window is not null").withColumn("_at", F.when(plus, c("start")).otherwise(F.lit(1)).cast("long"))
    mate_id = (c("read_id") - 1).bitwiseXOR(F.lit(1)) + 1
    texts = reads.select(c("read_id").alias("_mate"), c("seq").alias("_seq"))
    asked = cut.withColumn("_mate", mate_id).join(texts, "_mate").withColumn("_turned", F.when(c("strand") == 0, reverse_complement(c("_seq"))).otherwise(c("_seq")))
    found = asked.withColumn("_f", _rescue(c("_window"), c("_turned"), c("_at"), c("_len"))).where("_f.start is not null")
    this = F.struct(*[c(x).cast("long").alias(x) for x in _SIDE])
    mate = F.struct((1 - c("strand")).cast("long").alias("strand"), c("_f.start"), c("_f.size"), c("_f.skip"), c("_f.mismatches"), F.length("_seq").cast("long").alias("len"))
    odd = c("read_id") % 2 == 1
    pairs = found.select("pair", "key", F.when(odd, this).otherwise(mate).alias("h1"), F.when(odd, mate).otherwise(this).alias("h2"))
    return pairs.distinct().withColumn("frag", _pair_fragment())


def _rescue(window: Column, mate: Column, at: Column, length: Column) -> Column:
    """struct<start, size, skip, mismatches> of a mate in a window that begins at ``at`` of a query; null fields if it is not there."""

    @F.pandas_udf("start long, size long, skip long, mismatches long")
    def rescue(windows: pd.Series, mates: pd.Series, ats: pd.Series, lengths: pd.Series) -> pd.DataFrame:
        rows = []
        for window, mate, at, length in zip(windows, mates, ats, lengths, strict=True):
            found = alignment.align(window, mate)
            rows.append((None, None, None, None))
            if found.mismatches > RESCUE_MISMATCHES or len(found.row1) < RESCUE_OVERLAP * len(mate) or any(alignment.count_gaps(found.row1, found.row2)[:2]):
                continue
            before, behind = found.left2 - found.left1, found.right2 - found.right1  # of the mate, outside the window
            end = at + len(window) - 1
            head = max(0, before) if at - before < 1 else 0  # outside the query
            tail = max(0, behind) if end + behind > length and not head else 0
            mismatches = found.mismatches + found.left2 + found.right2 - head - tail
            if mismatches <= RESCUE_MISMATCHES:
                rows[-1] = (max(1, at - before) if head else at - before, len(mate) - head - tail, head, mismatches)
        return pd.DataFrame(rows, columns=["start", "size", "skip", "mismatches"]).astype("Int64")

    return rescue(window, mate, at, length)


def _tie(*columns: str) -> Column:
    """A number that follows from the candidate alone, to choose among equals without favouring a query."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns]).cast("binary"))


def choose(hits: DataFrame, mated: DataFrame, zero: DataFrame | None = None) -> DataFrame:
    """(read_id, key, strand, start, size, skip, mismatches, len, multi): the placements of reads that can be told.

    A pair whose only mated hits, or those with the fewest mismatches, are one, is placed there; reads of pairs without mated hits where they alone
    have the fewest mismatches; a read's only hit always. With ``zero`` (key, start, size, zero: uncovered positions under a hit), as for a second
    pass, equals are told by more uncovered positions, then by a hash. ``multi`` is whether neither the read's hits nor its pair's mated hits are one.
    """
    mates = mated.select("pair", "key", "h1", "h2", (F.col("h1.mismatches") + F.col("h2.mismatches")).alias("_miss"))
    lone = hits.withColumn("pair", pair_id(F.col("read_id"))).repartition("pair").withColumn("_hits", F.count("*").over(W.partitionBy("pair", "read_id")))
    if zero is None:
        mates, lone = mates.withColumns({"_zero": F.lit(0), "_tie": F.lit("")}), lone.withColumns({"_zero": F.lit(0), "_tie": F.lit("")})
    else:
        for side in ("h1", "h2"):
            under = zero.select("key", F.col("start").alias(f"_s_{side}"), F.col("size").alias(f"_n_{side}"), F.col("zero").alias(f"_{side}"))
            placed = mates.withColumns({f"_s_{side}": F.col(f"{side}.start"), f"_n_{side}": F.col(f"{side}.size")})
            mates = placed.join(under, ["key", f"_s_{side}", f"_n_{side}"], "left")
        mates = mates.select("pair", "key", "h1", "h2", "_miss", (-(F.coalesce("_h1", F.lit(0)) + F.coalesce("_h2", F.lit(0)))).alias("_zero"), _tie("pair", "key", "h1.start", "h2.start").alias("_tie"))
        lone = lone.join(zero, ["key", "start", "size"], "left").withColumns({"_zero": -F.coalesce("zero", F.lit(0)), "_tie": _tie("read_id", "key", "start", "strand")}).drop("zero")
    # all below goes by pair: one shuffle of the hits and one of the mated ones
    pair = W.partitionBy("pair")
    rank = F.rank().over(pair.orderBy("_miss", "_zero", "_tie"))
    ranked = mates.withColumns({"_mated": F.count("*").over(pair), "_rank": rank}).where("_rank = 1")
    some = F.first(F.struct("key", "h1", "h2", "_mated"))  # of the only one, where it is used
    pairs = ranked.groupBy("pair").agg(some.alias("_b"), F.count("*").alias("_same"))
    odd = F.col("read_id") % 2 == 1
    sizes = hits.groupBy(pair_id(F.col("read_id")).alias("pair")).agg(F.count_if(odd).alias("_n1"), F.count_if(~odd).alias("_n2"))
    sides = F.array(*[F.struct((2 * F.col("pair") - less).alias("read_id"), F.col(f"_b.{h}").alias("h"), F.coalesce(n, F.lit(0)).alias("n")) for less, h, n in ((1, "h1", "_n1"), (0, "h2", "_n2"))])
    paired = pairs.where("_same = 1").join(sizes, "pair", "left").select("_b.key", "_b._mated", F.explode(sides).alias("_s"))
    paired = paired.select("_s.read_id", "key", "_s.h.*", ((F.col("_mated") != 1) & (F.col("_s.n") > 1)).alias("multi"))
    read = W.partitionBy("pair", "read_id")
    single = lone.join(pairs.select("pair", "_same"), "pair", "left").where("_same is null or _same > 1 and _hits = 1")
    single = single.withColumn("_rank", F.rank().over(read.orderBy("mismatches", "_zero", "_tie"))).where("_rank = 1").withColumn("_only", F.count("*").over(read)).where("_only = 1")
    return paired.select("read_id", "key", *_SIDE, "multi").unionByName(single.select("read_id", "key", *[F.col(x).cast("long").alias(x) for x in _SIDE], (F.col("_hits") > 1).alias("multi")))

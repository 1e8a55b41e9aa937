"""Breakpoints between aligned segments and the decisions on them, as declarative rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.params import DISJUNCT_DISTANCE, INDEL_SIZE

TRUE, UNCERTAIN, SV = "true", "uncertain", "sv"


def _decide(*rules: Column, otherwise: str) -> Column:
    out = F.lit(otherwise)
    for rule in reversed(rules):
        out = F.when(rule, TRUE).otherwise(out)
    return out


def breakpoints(segments: DataFrame, key: str, order: tuple[str, ...] = ("q_start", "q_end"), indel: int = INDEL_SIZE) -> DataFrame:
    """(key, left, right, kind, dq, ds, subject, s_left, s_right) between neighbouring segments that don't meet, and what both segments say (p_ is the first).

    Segments have q_start, q_end, s_start, s_end, strand and subject. Another subject or strand or
    more than 5000 apart on the subject is a misjoin; else the steps on both sides decide. An insertion or gap whose second segment lies before the first on the
    subject, read along the strand, is a misjoin too.
    """
    w = W.partitionBy(key).orderBy(*order)
    prev = {c: F.lag(c).over(w).alias(f"p_{c}") for c in ("q_end", "s_end", "strand", "subject", "q_start", "s_start")}
    both = segments.select("*", *prev.values()).where("p_q_end is not null")
    dq = F.col("q_start") - F.col("p_q_end")
    ds = F.when(F.col("strand") == 0, F.col("s_start") - F.col("p_s_end")).otherwise(F.col("p_s_end") - F.col("s_start"))
    both = both.withColumns({"dq": dq, "ds": ds})
    far = (F.col("subject") != F.col("p_subject")) | (F.col("strand") != F.col("p_strand")) | (F.abs(F.col("s_start") - F.col("p_s_end")) > DISJUNCT_DISTANCE)
    kind = (
        F.when(far, "misjoin")
        .when((F.col("dq") - F.col("ds") >= indel) & (F.col("ds") <= indel), "insertion")
        .when((F.col("ds") - F.col("dq") >= indel) & (F.col("dq") <= indel), "deletion")
        .when((F.col("dq") >= indel) & (F.col("ds") >= indel), "gap")
    )
    turned = F.when(F.col("strand") == 0, F.col("s_end") <= F.col("p_s_start")).otherwise(F.col("s_end") >= F.col("p_s_start"))
    found = both.withColumn("kind", F.when(kind.isin("insertion", "gap") & turned, "misjoin").otherwise(kind)).where("kind is not null")
    return found.select(
        key, F.least("p_q_end", "q_start").alias("left"), F.greatest("p_q_end", "q_start").alias("right"), "kind", "dq", "ds",
        "subject", F.least("p_s_end", "s_start").alias("s_left"), F.greatest("p_s_end", "s_start").alias("s_right"), "p_subject", "p_strand", "strand", "p_q_end", "p_s_end", "q_start", "s_start",
    )


def end_insertions(segments: DataFrame, lengths: DataFrame, key: str, length: str, head: int = 3, tail: int = 5) -> DataFrame:
    """(key, left, right, kind): insertions before the first segment and behind the last one of each query."""
    ends = segments.groupBy(key).agg(F.min("q_start").alias("first"), F.max("q_end").alias("last")).join(lengths.select(key, F.col(length).alias("_len")), key)
    before = ends.where(F.col("first") >= head).select(key, F.lit(1).cast("long").alias("left"), F.col("first").cast("long").alias("right"), F.lit("insertion").alias("kind"))
    behind = ends.where(F.col("last") <= F.col("_len") - tail).select(key, F.col("last").cast("long").alias("left"), F.col("_len").cast("long").alias("right"), F.lit("insertion").alias("kind"))
    return before.unionByName(behind)


def merge_misjoins(points: DataFrame, key: str, reach: int = 1000, near: int = 50) -> DataFrame:
    """(key, left, right, n): misjoins merged from left to right while the merged span stays under ``reach`` or nearly touches
    the next one.

    Misjoins that neither test could ever join are parted first: each fold runs over one such cluster, not over a key.
    """
    order = W.partitionBy(key).orderBy("left", "right")
    apart = F.col("left") - F.max("right").over(order.rowsBetween(W.unboundedPreceding, -1)) >= max(reach, near)
    numbered = points.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    spans = numbered.groupBy(key, "_g").agg(F.sort_array(F.collect_list(F.struct(F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), F.lit(1).alias("n")))).alias("_s"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = (x["right"] - last["left"] < reach) | (x["left"] - last["right"] < near)
        both = F.struct(F.least(last["left"], x["left"]).alias("left"), F.greatest(last["right"], x["right"]).alias("right"), (last["n"] + 1).alias("n"))
        return F.when((F.size(done) > 0) & joined, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    merged = F.aggregate(F.slice("_s", 2, F.size("_s")), F.slice("_s", 1, 1), add)
    return spans.select(key, F.explode(merged).alias("_m")).select(key, "_m.left", "_m.right", F.col("_m.n").cast("long").alias("n"))


def misjoin_verdict() -> Column:
    """Over zero, dis, size, high, low, discor, discor_ratio, multi, other and at_end."""
    c = F.col
    first = (c("zero") > 3) | (((c("dis") > 1) | (c("zero") > 0) | (c("high") > 3) | (c("low") > 3)) & (c("discor") >= 3) & (c("discor_ratio") > 0.1))
    second = (c("dis") >= 1) & ((c("zero") > 0) | (c("high") > 0) | (c("low") > 0) | (F.floor(F.try_divide(c("size"), c("dis"))) < 500))
    third = ((c("multi") > 0.1) | (c("other") > 0.1)) & ~c("at_end")
    return _decide(first, second, third, otherwise=UNCERTAIN)


def end_indel_verdict() -> Column:
    """Head and tail: over dis, zero, low, high, pairs, dif (of fragment and insert size), sd and insert."""
    c = F.col
    odd = (c("dis") > 0) | (c("zero") > 0) | (c("low") > 1) | (c("high") > 1) | (c("pairs") == 0)
    shifted = (c("pairs") >= 3) & ((c("dif") > 2 * c("sd")) | (c("dif") > 0.2 * c("insert")))
    return _decide(odd, shifted, otherwise=UNCERTAIN)


def middle_indel_verdict(kind: Column | None = None) -> Column:
    """Middle: over dis, zero, low, high, size, pairs_left, pairs_right, ratio_left, ratio_right, dif_all,
    discor_bins, multi_bins, sd and insert. A ``kind`` other than insertion, deletion and gap stays uncertain unless
    coverage is missing or pairs are too few."""
    c = F.col
    either = lambda t: (c("ratio_left") > t) | (c("ratio_right") > t)
    odd = (c("dis") > 0) | (c("zero") > 0) | (c("low") > 1) | (c("high") > 1)
    closer = ((c("dif_all") < c("sd")) | (c("dif_all") < 0.1 * c("insert"))) & ((c("discor_bins") > 0) | (c("multi_bins") > 0))
    near = (c("dif_all") < 2 * c("sd")) | (c("dif_all") < 0.2 * c("insert")) | either(0.1)
    near_true = odd | either(0.2) | (either(0.1) & ((c("low") > 0) | (c("high") > 0) | closer)) | ((c("ratio_left") > 0.05) & (c("ratio_right") > 0.05) & (c("multi_bins") > 0))
    uneven = (c("low") > 0) | (c("high") > 0)
    return (
        F.when((c("zero") > 0) | (c("pairs_left") < 3) | (c("pairs_right") < 3), TRUE)
        .when(~F.coalesce((F.lit("gap") if kind is None else kind).isin("insertion", "deletion", "gap"), F.lit(False)), UNCERTAIN)
        .when(near, F.when(near_true, TRUE).otherwise(UNCERTAIN))
        .when(c("dis") > 0, F.when((F.floor(F.try_divide(c("size"), c("dis"))) < 1000) | uneven, TRUE).otherwise(UNCERTAIN))
        .when(uneven & ((c("zero") > 0) | (c("discor_bins") > 0) | (c("multi_bins") > 0)), TRUE)
        .otherwise(UNCERTAIN)
    )


def whole_verdict() -> Column:
    """A query without any segment: over pairs_left, pairs_right, t_dis, t_zero and discor_bins of its tiles."""
    c = F.col
    return _decide((c("pairs_left") == 0) | (c("pairs_right") == 0) | (c("t_dis") >= 3) | (c("t_zero") > 0) | (c("discor_bins") > 0), otherwise=UNCERTAIN)


def sv_misjoin() -> Column:
    return F.when((F.col("dis") >= 3) | (F.col("zero") > 0) | (F.col("discor_bins") >= 1), UNCERTAIN).otherwise(SV)


def sv_indel() -> Column:
    c = F.col
    evidence = (c("zero") > 0) | (c("discor_bins") > 0)
    moved = (c("dif") > 2 * c("sd")) | (c("dif") > 0.2 * c("insert"))
    open_ = (evidence & moved) | (c("dis") >= 2) | ((c("dis") == 1) & (c("size") < 300) & evidence)
    return F.when(open_, UNCERTAIN).otherwise(SV)


def query_verdict(regions: DataFrame, key: str) -> DataFrame:
    """TRUE if any misjoin is, or any indel that is no gap."""
    hit = (F.col("verdict") == TRUE) & ((F.col("kind") == "misjoin") | ~F.col("in_gap"))
    return regions.groupBy(key).agg(F.max(F.when(hit, 1).otherwise(0)).alias("_t")).select(key, F.when(F.col("_t") == 1, TRUE).otherwise(UNCERTAIN).alias("verdict"))


def result_label() -> Column:
    """errors, sv, gap or warning by verdict, kind and in_gap."""
    return F.when((F.col("verdict") == TRUE) & F.col("in_gap") & (F.col("kind") != "misjoin"), "gap").when(F.col("verdict") == TRUE, "errors").when(F.col("verdict") == SV, "sv").otherwise("warning")


def result_regions(regions: DataFrame) -> DataFrame:
    """(rid, key, result, mis_kind, q_start, q_end, s_start, s_end, subject) of judged regions with rid, key, shape, kind, left, right, len, dq, ds, in_gap,
    verdict, subject, s_left and s_right.

    A head region goes from the query's begin, a tail one to its end. A gap between segments is an insertion if the query's step is the
    longer one, else a deletion. Only indels inside or between segments have a place on a subject.
    """
    c = F.col
    placed = c("shape").isin("middle", "inner") & (c("kind") != "misjoin")
    kind = F.when((c("kind") == "gap") & (c("dq") > c("ds")), "insertion").when(c("kind") == "gap", "deletion").otherwise(c("kind"))
    result = result_label()
    prefix = F.when(result == "errors", "err").when(result == "warning", "uncertain").otherwise(result)
    lo = F.when((c("shape") == "head") & (c("kind") != "misjoin"), 1).when((c("shape") == "tail") & (c("kind") != "misjoin"), c("right")).otherwise(F.least("left", "right"))
    hi = F.when((c("shape") == "head") & (c("kind") != "misjoin"), c("left")).when((c("shape") == "tail") & (c("kind") != "misjoin"), c("len")).otherwise(F.greatest("left", "right"))
    return regions.select(
        "rid", "key", result.alias("result"), F.concat_ws("_", prefix, kind).alias("mis_kind"), lo.cast("long").alias("q_start"), hi.cast("long").alias("q_end"),
        *[F.when(placed, c(x)).alias(y) for x, y in (("s_left", "s_start"), ("s_right", "s_end"), ("subject", "subject"))],
    )


def split_pieces(cuts: DataFrame, sequences: DataFrame, key: str, length: str) -> DataFrame:
    """(key, piece, lo, hi) of sequences cut at misjoins [left, right]; both sides keep the span of a cut."""
    w = W.partitionBy(key).orderBy("left", "right")
    begin = cuts.select(key, F.row_number().over(w).alias("piece"), F.coalesce(F.lag("left").over(w), F.lit(1)).cast("long").alias("lo"), F.col("right").cast("long").alias("hi"))
    ends = cuts.groupBy(key).agg((F.count("*") + 1).cast("int").alias("piece"), F.max_by("left", F.struct("left", "right")).cast("long").alias("lo"))
    last = ends.join(sequences.select(key, F.col(length).cast("long").alias("hi")), key)
    return begin.unionByName(last)

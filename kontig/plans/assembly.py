"""The fixed stages of an assembly assessment as DataFrame plans: metrics, then validation and correction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontig.functions.sequences import count_of, has_gap, read_valid, reverse_complement
from kontig.operators import alignment, chaining, evidence, intervals, kmers, lengths, mapping, pileup, verdicts
from kontig.params import INDEL_SIZE, MIN_QUERY_LEN
from kontig.plans.stages import Stages


@dataclass
class Metrics:
    lengths: DataFrame
    kinds: DataFrame
    best: DataFrame
    gc: DataFrame


def metrics(queries: DataFrame, references: DataFrame, items: DataFrame, min_len: int = MIN_QUERY_LEN) -> Metrics:
    """queries (query_id, seq, len), references (seq, len), items: aligned segments with ids and query_len."""
    long = queries.where(F.col("len") >= min_len)
    pairs = chaining.classify_pairs(items.join(long.select("query_id"), "query_id", "left_semi"))
    best = chaining.best_subject(pairs, "query_id", "subject_id", "kind", "match_sum")
    kinds = long.select("query_id", "len").join(best, "query_id", "left").withColumn("kind", F.coalesce("kind", F.lit(chaining.UNMATCHED)))
    total = references.agg(F.sum("len")).first()[0] or 0  # one number
    return Metrics(lengths.length_metrics(queries, "len", min_len), lengths.accuracy_by_kind(kinds, "kind", "len", total), kinds, _gc(references))


def _gc(references: DataFrame) -> DataFrame:
    return references.agg(F.try_divide(F.sum(count_of(F.col("seq"), "GCgc")), F.sum(count_of(F.col("seq"), "ACGTacgt"))).alias("gc"))


def correct(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, piece, title, seq): queries cut at their true misjoins; others unchanged as piece 0."""
    cuts = regions.where((F.col("kind") == "misjoin") & (F.col("verdict") == verdicts.TRUE)).select("query_id", "left", "right")
    pieces = verdicts.split_pieces(cuts, queries, "query_id", "len").join(queries.select("query_id", "title", "seq"), "query_id")
    seq = F.substr("seq", F.col("lo").cast("int"), (F.col("hi") - F.col("lo") + 1).cast("int"))
    cut = pieces.select("query_id", F.col("piece").cast("int").alias("piece"), F.concat_ws("_", "title", F.col("piece").cast("string"), F.col("lo").cast("string"), F.col("hi").cast("string")).alias("title"), seq.alias("seq"))
    whole = queries.join(cuts.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(0).alias("piece"), "title", "seq")
    return cut.unionByName(whole)


@dataclass
class Alignment:
    kinds: DataFrame
    segments: DataFrame


def align_queries(queries: DataFrame, items: DataFrame, stages: Stages, min_len: int = MIN_QUERY_LEN) -> Alignment:
    """Kinds (query_id, len, kind, subject_id) and segments of queries (query_id, len) from their aligned items, over all subjects.

    Items of a query and a subject are chained; the best subject's chain stands for the query and its holes are covered by the chains of
    other subjects. The kind is the one over all subjects. Items have subject_len if subjects are circular.
    """
    long = queries.where(F.col("len") >= min_len)
    kept = items.join(long.select("query_id"), "query_id", "left_semi")
    judged = stages.write(chaining.judged_chains(kept), "chains")
    pairs, chains = judged.where("ord = 1").select("query_id", "subject_id", "kind", "match_sum"), judged.drop("kind", "match_sum")
    best = chaining.best_subject(pairs, "query_id", "subject_id", "kind", "match_sum")
    mine = chains.join(best.select("query_id", "subject_id"), ["query_id", "subject_id"], "left_semi")
    pool = chaining.other_subjects(chains, best, "query_id", "subject_id").drop("ord")
    perfect = best.where(F.col("kind") == chaining.PERFECT).select("query_id")
    segments = stages.write(chaining.fill_holes(mine, pool.join(perfect, "query_id", "left_anti")), "segments")
    spans = segments.select("query_id", F.col("q_start").alias("lo"), F.col("q_end").alias("hi"))
    good = F.count_if(F.col("match_len") > chaining.identity_threshold(F.col("query_len")) * F.col("total_len"))
    sums = segments.groupBy("query_id", "subject_id").agg(good.alias("good"), F.sum("total_len").alias("total"), F.max("query_len").alias("query_len"))
    each = sums.join(pairs, ["query_id", "subject_id"]).join(intervals.covered(spans, "query_id"), "query_id").withColumnRenamed("match_sum", "weight")
    kinds = long.select("query_id", "len").join(chaining.global_kind(each), "query_id", "left").join(best.select("query_id", "subject_id"), "query_id", "left")
    return Alignment(kinds.withColumn("kind", F.coalesce("kind", F.lit(chaining.UNMATCHED))), segments)


_REGION = ("key", "shape", "kind", "left", "right", "dq", "ds", "subject", "s_left", "s_right", "in_gap")


def candidates(kinds: DataFrame) -> DataFrame:
    """Queries (query_id, len, kind) that may hold an error: all but the perfect ones, the longest two marked by ``rank``."""
    longest = [r.query_id for r in kinds.orderBy(F.desc("len"), "query_id").limit(2).collect()]
    rank = F.lit(0)
    for i, query in enumerate(longest, 1):
        rank = F.when(F.col("query_id") == query, i).otherwise(rank)
    return kinds.where(F.col("kind") != chaining.PERFECT).withColumn("rank", rank)


def find_regions(queries: DataFrame, segments: DataFrame, inner: DataFrame | None = None, subjects: DataFrame | None = None, indel: int = INDEL_SIZE) -> DataFrame:
    """Regions of queries (key, seq, len) to judge, with their ids: breaks between segments, ends and whole queries without segments.

    ``segments`` have key, subject, strand, q_start, q_end, s_start and s_end; ``inner`` are indels inside segments as ``alignment.inner_indels`` gives
    them. With ``subjects`` (subject, seq) the margins of misjoins between overlapping segments are refined. Neighbouring misjoins are merged. The id of a region follows from its query and its place there.
    """
    points = verdicts.breakpoints(segments, "key", ("q_start", "q_end", "s_start", "s_end"), indel).withColumn("shape", F.lit("middle"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    subject = segments.schema["subject"].dataType
    bare = [*none("long", "dq", "ds"), *none(subject, "subject"), *none("long", "s_left", "s_right")]
    apart = points.where("kind = 'misjoin'")
    if subjects is not None:
        apart = alignment.refine_margins(apart, queries, subjects)
    joins = verdicts.merge_misjoins(apart, "key").select("key", F.lit("middle").alias("shape"), F.lit("misjoin").alias("kind"), "left", "right", *bare)
    ends = verdicts.end_insertions(segments, queries, "key", "len")
    head = F.col("left") == 1
    # the margins of an end are the segment's last position and the one beyond it
    ends = ends.select("key", F.when(head, "head").otherwise("tail").alias("shape"), "kind", F.when(head, F.col("right") - 1).otherwise(F.col("left")).alias("left"), F.when(head, F.col("right")).otherwise(F.col("left") + 1).alias("right"), *bare)
    alone = queries.join(segments.select("key").distinct(), "key", "left_anti").select("key", F.lit("whole").alias("shape"), F.lit("insertion").alias("kind"), F.lit(1).cast("long").alias("left"), F.col("len").cast("long").alias("right"), *bare)
    columns = list(_REGION[:-1])
    found = points.where("kind != 'misjoin'").select(*columns).unionByName(joins).unionByName(ends).unionByName(alone)
    if inner is not None:
        found = found.unionByName(inner.select(*columns))
    located = found.join(queries.select("key", "seq", F.col("len").cast("long").alias("len")), "key")
    gap = (F.col("shape").isin("middle", "inner")) & has_gap(F.col("seq"), F.least("left", "right").cast("int"), F.greatest("left", "right").cast("int"))
    rid = F.xxhash64("key", "shape", "kind", "left", "right")
    return located.select(rid.alias("rid"), "len", *columns, F.coalesce(gap, F.lit(False)).alias("in_gap")).dropDuplicates(["rid"])


def gather_evidence(regions: DataFrame, lengths: DataFrame, coverage: DataFrame, placements: DataFrame, insert: float, sd: float, stages: Stages, single_cell: bool = False) -> DataFrame:
    """``regions`` with their evidence, in one pass over the coverage (key, pos, alleles, total, or stretches of it with ``next``) and the placed reads' mates by parts of the queries (another for junctions).

    Adds, zero where nothing was found: dis, zero, size, high and low of the evidence window; pairs, frag and ratio on the left and right;
    t_dis, t_zero, discor_bins and multi_bins of the tiles; discor, discor_ratio, multi and other of a junction; and what the check for structural
    variation looks at, with ``sv_`` before the name.
    """
    stretches = stages.write(evidence.stretches_of(coverage), "coverage")
    mates = stages.write(evidence.placed_mates(placements, insert, sd), "mates")
    facts = evidence.part_facts(stretches, evidence.query_means(stretches, lengths), mates)
    sums = evidence.region_sums(regions, facts, insert, single_cell)
    ratio = lambda x, side: F.coalesce(F.try_divide(F.col(f"{x}_{side}").cast("double"), f"pairs_{side}"), F.lit(0.0))
    named = lambda side: (("sv_", side[3:]) if side.startswith("sv_") else ("", side))
    columns = [x for x in evidence.SUMS if not x.startswith(("pairs_", "bases_", "odd_"))]
    for side in evidence.SIDES:
        prefix, of = named(side)
        columns += [F.col(f"pairs_{side}").alias(f"{prefix}pairs_{of}"), ratio("bases", side).alias(f"{prefix}frag_{of}"), ratio("odd", side).alias(f"{prefix}ratio_{of}")]
    junctions = evidence.junction_evidence(mates, evidence.junction_windows(regions))
    out = regions.join(sums.select("rid", *columns), "rid", "left").join(junctions, "rid", "left")
    return out.na.fill(0, [x for x in out.columns if x not in regions.columns])


def judge(regions: DataFrame, insert: float, sd: float) -> DataFrame:
    """Regions with evidence and their ``verdict``: true, uncertain or sv."""
    c = F.col
    dif_left, dif_right = F.when(c("pairs_left") > 0, c("frag_left") - insert).otherwise(0.0), F.when(c("pairs_right") > 0, c("frag_right") - insert).otherwise(0.0)
    pairs = F.when(c("shape") == "head", c("pairs_left")).otherwise(c("pairs_right"))
    dif = F.abs(F.when(c("shape") == "head", dif_left).otherwise(dif_right))
    ready = regions.withColumns({
        "sd": F.lit(float(sd)), "insert": F.lit(float(insert)), "pairs": pairs, "dif": dif, "dif_all": F.abs(c("dq") - c("ds") - (dif_left + dif_right) / 2),
        "at_end": (F.least("left", "right") < 200) | (F.greatest("left", "right") > c("len") - 200),
    })
    misjoin, shape = c("kind") == "misjoin", c("shape")
    first = F.when(misjoin, verdicts.misjoin_verdict()).when(shape.isin("head", "tail"), verdicts.end_indel_verdict()).when(shape == "whole", verdicts.whole_verdict()).otherwise(verdicts.middle_indel_verdict(c("kind")))
    judged = ready.withColumn("verdict", first)
    # without any pair an average fragment counts as 0 there, as the missing side does
    moved = F.when((c("sv_pairs_left") > 0) | (c("sv_pairs_right") > 0), F.abs((c("sv_frag_left") + c("sv_frag_right")) / 2 - insert)).otherwise(0.0)
    again = {"dis": c("sv_t_dis"), "zero": c("sv_t_zero"), "discor_bins": c("sv_discor_bins"), "dif": moved}
    checked = judged.select("*", *[c(x).alias(f"_{x}") for x in again]).withColumns(again)
    sv = F.when(c("verdict") != verdicts.UNCERTAIN, c("verdict")).when(misjoin, verdicts.sv_misjoin()).otherwise(verdicts.sv_indel())
    return checked.withColumns({"verdict": sv, **{x: c(f"_{x}") for x in again}}).select(*regions.columns, "verdict")


@dataclass
class Validation:
    regions: DataFrame
    results: DataFrame
    queries: DataFrame
    corrected: DataFrame


def validate(queries: DataFrame, segments: DataFrame, coverage: DataFrame, placements: DataFrame, insert: float, sd: float, stages: Stages, inner: DataFrame | None = None, subjects: DataFrame | None = None, single_cell: bool = False, indel: int = INDEL_SIZE) -> Validation:
    """From aligned segments and placed reads to judged regions, result rows, verdicts of queries (key, title, seq, len) and the corrected
    assembly. Each stage is a written table that the next ones read."""
    regions = stages.write(find_regions(queries, segments, inner, subjects, indel), "regions")
    gathered = stages.write(gather_evidence(regions, queries.select("key", "len"), coverage, placements, insert, sd, stages, single_cell), "evidence")
    judged = stages.write(judge(gathered, insert, sd), "judged")
    renamed = lambda df: df.withColumnRenamed("key", "query_id")
    return Validation(judged, verdicts.result_regions(judged), verdicts.query_verdict(judged, "key"), correct(renamed(queries), renamed(judged)))


#: Positions of a query that one row's bits stand for, set where a read covers one.
MASK_BIN = 62


def _masks(spans: DataFrame) -> DataFrame:
    """``spans`` (key, start, size) once for each MASK_BIN that they reach into, with ``_mask``, the bits of their positions there."""
    first, last = F.col("start") - 1, F.col("start") + F.col("size") - 2
    bins = spans.where("size > 0").withColumn("_bin", F.explode(F.sequence(F.floor(first / MASK_BIN), F.floor(last / MASK_BIN))))
    bits = f"shiftleft(shiftleft(1L, cast(least(start + size - 2 - _bin * {MASK_BIN}, {MASK_BIN - 1}) - greatest(start - 1 - _bin * {MASK_BIN}, 0) + 1 as int)) - 1L, cast(greatest(start - 1 - _bin * {MASK_BIN}, 0) as int))"
    return bins.withColumn("_mask", F.expr(bits))


def uncovered(hits: DataFrame, placed: DataFrame) -> DataFrame:
    """(key, start, size, zero): positions under each hit that no placed read covers; a row of bits stands for MASK_BIN positions, no row is made for a position."""
    held = _masks(placed.select("key", "start", "size")).groupBy("key", "_bin").agg(F.bit_or("_mask").alias("_held"))
    pieces = _masks(hits.select("key", "start", "size").distinct()).join(held, ["key", "_bin"], "left")
    covered = F.sum(F.bit_count(F.col("_mask").bitwiseAND(F.coalesce("_held", F.lit(0).cast("long")))))
    return pieces.groupBy("key", "start", "size").agg((F.col("size") - covered).cast("long").alias("zero"))


def choose_twice(hits: DataFrame, mated: DataFrame, queries: DataFrame, stages: Stages) -> DataFrame:
    """Placements of a first pass that takes what is unambiguous, and of a second one over the reads left, by what the first left uncovered.

    Nothing is looked up in ``queries`` (key, len): hits lie within them.
    """
    first = stages.write(mapping.choose(hits, mated), "placed")
    left = mapping.not_yet_placed(hits, first, "read_id")
    pairs = first.select(mapping.pair_id(F.col("read_id")).alias("pair")).distinct()
    # a pair with one mate placed has no mated hits any more: the other mate is chosen on its own
    again = mapping.choose(left, mated.join(pairs, "pair", "left_anti"), uncovered(left, first))
    return first.unionByName(again)


@dataclass
class Placed:
    placements: DataFrame
    coverage: DataFrame
    insert: float
    sd: float


def place_reads(reads: DataFrame, queries: DataFrame, stages: Stages, insert: float | None = None, sd: float | None = None) -> Placed:
    """Reads (read_id, seq; mates are 2p - 1 and 2p) placed on queries (key, seq, len) in two passes, and their coverage.

    The insert size is estimated if not given; without any pair to estimate it from that is an error. Invalid reads are not placed.
    """
    valid = reads.where(read_valid(F.col("seq")))
    hits = stages.write(kmers.extended(valid, queries, "read_id", "key", length="len").select("read_id", "key", "strand", "start", "size", (F.col("start") - F.col("diag") - 1).alias("skip"), "mismatches", "len"), "hits")
    if insert is None or sd is None:
        row = mapping.insert_size(mapping.facing_fragments(hits), "pair", "frag").first()  # one row
        if row is None:
            raise ValueError("no pair has one facing placement, so the insert size is unknown")
        insert, sd = row["mean"], row["sd"]
    mated = stages.write(mapping.mated_hits(hits, insert, sd), "mated")
    mated = stages.write(mated.unionByName(mapping.rescued_mates(hits, mated, valid, queries, insert, sd)), "pairs")
    placed = stages.write(choose_twice(hits, mated, queries, stages), "placements")
    placements = placed.select("read_id", "key", F.col("start").alias("pos"), F.col("strand").alias("orient"), F.col("len").alias("size"), "multi")
    return Placed(placements, coverage_of(placed, valid), insert, sd)


def coverage_of(placed: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, pos, a, c, g, t, n, total) of placed reads, from their bases as they lie on the query."""
    turned = placed.join(reads.select("read_id", "seq"), "read_id").withColumn("_seq", F.when(F.col("strand") == 0, F.col("seq")).otherwise(reverse_complement(F.col("seq"))))
    bases = turned.select("key", "start", F.posexplode(F.split(F.substr("_seq", (F.col("skip") + 1).cast("int"), F.col("size").cast("int")), "")).alias("_i", "base"))
    return pileup.allele_coverage(bases.where("base != ''").select("key", (F.col("start") + F.col("_i")).cast("long").alias("pos"), "base"), "key", "pos", "base")

"""k-mer index: tiling, counts, postings, probing and seeds on a diagonal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.functions.sequences import reverse_complement
from kontig.params import KMER, MISMATCH_RATIO, OVERHANG_RATIO


#: Bases of a block that sequences are cut into before their k-mers are taken.
BLOCK = 256
#: Bases of a block of a target that placements are compared with, if no read is longer.
TARGET_BLOCK = 4_096


def runs(df: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, at, run): the maximal ACGT runs of each sequence and the bases before them."""
    cut = df.select(key, F.posexplode(F.regexp_extract_all(seq, F.lit("[ACGTacgt]+|[^ACGTacgt]+"), F.lit(0))).alias("_i", "run"))
    order = W.partitionBy(key).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("at", F.coalesce(F.sum(F.length("run")).over(order), F.lit(0)).cast("long"))
    return placed.where(F.col("run").rlike("^[ACGTacgt]")).select(key, "at", "run")


def tiles(df: DataFrame, key: str, seq: str, k: int = KMER, step: int | None = None) -> DataFrame:
    """(key, pos, kmer): k-mers of each sequence at stride ``step`` (k if none) and, at that stride, one that ends it.

    Sequences are cut into blocks first, each with the k - 1 bases behind it, as taking a substring walks from the
    begin: the work grows with the length, not with its square. Null and shorter sequences have no k-mer.
    Tile the ``runs`` of sequences with unknown bases.
    """
    stride = step or k
    size = stride * -(-BLOCK // stride)
    named = df.select(key, F.col(seq).alias("_s"))
    pieces = named.select(key, F.length("_s").alias("_n"), F.regexp_extract_all("_s", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_b"))
    behind = F.transform("_b", lambda b, i: F.struct(b.alias("own"), F.substring(F.coalesce(F.get("_b", i + 1), F.lit("")), 1, k - 1).alias("next")))
    # outer, as a filter for what is exploded would make every sequence and its blocks once more; shorter sequences fall out by ``_last``
    blocks = pieces.select(key, "_n", F.posexplode_outer(behind).alias("_i", "_p"))
    left = F.col("_n") - F.col("_i") * size - k + 1
    blocks = blocks.select(key, (F.col("_i") * size).alias("_at"), F.concat("_p.own", "_p.next").alias("_t"), F.least(F.lit(size), left).cast("int").alias("_last"), (left <= size).alias("_ends"))
    offsets = F.sequence(F.lit(1), F.col("_last"), F.lit(stride))
    if step is None:
        offsets = F.when(F.col("_ends") & ((F.col("_last") - 1) % stride != 0), F.concat(offsets, F.array("_last"))).otherwise(offsets)
    starts = blocks.where("_t is not null and _last >= 1").select(key, "_at", "_t", F.explode(offsets).alias("_o"))
    return starts.select(key, (F.col("_at") + F.col("_o")).cast("long").alias("pos"), F.substr("_t", F.col("_o"), F.lit(k)).alias("kmer"))


def counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("kmer").agg(F.count("*").alias("n"))


def postings(kmers: DataFrame, key: str) -> DataFrame:
    """(kmer, n, list): the places of each k-mer in order, as key:pos joined by blanks."""
    place = F.struct(F.col(key), F.col("pos"))
    listed = kmers.groupBy("kmer").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(place)).alias("_p"))
    text = F.transform("_p", lambda p: F.concat_ws(":", p[key].cast("string"), p["pos"].cast("string")))
    return listed.select("kmer", "n", F.array_join(text, " ").alias("list"))


def posting_blocks(kmers: DataFrame, key: str, size: int = 4_096) -> DataFrame:
    """(kmer, block, n, list): as ``postings``, the places of a k-mer with more than ``size`` of them dealt by their positions to enough blocks.

    Only the frequent k-mers, which are few (a row for each ``size`` places at most), are joined back to their places.
    """
    often = kmers.groupBy("kmer").agg(F.count("*").alias("_n")).where(F.col("_n") > size).select("kmer", F.ceil(F.col("_n") / size).cast("long").alias("_blocks"))
    dealt = kmers.join(often, "kmer", "left").withColumn("block", F.coalesce(F.pmod(F.col("pos") + F.col(key), F.col("_blocks")), F.lit(0)).cast("long"))
    listed = dealt.groupBy("kmer", "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(F.col(key), F.col("pos")))).alias("_p"))
    text = F.transform("_p", lambda p: F.concat_ws(":", p[key].cast("string"), p["pos"].cast("string")))
    return listed.select("kmer", "block", "n", F.array_join(text, " ").alias("list"))


def probe(reads: DataFrame, index: DataFrame) -> DataFrame:
    """Equi-join of read k-mers (offset) with indexed ones (pos) and the diagonal of each hit."""
    return reads.join(index, "kmer").withColumn("diag", F.col("pos") - F.col("offset"))


def seeds(hits: DataFrame, read: str, target: str, at_least: int = 2) -> DataFrame:
    """(read, target, diag, n) of diagonals with enough hits."""
    return hits.groupBy(read, target, "diag").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def exact_hits(hits: DataFrame, reads: DataFrame, read: str, target: str) -> DataFrame:
    """Diagonals on which all k-mers of the read hit: the read occurs there without mismatch."""
    asked = reads.groupBy(read).agg(F.countDistinct("offset").alias("asked"))
    found = hits.groupBy(read, target, "diag").agg(F.countDistinct("offset").alias("n"))
    return found.join(asked, read).where("n = asked").select(read, target, "diag", "n")


def _rarest(reads: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """(*by, offset, kmer): of the read k-mers (by, offset) of each group those at the offset that has the fewest places in the index; none where these are none."""
    known = reads.join(counts(index), "kmer", "left").select(*by, "offset", "kmer", F.coalesce("n", F.lit(0)).alias("n"))
    each = known.groupBy(*by, "offset").agg(F.sum("n").alias("_n"), F.collect_list("kmer").alias("_kmers"))  # one k-mer, unless a read's name is not its own
    best = each.groupBy(*by).agg(F.min_by(F.struct("offset", "_kmers", "_n"), F.struct("_n", "offset")).alias("_b"))
    return best.where("_b._n > 0").select(*by, F.col("_b.offset").alias("offset"), F.explode("_b._kmers").alias("kmer"))


def exact_tiles(reads: DataFrame, index: DataFrame, read: str, target: str) -> DataFrame:
    """As ``exact_hits`` of a probe: only the places of each read's rarest k-mer are followed, and its other k-mers sought there, so that frequent ones are not paired."""
    asked = reads.groupBy(read).agg(F.countDistinct("offset").alias("asked"))
    there = index.groupBy(target).agg(F.count("*").alias("_there"))
    begun = probe(_rarest(reads, index, [read]), index).select(read, target, "diag").distinct().join(asked, read)
    begun = begun.join(there, target).where("asked <= _there").select(read, target, "diag")  # a target with fewer k-mers than the read holds none
    sought = begun.join(reads.select(read, "offset", "kmer"), read).select(read, target, "diag", (F.col("diag") + F.col("offset")).alias("pos"), "kmer")
    found = sought.join(index.select(target, "pos", "kmer"), [target, "pos", "kmer"])
    counted = found.groupBy(read, target, "diag").agg(F.countDistinct("pos").alias("n"))
    return counted.join(asked, read).where("n = asked").select(read, target, "diag", "n")


def blocks(df: DataFrame, key: str, seq: str, size: int, overlap: int) -> DataFrame:
    """(key, block, text, n): each sequence of n bases in blocks of ``size``, from 0, each with the ``overlap`` <= size bases behind it."""
    pieces = df.where(F.length(seq) > 0).select(key, F.length(seq).cast("long").alias("n"), F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("_b"))
    whole = F.transform("_b", lambda b, i: F.concat(b, F.substring(F.coalesce(F.get("_b", i + 1), F.lit("")), 1, overlap)))
    return pieces.select(key, "n", F.posexplode(whole).alias("block", "text"))


def _block_size(reads: DataFrame, seq: str) -> int:
    """Bases of a block that any read's overlap with a target lies in, together with the block behind."""
    return max(TARGET_BLOCK, reads.agg(F.max(F.length(seq))).first()[0] or 0)  # one number


def _begun(asked: DataFrame, index: DataFrame, key: str, k: int) -> DataFrame:
    """(read, key, diag) where one k-mer of the reads (read, _r) of 2k - 1 bases or more is in the index of tiles: with every whole occurrence, and few others."""
    anchors = tiles(asked.select("read", "_r"), "read", "_r", k, 1).withColumnRenamed("pos", "offset").withColumn("_set", F.col("offset") % k)
    return probe(_rarest(anchors, index, ["read", "_set"]), index).where("diag >= 0").select("read", key, "diag").distinct()


def exact_places(reads: DataFrame, targets: DataFrame, key: str, seq: str, k: int = KMER) -> DataFrame:
    """(read, key, diag, size): every place where a whole read of k bases or more occurs, ``diag`` bases behind the begin.

    A read of 2k - 1 or more covers tiles of the target wherever it occurs: those at every k-th of its offsets, from one of the first k on. For each of these k
    sets the rarest of its k-mers is sought among the tiles; shorter reads are sought so by k-mers of half the length. Each place found is compared
    over the whole length of the read with the block of the target that holds it.
    """
    asked = reads.where(F.length(seq) >= k).select(F.col(key).alias("read"), F.col(seq).alias("_r"), F.length(seq).cast("long").alias("size"))
    found = _begun(asked.where(f"size >= {2 * k - 1}"), tiles(targets, key, seq, k), key, k)
    short = asked.where(f"size < {2 * k - 1}")
    if not short.isEmpty():
        half = (k + 1) // 2
        found = found.unionByName(_begun(short, tiles(targets, key, seq, half), key, half))
    size = _block_size(asked, "_r")
    placed = found.join(asked, "read").withColumn("block", F.floor(F.col("diag") / size).cast("int")).join(blocks(targets, key, seq, size, size), [key, "block"])
    return placed.where(F.substr("text", (F.col("diag") % size + 1).cast("int"), F.col("size").cast("int")) == F.col("_r")).select("read", key, "diag", "size")


def extended(reads: DataFrame, targets: DataFrame, read: str, target: str, seq: str = "seq", k: int = KMER, length: str | None = None) -> DataFrame:
    """(read, target, strand, diag, start, size, mismatches): placements of whole reads without gaps, on both strands.

    Each k-mer of a read, and of its reverse complement (strand 1), probes the target's tiles; each diagonal found is compared over
    its whole overlap once, with the block of the target in which the overlap begins. A placement has at most ``MISMATCH_RATIO`` mismatches to the read's
    length (a last column, if it is named) and hangs over the target's ends by at most ``OVERHANG_RATIO`` of it. Mismatches at either end of the
    overlap are trimmed from ``start`` (on the target), ``size`` and ``mismatches``; they count for acceptance.
    """
    named = reads.select(F.col(read).alias("_read"), F.col(seq).alias("_seq"))
    both = named.withColumn("_strand", F.lit(0)).unionByName(named.select("_read", reverse_complement(F.col("_seq")).alias("_seq"), F.lit(1).alias("_strand")))
    both = both.withColumn("_key", F.struct("_read", "_strand"))
    anchors = tiles(both, "_key", "_seq", k, 1).withColumnRenamed("pos", "offset")
    found = probe(anchors, tiles(targets, target, seq, k)).select("_key", target, "diag").distinct()
    block = _block_size(reads, seq)
    first = F.greatest(F.lit(1).cast("long"), 1 - F.col("diag"))
    placed = found.join(both.select("_key", "_seq"), "_key").withColumns({"_first": first, "block": F.floor((first + F.col("diag") - 1) / block).cast("int")})
    placed = placed.join(blocks(targets, target, seq, block, block), [target, "block"])
    last = F.least(F.length("_seq"), F.col("n") - F.col("diag"))
    cut = placed.select("_key", target, "diag", F.length("_seq").alias("_n"), "_first", (last - F.col("_first") + 1).cast("int").alias("_size"), "_seq", "text", (F.col("_first") + F.col("diag") - F.col("block") * block).cast("int").alias("_at"))
    cut = cut.where(F.col("_n") - F.col("_size") <= F.floor(OVERHANG_RATIO * F.col("_n")))
    cut = cut.withColumns({"_a": F.substr("_seq", F.col("_first").cast("int"), F.col("_size")), "_b": F.substr("text", F.col("_at"), F.col("_size"))})
    marks = F.array_join(F.zip_with(F.split("_a", ""), F.split("_b", ""), lambda x, y: F.when(x == y, "0").otherwise("1")), "")
    marked = cut.withColumn("_m", marks).withColumn("_all", F.length(F.translate("_m", "0", ""))).where(F.col("_all") <= F.floor(MISMATCH_RATIO * F.col("_n")))
    head, tail = F.length(F.regexp_extract("_m", "^1*", 0)), F.length(F.regexp_extract("_m", "1*$", 0))
    return marked.select(
        F.col("_key._read").alias(read), target, F.col("_key._strand").alias("strand"), "diag", (F.col("_first") + F.col("diag") + head).cast("long").alias("start"),
        (F.col("_size") - head - tail).cast("long").alias("size"), (F.col("_all") - head - tail).cast("long").alias("mismatches"), *([F.col("_n").cast("long").alias(length)] if length else []),
    )

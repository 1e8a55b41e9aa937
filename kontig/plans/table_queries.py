"""Every operator bound to the driver's tables, with SQL that DuckDB runs to check it.

The tables stand in for assembly data: documents are queries (their text as a sequence over ACGT),
benchmark items are subjects, events are reads (mates by parity of event_id), a line item is an
interval from its ship date over as many days as its quantity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kontig.functions import sequences as sq
from kontig.operators import alignment, chaining, evidence, intervals, kmers, lengths, mapping, pileup, reference, verdicts
from kontig.plans import assembly, tracks
from kontig.plans.stages import Stages
from kontig.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The sequence of a text in SQL.
_DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", "lang", sq.dna(F.col("text")).alias("seq"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", sq.dna(F.col("text")).alias("seq"))


def _day(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """(k, row, lo, hi, flag): line items as day intervals under their supplier."""
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), row.alias("row"), _day("l_shipdate").alias("lo"), (_day("l_shipdate") + F.floor("l_quantity").cast("long") - 1).alias("hi"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("o"))


_SPANS = """spans AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS row, l_orderkey AS o, l_returnflag AS flag,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS lo,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(floor(l_quantity) AS BIGINT) - 1 AS hi FROM lineitem)"""
_ISLANDS = f"""WITH {_SPANS}, m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + TOUCH THEN 0 ELSE 1 END AS nw FROM spans),
isl AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m)"""


# lengths and metrics


@query(
    """WITH q AS (SELECT n_chars AS l, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER () AS s,
    row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER () AS n FROM documents WHERE n_chars >= 100)
    SELECT max(n) AS cnt, CAST(max(s) AS BIGINT) AS total, max(l) AS longest, round(max(s) / max(n), 6) AS mean, max(l) FILTER (WHERE 2 * c >= s) AS n50, max(l) FILTER (WHERE r = n // 2 + 1) AS median FROM q"""
)
def seq_length_metrics(spark: SparkSession, d: str) -> DataFrame:
    return lengths.length_metrics(t(spark, d, "documents"), "n_chars")


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, doc_id, n_chars FROM documents")
def seq_sorted_rank(spark: SparkSession, d: str) -> DataFrame:
    return lengths.ranked_by_length(t(spark, d, "documents"), "doc_id", "n_chars")


@query(
    """WITH k(kind, name) AS (VALUES (0, 'perfect'), (1, 'matched'), (2, 'disjunct'), (3, 'unmatched')),
    g AS (SELECT 2 * (1 - quality) + toxic AS kind, count(*) AS n, sum(n_chars) AS b FROM documents JOIN labels USING (doc_id) WHERE n_chars >= 100 GROUP BY 1)
    SELECT k.kind, name, coalesce(n, 0) AS n, CAST(coalesce(b, 0) AS BIGINT) AS bases, coalesce(round(b / n, 6), 0) AS mean, round(coalesce(b, 0) / 1e6, 6) AS ratio FROM k LEFT JOIN g USING (kind)"""
)
def seq_accuracy_by_kind(spark: SparkSession, d: str) -> DataFrame:
    labelled = t(spark, d, "documents").where("n_chars >= 100").join(t(spark, d, "labels"), "doc_id")
    return lengths.accuracy_by_kind(labelled.withColumn("kind", 2 * (1 - F.col("quality")) + F.col("toxic")), "kind", "n_chars", 1e6)


@query(
    f"""WITH s AS (SELECT lang, {_DNA} AS s FROM documents)
    SELECT lang, CAST(sum(length(s) - length(translate(s, 'GC', ''))) AS BIGINT) AS part, CAST(sum(length(s) - length(translate(s, 'ACGT', ''))) AS BIGINT) AS whole,
    round(sum(length(s) - length(translate(s, 'GC', ''))) / sum(length(s) - length(translate(s, 'ACGT', ''))), 6) AS ratio FROM s GROUP BY ROLLUP (lang)"""
)
def seq_gc_ratio(spark: SparkSession, d: str) -> DataFrame:
    return lengths.ratio_by_group(_docs(spark, d), "lang", sq.count_of(F.col("seq"), "GCgc"), sq.count_of(F.col("seq"), "ACGTacgt"))


# scalar sequence functions


@query("SELECT doc_id, length(text) - length(replace(text, 'A', '')) AS n_a, NOT regexp_matches(text, '[Nn.]') AND coalesce((length(text) - length(replace(text, 'A', ''))) / nullif(length(text), 0), 0) < 0.9 AS valid FROM documents")
def seq_valid_filter(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", sq.count_of(F.col("text"), "A").alias("n_a"), sq.read_valid(F.col("text")).alias("valid"))


@query("SELECT item_id, translate(text, 'Nn.', 'CCC') AS seq, length(text) - length(translate(text, 'Nn.', '')) AS n_unknown FROM benchmark")
def seq_unknown_replace(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").select("item_id", sq.replace_unknown(F.col("text")).alias("seq"), sq.unknown_count(F.col("text")).alias("n_unknown"))


@query(f"SELECT item_id, reverse(translate({_DNA}, 'ACGT', 'TGCA')) AS seq FROM benchmark")
def seq_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("item_id", sq.reverse_complement(F.col("seq")).alias("seq"))


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[ACGTacgt]+')) AS r FROM documents) SELECT doc_id, count(*) AS n, max(length(r)) AS longest FROM r GROUP BY doc_id")
def seq_acgt_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = t(spark, d, "documents").select("doc_id", F.explode(sq.acgt_runs(F.col("text"))).alias("r"))
    return runs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("r")).cast("long").alias("longest"))


@query(f"SELECT item_id, substr({_DNA}, 1, 25) AS kmer, substr({_DNA}, 1, 25) AS back FROM benchmark WHERE length({_DNA}) >= 25")
def seq_pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    kmer = F.substring("seq", 1, 25)
    return _items(spark, d).where("length(seq) >= 25").select("item_id", kmer.alias("kmer"), sq.unpack(sq.pack(kmer), 25).alias("back"))


@query(f"WITH s AS (SELECT item_id, {_DNA} AS s FROM benchmark), k AS (SELECT item_id, s, unnest(range(1, length(s) - 23)) AS pos FROM s WHERE length(s) >= 25) SELECT item_id, pos, substr(s, pos, 25) AS kmer, substr(s, pos, 25) AS back FROM k")
def seq_pack_every_kmer(spark: SparkSession, d: str) -> DataFrame:
    every = kmers.tiles(_items(spark, d), "item_id", "seq", step=1)
    return every.withColumn("back", sq.unpack(sq.pack(F.col("kmer")), 25))


@query("SELECT doc_id, CASE WHEN 19 > 0 THEN regexp_matches(substr(text, 2, 19), '[Nn.]') END AS gap FROM documents")
def seq_gap_flag(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", sq.has_gap(F.col("text"), F.lit(2), F.lit(20)).alias("gap"))


@query(f"WITH s AS (SELECT doc_id, md5({_DNA}) AS h FROM documents) SELECT h AS seq_md5, min(doc_id) AS first_id, count(*) AS n FROM s GROUP BY h HAVING count(*) > 1")
def dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    hashed = _docs(spark, d).select("doc_id", F.md5("seq").alias("seq_md5"))
    return hashed.groupBy("seq_md5").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


# k-mers

_TILES = f"""seqs AS (SELECT doc_id, {_DNA} AS s FROM documents), tiles AS (SELECT DISTINCT doc_id, p AS pos, substr(s, p, 25) AS kmer
  FROM (SELECT doc_id, s, unnest(list_append(range(1, length(s) - 23, 25), length(s) - 24)) AS p FROM seqs WHERE length(s) >= 25))"""
_READS = f"reads AS (SELECT item_id, o AS \"offset\", substr(s, o, 25) AS kmer FROM (SELECT item_id, s, unnest(range(1, length(s) - 23)) AS o FROM (SELECT item_id, {_DNA} AS s FROM benchmark) WHERE length(s) >= 25))"
_HITS = f"WITH {_TILES}, {_READS}, hits AS (SELECT item_id, doc_id, pos - \"offset\" AS diag, \"offset\" FROM reads JOIN tiles USING (kmer))"


def _doc_tiles(spark: SparkSession, d: str) -> DataFrame:
    return kmers.tiles(_docs(spark, d), "doc_id", "seq")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return kmers.tiles(_items(spark, d), "item_id", "seq", step=1).withColumnRenamed("pos", "offset")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return kmers.probe(_reads(spark, d), _doc_tiles(spark, d))


@query(f"WITH {_TILES} SELECT * FROM tiles")
def kmer_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _doc_tiles(spark, d)


@query(f"WITH {_TILES} SELECT kmer, count(*) AS n FROM tiles GROUP BY kmer HAVING count(*) > 1")
def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.counts(_doc_tiles(spark, d)).where("n > 1")


@query(f"WITH {_TILES} SELECT kmer, count(*) AS n, string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id, pos) AS list FROM tiles GROUP BY kmer")
def kmer_postings(spark: SparkSession, d: str) -> DataFrame:
    return kmers.postings(_doc_tiles(spark, d), "doc_id")


@query(
    f"""WITH {_TILES}, o AS (SELECT kmer, CAST(ceil(count(*) / 4) AS BIGINT) AS blocks FROM tiles GROUP BY kmer HAVING count(*) > 4)
    SELECT kmer, CAST(coalesce((pos + doc_id) % blocks, 0) AS BIGINT) AS block, count(*) AS n, string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id, pos) AS list FROM tiles LEFT JOIN o USING (kmer) GROUP BY ALL"""
)
def kmer_posting_blocks(spark: SparkSession, d: str) -> DataFrame:
    return kmers.posting_blocks(Stages(spark).write(_doc_tiles(spark, d), "tiles"), "doc_id", 4)  # read twice


@query(_HITS + " SELECT item_id, doc_id, diag, count(*) AS n FROM hits GROUP BY ALL")
def kmer_hash_join(spark: SparkSession, d: str) -> DataFrame:
    return kmers.seeds(_hits(spark, d), "item_id", "doc_id", 1)


@query(_HITS + " SELECT item_id, doc_id, diag, count(*) AS n FROM hits GROUP BY ALL HAVING count(*) >= 2")
def seed_diagonals(spark: SparkSession, d: str) -> DataFrame:
    return kmers.seeds(_hits(spark, d), "item_id", "doc_id")


_EXACT = f"""WITH {_TILES}, r AS (SELECT doc_id, pos AS "offset", kmer FROM tiles), a AS (SELECT doc_id AS read_id, count(*) AS asked FROM r GROUP BY 1),
h AS (SELECT r.doc_id AS read_id, tiles.doc_id AS doc_id, pos - "offset" AS diag, count(DISTINCT "offset") AS n FROM r JOIN tiles USING (kmer) GROUP BY ALL)
SELECT read_id, doc_id, diag, n FROM h JOIN a USING (read_id) WHERE n = asked"""


@query(_EXACT)
def exact_map_intersect(spark: SparkSession, d: str) -> DataFrame:
    tiles = Stages(spark).write(_doc_tiles(spark, d).withColumn("kmer", sq.pack(F.col("kmer"))), "tiles")  # read six times, a k-mer as 50 bits
    reads = tiles.select(F.col("doc_id").alias("read_id"), F.col("pos").alias("offset"), "kmer")
    return kmers.exact_tiles(reads, tiles, "read_id", "doc_id")


@query(
    f"""WITH seqs AS (SELECT doc_id, {_DNA} AS s FROM documents), r AS (SELECT doc_id AS read_id, s AS r FROM seqs WHERE doc_id % 50 = 0 AND length(s) >= 25),
    h AS (SELECT read_id, doc_id, r, s, unnest(range(1, length(s) - length(r) + 2)) AS p FROM r JOIN seqs ON contains(s, r))
    SELECT read_id, doc_id, p - 1 AS diag, (length(r) + 24) // 25 AS n FROM h WHERE substr(s, p, length(r)) = r"""
)
def exact_map_whole(spark: SparkSession, d: str) -> DataFrame:
    """Whole reads at any place of any document."""
    docs = _docs(spark, d)
    places = kmers.exact_places(docs.where("doc_id % 50 = 0"), docs, "doc_id", "seq")
    return places.select(F.col("read").alias("read_id"), "doc_id", "diag", F.ceil(F.col("size") / 25).alias("n"))


_EXTENDED = f"""WITH {_TILES}, r AS (SELECT item_id, 0 AS strand, {_DNA} AS s FROM benchmark UNION ALL SELECT item_id, 1, reverse(translate({_DNA}, 'ACGT', 'TGCA')) FROM benchmark),
    k AS (SELECT item_id, strand, o AS "offset", substr(s, o, 25) AS kmer FROM (SELECT *, unnest(range(1, length(s) - 23)) AS o FROM r WHERE length(s) >= 25)),
    f AS (SELECT DISTINCT item_id, strand, doc_id, pos - "offset" AS diag FROM k JOIN tiles USING (kmer)),
    p AS (SELECT item_id, strand, doc_id, diag, r.s AS a, seqs.s AS b, greatest(1, 1 - diag) AS lo, least(length(r.s), length(seqs.s) - diag) AS hi FROM f JOIN r USING (item_id, strand) JOIN seqs USING (doc_id)),
    m AS (SELECT *, hamming(substr(a, lo, hi - lo + 1), substr(b, lo + diag, hi - lo + 1)) AS bad FROM p WHERE length(a) - (hi - lo + 1) <= floor(0.15 * length(a)))"""


@query(_EXTENDED + " SELECT item_id, doc_id, CAST(strand AS INTEGER) AS strand, diag FROM m WHERE bad <= floor(0.05 * length(a))")
def seed_extend(spark: SparkSession, d: str) -> DataFrame:
    return kmers.extended(_items(spark, d), _docs(spark, d), "item_id", "doc_id").select("item_id", "doc_id", "strand", "diag")


# intervals


@query(_ISLANDS.replace("TOUCH", "0") + " SELECT k, CAST(island AS BIGINT) AS island, count(*) AS n, arg_min(row, (lo, row)) AS first_row, arg_max(row, (hi, row)) AS last_row, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY k, island")
def overlap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return intervals.cluster_ends(_spans(spark, d), "k", "row")


@query(_ISLANDS.replace("TOUCH", "1") + ", u AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY k, island) SELECT k, CAST(sum(hi - lo + 1) AS BIGINT) AS covered FROM u GROUP BY k")
def interval_union_cov(spark: SparkSession, d: str) -> DataFrame:
    return intervals.covered(_spans(spark, d), "k")


@query(
    _ISLANDS.replace("TOUCH", "1")
    + """, u AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY k, island), g AS (SELECT k, hi + 1 AS gap_lo, lead(lo) OVER (PARTITION BY k ORDER BY lo) - 1 AS gap_hi FROM u)
    SELECT k, gap_lo, gap_hi, count(row) AS near FROM g LEFT JOIN spans USING (k) WHERE gap_hi IS NOT NULL AND lo BETWEEN gap_lo - 5 AND gap_hi + 5 GROUP BY ALL"""
)
def uncovered_fill(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d)
    holes = intervals.gaps(spans, "k").withColumns({"a": F.col("gap_lo") - 5, "b": F.col("gap_hi") + 5})
    near = intervals.range_join(spans.select("k", "row", F.col("lo").alias("at")), holes, "k", "at", "a", "b", 32)
    return near.groupBy("k", "gap_lo", "gap_hi").agg(F.count("row").alias("near"))


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS pos FROM lineitem), g AS (SELECT k, pos, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM p)
    SELECT k, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM g GROUP BY k, g"""
)
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.runs(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos")), "k", "pos")


@query(
    """WITH o AS (SELECT o_orderkey, 1 AS lo, CAST(floor(o_totalprice / 100) AS BIGINT) + 1 AS hi FROM orders), n AS (SELECT *, (hi - lo) // 500 + 1 AS n FROM o), w AS (SELECT *, (hi - lo + 1) // n + 1 AS width, unnest(range(0, n)) AS tile FROM n)
    SELECT o_orderkey, CAST(tile AS BIGINT) AS tile, lo + tile * width AS tile_lo, least(lo + tile * width + width - 1, hi) AS tile_hi FROM w WHERE lo + tile * width <= hi"""
)
def region_tiles(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select("o_orderkey", F.lit(1).cast("long").alias("lo"), (F.floor(F.col("o_totalprice") / 100).cast("long") + 1).alias("hi"))
    return intervals.tiles(orders, "lo", "hi", 500).select("o_orderkey", F.col("tile").cast("long").alias("tile"), "tile_lo", "tile_hi")


@query(
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS x FROM events), n AS (SELECT *, CASE WHEN x - lag(x) OVER w <= 3600000000 THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
    s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY x, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(x) AS first_at, max(x) AS last_at FROM s GROUP BY ALL"""
)
def merge_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").select("user_id", "event_id", _micros("ts").alias("at"))
    return intervals.sessions(events, "user_id", "at", "event_id", 3_600_000_000).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


# chaining and classification

_PAIRS = """pairs AS (SELECT l_orderkey AS o, l_suppkey AS s, CASE WHEN max(l_discount) = 0 THEN 0 WHEN avg(l_discount) < 0.05 THEN 1 WHEN count(*) > 1 THEN 2 ELSE 3 END AS kind, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem GROUP BY ALL)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.max("l_discount") == 0, 0).when(F.avg("l_discount") < 0.05, 1).when(F.count("*") > 1, 2).otherwise(3)
    lines = t(spark, d, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).agg(kind.alias("kind"), F.sum(F.col("l_quantity").cast("long")).alias("weight"))


_SEGMENTS = """segments AS (SELECT q, line, total, total - CAST(floor(total * tax) AS BIGINT) AS hit, CASE WHEN line % 3 = 0 THEN 150 ELSE total + part % 3 * 10 END AS len
  FROM (SELECT l_orderkey AS q, l_linenumber AS line, CAST(sum(l_quantity) * 10 AS BIGINT) AS total, max(l_tax) * 2 AS tax, max(l_partkey) AS part FROM lineitem GROUP BY ALL)),
kinds AS (SELECT q, line, total, hit, len, CASE WHEN hit = greatest(len, total) THEN 0 WHEN hit < total * t - 1e-9 OR hit < greatest(len, total) * t - 1e-9 THEN 3 ELSE 1 END AS kind FROM (SELECT *, CASE WHEN len <= 200 THEN 0.72 ELSE 0.9 END AS t FROM segments))"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, subject_id, kind, match_sum): the lines of one number are the only segment of an order on that number."""
    lines = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum("l_quantity") * 10).cast("long").alias("total"), (F.max("l_tax") * 2).alias("tax"), F.max("l_partkey").alias("part"))
    total = F.col("total")
    length = F.when(F.col("l_linenumber") % 3 == 0, 150).otherwise(total + F.col("part") % 3 * 10)
    hit = total - F.floor(total * F.col("tax")).cast("long")
    items = lines.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("subject_id"), length.cast("long").alias("query_len"), hit.alias("match_len"), total.alias("total_len"),
        *[F.lit(1).cast("long").alias(c) for c in ("hsp", "q_start", "q_end", "s_start", "s_end", "strand")],
    )
    return chaining.classify_pairs(items)


@query(f"WITH {_SEGMENTS} SELECT kind, count(*) AS n, CAST(sum(hit) AS BIGINT) AS weight FROM kinds GROUP BY kind")
def match_kind_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of a query and a subject are of each kind, and their matching bases."""
    return _kinds(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("match_sum").alias("weight"))


@query(f"WITH {_SEGMENTS} SELECT q AS query_id, CAST(line AS BIGINT) AS subject_id, kind, hit AS match_sum FROM kinds")
def pair_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d)


@query(
    f"""WITH {_SEGMENTS}, b AS (SELECT q, line, kind, hit, len, total, row_number() OVER (PARTITION BY q ORDER BY kind, hit DESC, line) AS r FROM kinds),
    g AS (SELECT q, max(CASE WHEN r = 1 THEN kind END) AS best, count(DISTINCT line) AS subjects, sum(CASE WHEN hit > 0 AND kind < 3 THEN 1 ELSE 0 END) AS good, sum(hit) AS total, max(hit) AS covered, max(300) AS len FROM b GROUP BY q)
    SELECT q AS query_id, CAST(CASE WHEN best = 0 OR subjects = 1 THEN best WHEN best < 3 THEN 2 WHEN good > 0 AND total >= 0.9 * len AND covered >= 0.9 * len THEN 2 ELSE 3 END AS INTEGER) AS kind FROM g"""
)
def global_match_kind(spark: SparkSession, d: str) -> DataFrame:
    pairs = _kinds(spark, d)
    good = F.when((F.col("match_sum") > 0) & (F.col("kind") < chaining.UNMATCHED), 1).otherwise(0)
    return chaining.global_kind(pairs.withColumns({"weight": F.col("match_sum"), "good": good, "total": F.col("match_sum"), "covered": F.col("match_sum"), "query_len": F.lit(300)}))


def _items_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Aligned items: the lines of five orders lie on one query of 4000 bases and on two circular subjects, the longest first."""
    c = F.col
    size = 110 + c("l_quantity").cast("long") * 9
    begin, shift = 1 + c("l_partkey") % 3300, c("l_suppkey") % 5 * 1_300
    plus = c("l_returnflag") != "R"
    lines = t(spark, d, "lineitem").select(
        F.floor(c("l_orderkey") / 5).cast("long").alias("query_id"), (c("l_suppkey") % 2).alias("subject_id"), F.lit(4_000).cast("long").alias("query_len"), F.lit(9_000).cast("long").alias("subject_len"), begin.alias("q_start"), (begin + size - 1).alias("q_end"),
        F.when(plus, begin + shift).otherwise(begin + shift + size - 1).alias("s_start"), F.when(plus, begin + shift + size - 1).otherwise(begin + shift).alias("s_end"), F.when(plus, 0).otherwise(1).alias("strand"),
        (size - c("l_linenumber")).alias("match_len"), size.alias("total_len"),
    ).distinct()
    order = W.partitionBy("query_id", "subject_id").orderBy(F.desc("total_len"), F.desc("match_len"), "q_start", "s_start", "strand")
    return lines.withColumn("hsp", F.row_number().over(order).cast("long"))


@query()
def chained_segments(spark: SparkSession, d: str) -> DataFrame:
    """The chain of each query on each subject; tests hold chains against plain loops."""
    return chaining.chained(_items_of_lines(spark, d)).select("query_id", "subject_id", "ord", "hsp", "q_start", "q_end")


@query()
def holes_filled(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each query over both subjects: the better one's chain with its holes covered by the other's."""
    items = _items_of_lines(spark, d)
    queries = t(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 5).cast("long").alias("query_id"), F.lit(4_000).cast("long").alias("len")).distinct()  # those of the items
    found = assembly.align_queries(queries, items, Stages(spark))
    return found.segments.join(found.kinds.select("query_id", "kind"), "query_id").select("query_id", "kind", "ord", "subject_id", "hsp", "q_start", "q_end")


@query("SELECT row_number() OVER (ORDER BY length(text) DESC, doc_id::VARCHAR) AS id, doc_id::VARCHAR AS title, CAST(length(text) AS BIGINT) AS len FROM documents")
def catalog_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.col("text").alias("seq"), F.length("text").alias("len"))
    return catalog.numbered(docs, "id").select("id", "title", "len")


@query(f"WITH {_PAIRS} SELECT o, s, kind, weight FROM pairs QUALIFY row_number() OVER (PARTITION BY o ORDER BY kind, weight DESC, s) = 1")
def best_subject_argmax(spark: SparkSession, d: str) -> DataFrame:
    return chaining.best_subject(_pairs(spark, d), "o", "s", "kind", "weight")


@query(f"WITH {_PAIRS}, b AS (SELECT o, s FROM pairs QUALIFY row_number() OVER (PARTITION BY o ORDER BY kind, weight DESC, s) = 1) SELECT o, s, kind, weight FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o = p.o AND b.s = p.s)")
def other_subject_pool(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    return chaining.other_subjects(pairs, chaining.best_subject(pairs, "o", "s", "kind", "weight"), "o", "s")


@query(
    """WITH e AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM events)
    SELECT user_id, coalesce(max(CASE WHEN abs(dv) > 50 THEN 1 ELSE 0 END), 0) AS disjunct FROM e GROUP BY user_id"""
)
def disjunct_flag(spark: SparkSession, d: str) -> DataFrame:
    return chaining.disjunct_flags(t(spark, d, "events"), "user_id", ("ts", "event_id"), "value", 50)


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS x FROM events), j AS (SELECT c.event_id, c.user_id, c.x, v.event_id AS near, v.x AS near_at FROM e c LEFT JOIN e v ON c.user_id = v.user_id AND v.event_id % 2 = 1 AND v.x <= c.x WHERE c.event_id % 2 = 0)
    SELECT event_id, user_id, x AS event_at, coalesce(near, -1) AS near, coalesce(near_at, -1) AS near_at FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY j.near_at DESC NULLS LAST, j.near DESC) = 1"""
)
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    events = t(spark, d, "events").select("event_id", "user_id", _micros("ts").alias("event_at"))
    near = chaining.nearest_before(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), "user_id", "event_at", "event_at", "event_id")
    return near.na.fill(-1, ["near", "near_at"])


@query(f"WITH {_SPANS} SELECT k, row, row_number() OVER (PARTITION BY k ORDER BY lo, hi, row) AS ord FROM spans")
def order_repair(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("k", "row", F.row_number().over(W.partitionBy("k").orderBy("lo", "hi", "row")).cast("long").alias("ord"))


# mates and mapping


@query(
    """WITH p AS (SELECT (event_id + 1) // 2 AS pair, max(value) - min(value) AS frag FROM events GROUP BY 1 HAVING count(*) = 2), f AS (SELECT * FROM p ORDER BY pair LIMIT 2000), m AS (SELECT count(*) AS n, avg(frag) AS mean FROM f)
    SELECT n, round(mean, 6) AS mean, round(sqrt(avg((frag - mean) * (frag - mean))), 6) AS sd FROM f, m WHERE frag < 2 * mean GROUP BY n, mean"""
)
def insert_size(spark: SparkSession, d: str) -> DataFrame:
    both = t(spark, d, "events").groupBy(mapping.pair_id(F.col("event_id")).alias("pair")).agg((F.max("value") - F.min("value")).alias("frag"), F.count("*").alias("k")).where("k = 2")
    return mapping.insert_size(both, "pair", "frag").select("n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(
    """WITH a AS (SELECT (event_id + 1) // 2 AS pair, event_type, event_id AS r1, value AS p1 FROM events WHERE event_id % 2 = 1), b AS (SELECT (event_id + 1) // 2 AS pair, event_type, event_id AS r2, value AS p2 FROM events WHERE event_id % 2 = 0)
    SELECT pair, event_type, r1, r2 FROM a JOIN b USING (pair, event_type) WHERE abs(abs(p1 - p2) - 30) <= 60"""
)
def mate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mates(t(spark, d, "events"), "event_id", "event_type", "value", 30, 10).select("pair", "event_type", "r1", "r2")


@query(_HITS + ", g AS (SELECT item_id, doc_id, diag FROM hits GROUP BY ALL) SELECT item_id, count(*) AS n_hits, CASE WHEN count(*) <= 1 THEN 1 ELSE 0 END AS is_unique FROM g GROUP BY item_id")
def unique_flags(spark: SparkSession, d: str) -> DataFrame:
    return mapping.unique_flags(kmers.seeds(_hits(spark, d), "item_id", "doc_id", 1), "item_id")


@query(
    _EXTENDED
    + """, c AS (SELECT item_id, doc_id, strand, diag, array_to_string(list_transform(range(lo, hi + 1), lambda i: CASE WHEN substr(a, i, 1) = substr(b, i + diag, 1) THEN '0' ELSE '1' END), '') AS marks FROM m WHERE bad <= floor(0.05 * length(a))),
    h AS (SELECT item_id, doc_id, strand, diag, length(replace(regexp_replace(regexp_replace(marks, '^1+', ''), '1+$', ''), '0', '')) AS mismatches FROM c),
    low AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY mismatches) AS k FROM h) SELECT item_id, doc_id, CAST(strand AS INTEGER) AS strand, diag, mismatches FROM low WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY item_id) = 1"""
)
def best_placement(spark: SparkSession, d: str) -> DataFrame:
    """Items with one placement of fewest mismatches."""
    hits = kmers.extended(_items(spark, d), _docs(spark, d), "item_id", "doc_id")
    return mapping.sole_best(hits, "item_id", "mismatches").select("item_id", "doc_id", "strand", "diag", "mismatches")


_CANDIDATES = """WITH l AS (SELECT l_orderkey AS read_id, l_suppkey % 4 AS key, l_linenumber % 2 AS strand, 1 + l_partkey % 1900 AS start, min(CAST(l_quantity AS BIGINT) % 4) AS miss FROM lineitem WHERE l_orderkey > 0 GROUP BY ALL),
hits AS (SELECT read_id, (read_id + 1) // 2 AS pair, (read_id + 1) // 2 // 500 * 10 + key AS key, strand, start, miss FROM l),
near AS (SELECT a.pair, a.key, a.strand AS s1, a.start AS p1, a.miss AS m1, b.strand AS s2, b.start AS p2, b.miss AS m2, CASE WHEN a.strand = 0 THEN b.start + 100 - a.start ELSE a.start + 100 - b.start END AS frag
  FROM hits a JOIN hits b ON a.pair = b.pair AND a.key = b.key AND a.strand != b.strand AND a.read_id % 2 = 1 AND b.read_id % 2 = 0),
mated AS (SELECT * FROM near WHERE abs(frag - 350) <= 300 QUALIFY row_number() OVER (PARTITION BY pair, key, s1, p1 ORDER BY m2, abs(frag - 350), p2, s2) = 1)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Hits: the lines of an order are places of a read of 100 bases, 500 pairs of reads share four queries."""
    c = F.col
    lines = t(spark, d, "lineitem").where("l_orderkey > 0").groupBy(c("l_orderkey").alias("read_id"), (c("l_suppkey") % 4).alias("k"), (c("l_linenumber") % 2).cast("long").alias("strand"), (1 + c("l_partkey") % 1900).alias("start"))
    hits = lines.agg(F.min(c("l_quantity").cast("long") % 4).alias("mismatches"))
    key = F.floor(mapping.pair_id(c("read_id")) / 500) * 10 + c("k")
    return hits.select("read_id", key.cast("long").alias("key"), "strand", "start", F.lit(100).cast("long").alias("size"), F.lit(0).cast("long").alias("skip"), "mismatches", F.lit(100).cast("long").alias("len"))


@query(_CANDIDATES + " SELECT read_id, key, strand, start, miss AS mismatches, row_number() OVER (PARTITION BY read_id ORDER BY miss, key, start, strand) AS rank FROM hits")
def hit_ranks(spark: SparkSession, d: str) -> DataFrame:
    return mapping.hit_ranks(_candidates(spark, d), "read_id", "mismatches", ("key", "start", "strand")).select("read_id", "key", "strand", "start", "mismatches", "rank")


@query(_CANDIDATES + " SELECT pair, key, s1, p1, s2, p2, m1 + m2 AS mismatches, frag FROM mated")
def mated_hits(spark: SparkSession, d: str) -> DataFrame:
    found = mapping.mated_hits(_candidates(spark, d), 350.0, 50.0)
    return found.select("pair", "key", F.col("h1.strand").alias("s1"), F.col("h1.start").alias("p1"), F.col("h2.strand").alias("s2"), F.col("h2.start").alias("p2"), (F.col("h1.mismatches") + F.col("h2.mismatches")).alias("mismatches"), "frag")


@query(
    _CANDIDATES
    + """, sole AS (SELECT * FROM hits WHERE miss < 2 QUALIFY count(*) OVER (PARTITION BY read_id) = 1)
    SELECT a.pair, CASE WHEN a.strand = 0 THEN b.start + 100 - a.start ELSE a.start + 100 - b.start END AS frag FROM sole a JOIN sole b ON a.pair = b.pair AND a.key = b.key AND a.strand != b.strand AND a.read_id % 2 = 1 AND b.read_id % 2 = 0
    WHERE a.miss = 0 AND b.miss = 0 AND CASE WHEN a.strand = 0 THEN a.start <= b.start ELSE a.start >= b.start END"""
)
def facing_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of the pairs that the insert size is estimated from; hits with two or three mismatches are left out first."""
    return mapping.facing_fragments(_candidates(spark, d).where("mismatches < 2"))


#: One pass over hits H and mated hits M into the table OUT, with equals told by z and tie.
_PASS = """OUT_h AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS n FROM HITS), OUT_m AS (SELECT *, m1 + m2 AS miss FROM MATED),
OUT_b AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY pair) AS several, rank() OVER (PARTITION BY pair ORDER BY miss, PAIRTIE) AS k FROM OUT_m) WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY pair) = 1),
OUT_p AS (SELECT 2 * pair - 1 AS read_id, key, s1 AS strand, p1 AS start, several FROM OUT_b UNION ALL SELECT 2 * pair, key, s2, p2, several FROM OUT_b),
OUT_s AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY read_id ORDER BY miss, READTIE) AS k FROM OUT_h h WHERE pair NOT IN (SELECT pair FROM OUT_b) AND (n = 1 OR pair NOT IN (SELECT pair FROM OUT_m))) WHERE k = 1 QUALIFY count(*) OVER (PARTITION BY read_id) = 1),
OUT AS (SELECT read_id, key, strand, start, several > 1 AND n > 1 AS multi FROM OUT_p JOIN (SELECT DISTINCT read_id, n FROM OUT_h) USING (read_id) UNION ALL SELECT read_id, key, strand, start, n > 1 FROM OUT_s)"""


def _pass(out: str, hits: str, mated: str, pair: str, read: str) -> str:
    for name, value in (("OUT", out), ("HITS", hits), ("MATED", mated), ("PAIRTIE", pair), ("READTIE", read)):
        sql = (_PASS if name == "OUT" else sql).replace(name, value)  # noqa: F821
    return sql


@query(
    f"""{_CANDIDATES}, {_pass("one", "hits", "mated", "0", "0")},
    held AS (SELECT DISTINCT key, unnest(range(start, start + 100)) AS p FROM one),
    under AS (SELECT u.key, u.start, 100 - count(held.p) AS zero FROM (SELECT key, start, unnest(range(start, start + 100)) AS p FROM (SELECT DISTINCT key, start FROM hits)) u LEFT JOIN held ON held.key = u.key AND held.p = u.p GROUP BY ALL),
    hits2 AS (SELECT h.*, u.zero FROM hits h JOIN under u USING (key, start) WHERE read_id NOT IN (SELECT read_id FROM one)),
    mated2 AS (SELECT m.*, a.zero + b.zero AS zero FROM mated m JOIN under a ON a.key = m.key AND a.start = m.p1 JOIN under b ON b.key = m.key AND b.start = m.p2 WHERE pair NOT IN (SELECT (read_id + 1) // 2 FROM one)),
    {_pass("two", "hits2", "mated2", "-zero, md5(concat_ws(':', pair, key, p1, p2))", "-zero, md5(concat_ws(':', read_id, key, start, strand))")}
    SELECT * FROM one UNION ALL SELECT * FROM two"""
)
def placed_twice(spark: SparkSession, d: str) -> DataFrame:
    """Placements of a first pass that takes what is unambiguous, and of a second one by what the first left uncovered."""
    stages = Stages(spark)
    hits = stages.write(_candidates(spark, d), "hits")  # read by both passes
    mated = stages.write(mapping.mated_hits(hits, 350.0, 50.0), "mated")
    return assembly.choose_twice(hits, mated, hits.select("key", F.lit(2000).cast("long").alias("len")).distinct(), stages).select("read_id", "key", "strand", "start", "multi")


@query(_HITS + " SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.item_id = b.item_id)")
def two_pass_anti(spark: SparkSession, d: str) -> DataFrame:
    return mapping.not_yet_placed(t(spark, d, "benchmark").select("item_id"), _hits(spark, d), "item_id")


@query(f"WITH {_SPANS} SELECT k, row, lo, row_number() OVER (PARTITION BY k ORDER BY lo, row) AS ord FROM spans")
def group_sort_positions(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("k", "row", "lo", F.row_number().over(W.partitionBy("k").orderBy("lo", "row")).cast("long").alias("ord"))


# pileup

_COV = f"""WITH {_SPANS}, b AS (SELECT k, unnest(range(lo, hi + 1)) AS pos, flag FROM spans), cov AS (SELECT k, pos, count(*) FILTER (flag = 'A') AS a, count(*) FILTER (flag = 'C') AS c,
  count(*) FILTER (flag = 'G') AS g, count(*) FILTER (flag = 'T') AS t, count(*) FILTER (flag NOT IN ('A', 'C', 'G', 'T')) AS n, count(*) AS total FROM b GROUP BY k, pos)"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return pileup.span_coverage(_spans(spark, d), "k", "lo", "hi", "flag")


@query(_COV + " SELECT * FROM cov")
def base_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d)


@query(_COV + ", s AS (SELECT k, pos, total, lag(total) OVER w AS before, lag(pos) OVER w AS prev FROM cov WINDOW w AS (PARTITION BY k ORDER BY pos)) SELECT k, CAST(max(total) AS BIGINT) AS deepest, count(*) AS covered FROM s GROUP BY k")
def depth_steps(spark: SparkSession, d: str) -> DataFrame:
    upto = pileup.depth_stretches(_spans(spark, d).where("lo <= hi"), "k", "lo", "hi")
    return upto.groupBy("k").agg(F.max("total").alias("deepest"), F.sum(F.when(F.col("total") > 0, F.col("next") - F.col("pos")).otherwise(0)).alias("covered"))


@query(_COV + ", r AS (SELECT *, list_reverse_sort([a, c, g, t, n]) AS l FROM cov) SELECT k, count(*) AS positions, count(*) FILTER (10 * l[1] < 9 * total AND NOT (l[2] = 1 AND l[1] >= 4)) AS disagree FROM r GROUP BY k")
def disagreement(spark: SparkSession, d: str) -> DataFrame:
    return pileup.disagreement(_coverage(spark, d)).groupBy("k").agg(F.count("*").alias("positions"), F.count_if("disagree").alias("disagree"))


_BINS = "WITH e AS (SELECT event_type AS k, epoch_us(ts) // 1000000 % 5000 + 1 AS pos, value FROM events), bins AS (SELECT k, (pos - 1) // 50 AS bin, avg(value) AS mean FROM e GROUP BY ALL)"


def _bins(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.col("event_type").alias("k"), (F.floor(_micros("ts") / 1_000_000) % 5000 + 1).cast("long").alias("pos"), "value")
    return pileup.bin_means(e, "k", "pos", "value")


@query(_BINS + " SELECT k, count(*) AS bins, round(avg(mean), 6) AS mean, round(stddev_pop(mean), 6) AS sd FROM bins GROUP BY k")
def binned_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pileup.bin_statistics(_bins(spark, d), "k").select("k", "bins", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(_BINS + ", s AS (SELECT k, avg(mean) AS m FROM bins GROUP BY k) SELECT k, count(*) FILTER (mean > 1.5 * m) AS high, count(*) FILTER (mean < 0.5 * m) AS low FROM bins JOIN s USING (k) GROUP BY k")
def abnormal_bins(spark: SparkSession, d: str) -> DataFrame:
    return pileup.abnormal_bins(_bins(spark, d), "k")


@query(_BINS + ", n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY bin) AS i, count(*) OVER (PARTITION BY k) AS n FROM bins) SELECT k, count(*) AS bins, round(sum(mean), 6) AS mean FROM n WHERE i > 2 AND i <= n - 2 GROUP BY k")
def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    return pileup.roll_up(_bins(spark, d), "k", "bin", 2, 2, ["mean"]).select("k", "bins", F.round("mean", 6).alias("mean"))


_MATES = """WITH e AS (SELECT event_id, (event_id + 1) // 2 AS pair, event_type, user_id % 20 AS region, value FROM events), m AS (SELECT a.*, b.event_type AS mate_type, b.value AS mate_value FROM e a LEFT JOIN e b ON a.pair = b.pair AND a.event_id != b.event_id)"""


@query(
    _MATES
    + """ SELECT region, count(*) AS total, count(*) FILTER (mate_type = event_type) AS paired, count(*) FILTER (mate_type = event_type AND abs(value - mate_value) > 60) AS discordant, count(*) FILTER (mate_type != event_type) AS other,
    round(count(*) FILTER (mate_type = event_type AND abs(value - mate_value) > 60) / nullif(count(*) FILTER (mate_type = event_type), 0), 6) AS ratio FROM m GROUP BY region"""
)
def region_concordance(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", mapping.pair_id(F.col("event_id")).alias("pair"), "event_type", (F.col("user_id") % 20).alias("region"), "value")
    mate = e.select("pair", F.col("event_id").alias("mate"), F.col("event_type").alias("mate_type"), F.col("value").alias("mate_value"))
    both = e.join(mate, (e["pair"] == mate["pair"]) & (e["event_id"] != mate["mate"]), "left")
    same = F.col("mate_type") == F.col("event_type")
    out = both.groupBy("region").agg(F.count("*").alias("total"), F.count_if(same).alias("paired"), F.count_if(same & (F.abs(F.col("value") - F.col("mate_value")) > 60)).alias("discordant"), F.count_if(F.col("mate_type") != F.col("event_type")).alias("other"))
    return out.withColumn("ratio", F.round(F.try_divide("discordant", "paired"), 6))


@query(_MATES + " SELECT region, count(*) AS spanning, round(avg(abs(value - mate_value)), 6) AS mean_frag, round(avg(abs(value - mate_value)) - 30, 6) AS dif FROM m WHERE least(value, mate_value) < 40 AND greatest(value, mate_value) > 60 GROUP BY region")
def fragment_window(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", mapping.pair_id(F.col("event_id")).alias("pair"), (F.col("user_id") % 20).alias("region"), "value")
    mate = e.select("pair", F.col("event_id").alias("mate"), F.col("value").alias("mate_value"))
    both = e.join(mate, (e["pair"] == mate["pair"]) & (e["event_id"] != mate["mate"]))
    spanning = both.where((F.least("value", "mate_value") < 40) & (F.greatest("value", "mate_value") > 60))
    frag = F.avg(F.abs(F.col("value") - F.col("mate_value")))
    return spanning.groupBy("region").agg(F.count("*").alias("spanning"), F.round(frag, 6).alias("mean_frag"), F.round(frag - 30, 6).alias("dif"))


# the reference


@query(
    f"""WITH s AS (SELECT item_id, {_DNA} AS s FROM benchmark), p AS (SELECT b.item_id AS subject, a.s AS q, b.s AS s FROM s a JOIN s b ON b.item_id = a.item_id + 1),
    c AS (SELECT subject, q, s, unnest(range(1, least(length(q), length(s)) + 1)) AS pos FROM p)
    SELECT subject, pos, CAST(CASE WHEN substr(q, pos, 1) = substr(s, pos, 1) THEN 1 ELSE 2 + 5 * (instr('ACGTN', substr(s, pos, 1)) - 1) + instr('ACGTN', substr(q, pos, 1)) - 1 END AS INTEGER) AS flag FROM c"""
)
def ref_base_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each item laid over the next one without gaps."""
    items = _items(spark, d)
    pairs = items.select((F.col("item_id") + 1).alias("subject"), F.col("seq").alias("q")).join(items.select(F.col("item_id").alias("subject"), F.col("seq").alias("s")), "subject")
    size = F.least(F.length("q"), F.length("s"))
    rows = pairs.select("subject", F.lit(1).alias("start"), F.substr("q", F.lit(1), size).alias("q"), F.substr("s", F.lit(1), size).alias("s")).where("length(q) > 0")
    return reference.base_flags(rows, "subject", "start", "q", "s")


@query(
    _ISLANDS.replace("TOUCH", "1")
    + """, u AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY k, island), c AS (SELECT k, sum(hi - lo + 1) AS covered FROM u GROUP BY k)
    SELECT s_suppkey AS k, CAST(sum(coalesce(covered, 0)) AS BIGINT) AS covered, CAST(sum(3000 + s_nationkey) AS BIGINT) AS length, sum(coalesce(covered, 0)) / sum(3000 + s_nationkey) AS ratio FROM supplier LEFT JOIN c ON k = s_suppkey GROUP BY ROLLUP (s_suppkey)"""
)
def ref_covered_ratio(spark: SparkSession, d: str) -> DataFrame:
    subjects = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.lit(3000) + F.col("s_nationkey")).alias("len"))
    return reference.covered_ratio(_spans(spark, d), subjects, "k", "len")


# breakpoints and verdicts

_SEGS = "segs AS (SELECT l_suppkey AS k, l_orderkey AS subject, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS strand, l_orderkey * 10 + l_linenumber AS q_start, l_orderkey * 10 + l_linenumber + CAST(l_quantity AS BIGINT) AS q_end, l_partkey AS s_start, l_partkey + CAST(l_quantity AS BIGINT) AS s_end FROM lineitem )"
_POINTS = f"""WITH {_SEGS}, p AS (SELECT *, lag(q_end) OVER w AS pq, lag(s_end) OVER w AS ps, lag(s_start) OVER w AS pss, lag(strand) OVER w AS pst FROM segs WINDOW w AS (PARTITION BY k ORDER BY q_start, q_end, s_start, s_end, strand)),
d AS (SELECT *, q_start - pq AS dq, CASE WHEN strand = 0 THEN s_start - ps ELSE ps - s_start END AS ds FROM p WHERE pq IS NOT NULL),
kinds AS (SELECT *, CASE WHEN strand != pst OR abs(s_start - ps) > 5000 THEN 'misjoin' WHEN dq - ds >= 5 AND ds <= 5 THEN 'insertion' WHEN ds - dq >= 5 AND dq <= 5 THEN 'deletion' WHEN dq >= 5 AND ds >= 5 THEN 'gap' END AS kind FROM d),
points AS (SELECT k, least(pq, q_start) AS "left", greatest(pq, q_start) AS "right", dq, ds, CASE WHEN kind IN ('insertion', 'gap') AND CASE WHEN strand = 0 THEN s_end <= pss ELSE s_end >= pss END THEN 'misjoin' ELSE kind END AS kind FROM kinds)"""


def _points(lines: DataFrame) -> DataFrame:
    q = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    n = F.col("l_quantity").cast("long")
    segs = lines.select(F.col("l_suppkey").alias("k"), F.lit(1).alias("subject"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("strand"), q.alias("q_start"), (q + n).alias("q_end"), F.col("l_partkey").alias("s_start"), (F.col("l_partkey") + n).alias("s_end"))
    return verdicts.breakpoints(segs, "k", ("q_start", "q_end", "s_start", "s_end", "strand"))


def _by_kind(points: DataFrame) -> DataFrame:
    return points.groupBy("k", "kind").agg(F.count("*").alias("n"), F.sum("dq").alias("dq"), F.min("left").alias("first_left"))


_BY_KIND = " SELECT k, kind, count(*) AS n, CAST(sum(dq) AS BIGINT) AS dq, min(\"left\") AS first_left FROM points WHERE kind IS NOT NULL GROUP BY ALL"


@query(_POINTS + _BY_KIND)
def breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return _by_kind(_points(t(spark, d, "lineitem")))


@query(_POINTS + _BY_KIND)
def breakpoints_all(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``breakpoints``, which was filtered once."""
    return breakpoints(spark, d)


@query(
    f"""WITH {_SEGS}, e AS (SELECT k, min(q_start) AS a, max(q_end) AS b, max(q_end) + k % 9 AS len FROM segs GROUP BY k)
    SELECT k, CAST(1 AS BIGINT) AS "left", a AS "right", 'insertion' AS kind FROM e WHERE a >= 3 UNION ALL SELECT k, b, len, 'insertion' FROM e WHERE b <= len - 5"""
)
def end_insertions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    segs = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), q.alias("q_start"), (q + F.col("l_quantity").cast("long")).alias("q_end"))
    return verdicts.end_insertions(segs, segs.groupBy("k").agg((F.max("q_end") + F.col("k") % 9).alias("len")), "k", "len")


@query()
def refined_margins(spark: SparkSession, d: str) -> DataFrame:
    """Where documents that begin with the same 200 letters stop being alike: each runs on the first of them for up to 800 letters, and on itself from the 401st on."""
    docs = Stages(spark).write(_docs(spark, d), "sequences").where(F.length("seq") >= 800)  # read five times
    heads = docs.withColumn("head", F.xxhash64(F.substring("seq", 1, 200)))
    pairs = heads.join(heads.groupBy("head").agg(F.min("doc_id").alias("p_subject")), "head").where("doc_id != p_subject")
    points = pairs.select(F.col("doc_id").alias("key"), "p_subject", F.col("doc_id").alias("subject"), *[F.lit(n).cast("long").alias(c) for c, n in (("p_q_end", 800), ("p_s_end", 800), ("q_start", 401), ("s_start", 401))], F.lit(0).alias("p_strand"), F.lit(0).alias("strand"))
    found = alignment.refine_margins(points, docs.select(F.col("doc_id").alias("key"), "seq"), docs.select(F.col("doc_id").alias("subject"), "seq"))
    return found.select("key", "p_subject", "left", "right")


@query()
def inner_indels(spark: SparkSession, d: str) -> DataFrame:
    """Indels between documents that begin with the same 200 letters: each against the first of them."""
    seqs = Stages(spark).write(_docs(spark, d), "sequences")  # read five times
    docs = seqs.where(F.length("seq") >= 800).withColumn("head", F.xxhash64(F.substring("seq", 1, 200)))
    first = docs.groupBy("head").agg(F.min("doc_id").alias("subject"))
    pairs = docs.join(first, "head").where("doc_id != subject")
    sized = pairs.join(seqs.select(F.col("doc_id").alias("subject"), F.length("seq").cast("long").alias("s_end")), "subject")
    segments = sized.select(F.col("doc_id").alias("key"), "subject", F.lit(0).alias("strand"), F.lit(1).alias("q_start"), F.length("seq").cast("long").alias("q_end"), F.lit(1).alias("s_start"), "s_end", F.lit(9).alias("gap_num"))
    found = alignment.inner_indels(segments, seqs.select(F.col("doc_id").alias("key"), "seq"), seqs.select(F.col("doc_id").alias("subject"), "seq"))
    return found.select("key", "subject", "kind", "left", "right", "dq", "ds", "s_left", "s_right")


@query(
    _POINTS
    + """, m AS (SELECT k, "left" AS lo, "right" AS hi, row_number() OVER (PARTITION BY k ORDER BY "left", "right") AS i FROM points WHERE kind = 'misjoin'),
    l AS (SELECT k, list(struct_pack(l := lo, r := hi, n := 1) ORDER BY i) AS s FROM m GROUP BY k),
    f AS (SELECT k, list_reduce(list_transform(s, lambda x: [x]), lambda done, x: CASE WHEN x[1].r - done[-1].l < 1000 OR x[1].l - done[-1].r < 50
      THEN list_concat(done[:-2], [struct_pack(l := least(done[-1].l, x[1].l), r := greatest(done[-1].r, x[1].r), n := done[-1].n + 1)]) ELSE list_concat(done, x) END) AS s FROM l),
    u AS (SELECT k, unnest(s) AS x FROM f) SELECT k, x.l AS "left", x.r AS "right", CAST(x.n AS BIGINT) AS n FROM u"""
)
def merged_misjoins(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.merge_misjoins(_points(t(spark, d, "lineitem")).where("kind = 'misjoin'"), "k")


_EVIDENCE = """WITH ev AS (SELECT l_orderkey AS o, CAST(sum(l_linenumber) % 5 AS BIGINT) AS zero, CAST(count(*) % 4 AS BIGINT) AS dis, CAST(sum(l_partkey) % 2000 AS BIGINT) AS size, CAST(sum(l_suppkey) % 6 AS BIGINT) AS high, CAST(max(l_partkey) % 5 AS BIGINT) AS low, CAST(max(l_suppkey) % 5 AS BIGINT) AS discor, CAST(max(l_partkey) % 3 AS BIGINT) / 10.0 AS discor_ratio, CAST(max(l_suppkey) % 4 AS BIGINT) / 20.0 AS multi, CAST(min(l_partkey) % 4 AS BIGINT) / 20.0 AS other, min(l_suppkey) % 2 = 0 AS at_end FROM lineitem GROUP BY l_orderkey)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o")).agg(
        (F.sum("l_linenumber") % 5).cast("long").alias("zero"), (F.count("*") % 4).alias("dis"), (F.sum("l_partkey") % 2000).alias("size"), (F.sum("l_suppkey") % 6).alias("high"), (F.max("l_partkey") % 5).alias("low"), (F.max("l_suppkey") % 5).alias("discor"),
        (F.max("l_partkey") % 3 / 10.0).alias("discor_ratio"), (F.max("l_suppkey") % 4 / 20.0).alias("multi"), (F.min("l_partkey") % 4 / 20.0).alias("other"), (F.min("l_suppkey") % 2 == 0).alias("at_end"),
    )


@query(
    _EVIDENCE
    + """ SELECT o, CASE WHEN zero > 3 OR ((dis > 1 OR zero > 0 OR high > 3 OR low > 3) AND discor >= 3 AND discor_ratio > 0.1) THEN 'true' WHEN dis >= 1 AND (zero > 0 OR high > 0 OR low > 0 OR size // dis < 500) THEN 'true'
    WHEN (multi > 0.1 OR other > 0.1) AND NOT at_end THEN 'true' ELSE 'uncertain' END AS verdict FROM ev"""
)
def verdict_misjoin(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select("o", verdicts.misjoin_verdict().alias("verdict"))


@query(
    _EVIDENCE
    + """, x AS (SELECT *, discor AS pl, high AS pr, discor_ratio / 2 AS rl, multi / 2 AS rr, size / 10.0 AS dif, zero % 2 AS db, low % 2 AS mb FROM ev),
    y AS (SELECT *, low > 0 OR high > 0 AS uneven, (dif < 50 OR dif < 30) AND (db > 0 OR mb > 0) AS closer FROM x)
    SELECT o, CASE WHEN zero > 0 OR pl < 3 OR pr < 3 THEN 'true'
    WHEN dif < 100 OR dif < 60 OR rl > 0.1 OR rr > 0.1 THEN CASE WHEN dis > 0 OR zero > 0 OR low > 1 OR high > 1 OR rl > 0.2 OR rr > 0.2 OR ((rl > 0.1 OR rr > 0.1) AND (uneven OR closer)) OR (rl > 0.05 AND rr > 0.05 AND mb > 0) THEN 'true' ELSE 'uncertain' END
    WHEN dis > 0 THEN CASE WHEN size // dis < 1000 OR uneven THEN 'true' ELSE 'uncertain' END WHEN uneven AND (zero > 0 OR db > 0 OR mb > 0) THEN 'true' ELSE 'uncertain' END AS verdict FROM y"""
)
def verdict_indel_middle(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    ev = _evidence(spark, d).withColumns({"pairs_left": c("discor"), "pairs_right": c("high"), "ratio_left": c("discor_ratio") / 2, "ratio_right": c("multi") / 2, "dif_all": c("size") / 10.0, "discor_bins": c("zero") % 2, "multi_bins": c("low") % 2, "sd": F.lit(50.0), "insert": F.lit(300.0)})
    return ev.select("o", verdicts.middle_indel_verdict().alias("verdict"))


@query(_EVIDENCE + " SELECT o, CASE WHEN dis > 0 OR zero > 0 OR low > 1 OR high > 1 OR discor = 0 THEN 'true' WHEN discor >= 3 AND (size > 200 OR size > 60) THEN 'true' ELSE 'uncertain' END AS verdict FROM ev")
def verdict_indel(spark: SparkSession, d: str) -> DataFrame:
    ev = _evidence(spark, d).withColumns({"pairs": F.col("discor"), "dif": F.col("size"), "sd": F.lit(100.0), "insert": F.lit(300.0)})
    return ev.select("o", verdicts.end_indel_verdict().alias("verdict"))


@query(_EVIDENCE + " SELECT o, CASE WHEN dis >= 3 OR zero > 0 OR discor >= 1 THEN 'uncertain' ELSE 'sv' END AS misjoin, CASE WHEN ((zero > 0 OR discor > 0) AND (size > 200 OR size > 60)) OR dis >= 2 OR (dis = 1 AND size < 300 AND (zero > 0 OR discor > 0)) THEN 'uncertain' ELSE 'sv' END AS indel FROM ev")
def verdict_sv(spark: SparkSession, d: str) -> DataFrame:
    ev = _evidence(spark, d).withColumns({"discor_bins": F.col("discor"), "dif": F.col("size"), "sd": F.lit(100.0), "insert": F.lit(300.0)})
    return ev.select("o", verdicts.sv_misjoin().alias("misjoin"), verdicts.sv_indel().alias("indel"))


# evidence from coverage and mates

#: Insert size and its deviation of the reads below.
_INSERT, _SD = 320.5, 30.0


def _reads_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Placed reads (read_id, key, pos, orient, size, multi, base): the lines of an order are mates in pairs, 300 orders lie on one query."""
    c = F.col
    lines = t(spark, d, "lineitem").groupBy(c("l_orderkey").alias("o"), c("l_linenumber").cast("long").alias("i")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"), F.max("l_quantity").cast("long").alias("n"))
    second = c("i") % 2 == 0
    pos = c("o") * 37 % 3900 + 1 + F.floor((c("i") - 1) / 2) * 17 + F.when(second, 230 + c("n")).otherwise(0) + F.when(c("p") % 40 == 0, 400).otherwise(0)
    return lines.select(
        (c("o") * 8 + c("i")).alias("read_id"), (F.floor(c("o") / 300) + F.when(c("p") % 25 == 0, 1).otherwise(0)).cast("long").alias("key"), pos.cast("long").alias("pos"),
        F.when(second != (c("p") % 50 == 7), 1).otherwise(0).alias("orient"), (60 + c("s") % 30).alias("size"), (c("p") % 15 == 0).alias("multi"), F.when(c("p") % 90 == 1, "C").otherwise("A").alias("base"),
    )


def _regions_of_orders(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    o, digit = c("o_orderkey"), c("o_orderkey") % 10
    shape = F.when(digit == 0, "head").when(digit == 1, "tail").when(digit == 2, "whole").when(digit == 3, "inner").otherwise("middle")
    kind = F.when(digit >= 8, "misjoin").when(c("o_custkey") % 3 == 0, "insertion").when(c("o_custkey") % 3 == 1, "deletion").otherwise("gap")
    at = 20 + (o * 53 + c("o_custkey")) % 4600
    key = F.floor(o / 300).cast("long")
    size = 4800 + key % 7 * 50
    left = F.when(digit == 2, 1).otherwise(at)
    right = F.when(digit < 2, at + 1).when(digit == 2, size).otherwise(at + c("o_custkey") % 130 - 15)
    return t(spark, d, "orders").select(
        o.alias("rid"), key.alias("key"), size.alias("len"), shape.alias("shape"), kind.alias("kind"), left.cast("long").alias("left"), right.cast("long").alias("right"),
        (c("o_custkey") % 60).alias("dq"), (o % 60).alias("ds"), c("o_custkey").alias("subject"), at.alias("s_left"), (at + 9).alias("s_right"), (c("o_custkey") % 4 == 0).alias("in_gap"),
    )


def _evidence_of_orders(spark: SparkSession, d: str) -> DataFrame:
    stages = Stages(spark)
    reads, regions = stages.write(_reads_of_lines(spark, d), "reads"), _regions_of_orders(spark, d)
    coverage = pileup.span_steps(reads.withColumn("end", F.col("pos") + F.col("size") - 1), "key", "pos", "end", "base", lambda df: stages.write(df, "steps"))
    return assembly.gather_evidence(regions, regions.select("key", "len").distinct(), coverage, reads, _INSERT, _SD, stages)


_EVIDENCE_WINDOWS = """WITH lines AS (SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS i, max(l_partkey) AS p, max(l_suppkey) AS s, CAST(max(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
reads AS (SELECT o * 8 + i AS read_id, o // 300 + CASE WHEN p % 25 = 0 THEN 1 ELSE 0 END AS k, o * 37 % 3900 + 1 + (i - 1) // 2 * 17 + CASE WHEN i % 2 = 0 THEN 230 + n ELSE 0 END + CASE WHEN p % 40 = 0 THEN 400 ELSE 0 END AS pos,
  (i % 2 = 0) != (p % 50 = 7) AS minus, 60 + s % 30 AS size, p % 15 = 0 AS multi, p % 90 = 1 AS c FROM lines),
regs AS (SELECT o_orderkey AS rid, o_orderkey // 300 AS k, 4800 + o_orderkey // 300 % 7 * 50 AS len, CASE o_orderkey % 10 WHEN 0 THEN 'head' WHEN 1 THEN 'tail' WHEN 2 THEN 'whole' WHEN 3 THEN 'inner' ELSE 'middle' END AS shape,
  CASE WHEN o_orderkey % 10 >= 8 THEN 'misjoin' WHEN o_custkey % 3 = 0 THEN 'insertion' WHEN o_custkey % 3 = 1 THEN 'deletion' ELSE 'gap' END AS kind, 20 + (o_orderkey * 53 + o_custkey) % 4600 AS x,
  CASE WHEN o_orderkey % 10 = 2 THEN 1 ELSE 20 + (o_orderkey * 53 + o_custkey) % 4600 END AS l,
  CASE WHEN o_orderkey % 10 < 2 THEN 21 + (o_orderkey * 53 + o_custkey) % 4600 WHEN o_orderkey % 10 = 2 THEN 4800 + o_orderkey // 300 % 7 * 50 ELSE 5 + (o_orderkey * 53 + o_custkey) % 4600 + o_custkey % 130 END AS r,
  o_custkey % 60 AS dq, o_orderkey % 60 AS ds, o_custkey AS subject, o_custkey % 4 = 0 AS in_gap FROM orders),
bases AS (SELECT k, unnest(range(pos, pos + size)) AS p, c FROM reads),
cov AS (SELECT k, p, count(*) AS total, count(*) FILTER (c) AS c, count(*) FILTER (NOT c) AS a FROM bases GROUP BY k, p),
places AS (SELECT k, unnest(range(1, len + 1)) AS p FROM (SELECT DISTINCT k, len FROM regs)),
marks AS (SELECT k, p, coalesce(total, 0) AS total, CASE WHEN total IS NULL OR (10 * greatest(a, c) < 9 * total AND NOT (least(a, c) = 1 AND greatest(a, c) >= 4)) THEN 1 ELSE 0 END AS dis, CASE WHEN total IS NULL THEN 1 ELSE 0 END AS zero FROM places LEFT JOIN cov USING (k, p)),
means AS (SELECT k, avg(m) AS mean FROM (SELECT k, (p - 1) // 50 AS b, avg(total) AS m FROM marks GROUP BY ALL) GROUP BY k),
w AS (SELECT *, kind = 'misjoin' AS mj, least(l, r) AS lo, greatest(l, r) AS hi, 320.5 AS ins FROM regs),
main AS (SELECT rid, k, len, CASE WHEN mj THEN 0 WHEN shape = 'head' THEN 1 WHEN shape = 'tail' THEN 2 ELSE 0 END AS skip,
  greatest(1, CAST(floor(CASE WHEN mj THEN lo - 3 * ins WHEN shape = 'head' THEN r - 1 - ins ELSE l - ins END) AS BIGINT)) AS a, least(len, CAST(floor(CASE WHEN mj THEN hi + 3 * ins WHEN shape = 'tail' THEN l + 1 + ins ELSE r + ins END) AS BIGINT)) AS b FROM w WHERE mj OR shape != 'whole'),
main_p AS (SELECT rid, k, len, skip, a, b, unnest(range(a, b + 1)) AS p FROM main),
bins AS (SELECT rid, (p - a) // 50 AS n, any_value(k) AS k, any_value(len) AS len, any_value(skip) AS skip, any_value(a) AS a, any_value(b) AS b, count(*) AS width, sum(total) / count(*) AS depth, sum(dis) AS dis, sum(zero) AS zero FROM main_p JOIN marks USING (k, p) GROUP BY ALL),
ok AS (SELECT *, a > 500 AND b <= len - 499 AND (skip = 0 OR (skip = 1 AND n > 0) OR (skip = 2 AND a + n * 50 + 49 <= b - 50)) AS counted FROM bins JOIN means USING (k)),
cover AS (SELECT rid, sum(dis) AS dis, sum(zero) AS zero, sum(CASE WHEN dis > 0 THEN width ELSE 0 END) AS size, count(*) FILTER (counted AND depth > 1.5 * mean) AS high, count(*) FILTER (counted AND depth < 0.5 * mean) AS low FROM ok GROUP BY rid),
mates AS (SELECT x.*, x.pos + x.size // 2 - 1 AS mid, y.pos + y.size // 2 AS mate_mid, coalesce(x.k = y.k, false) AS same,
  CASE WHEN x.k = y.k AND NOT x.minus AND y.minus AND x.pos <= y.pos THEN y.pos + y.size - x.pos WHEN x.k = y.k AND x.minus AND NOT y.minus AND x.pos >= y.pos THEN x.pos + x.size - y.pos END AS span
  FROM reads x LEFT JOIN reads y ON y.read_id = xor(x.read_id - 1, 1) + 1),
m AS (SELECT *, same AND coalesce(abs(span - 320.5) > 90, true) AS discor FROM mates),
fw AS (SELECT rid, k, l, r, len, shape, greatest(1, CAST(floor((CASE WHEN shape = 'head' THEN r - 1 ELSE l END) - ins) AS BIGINT)) AS la, least(len, CASE WHEN shape = 'head' THEN r - 1 ELSE l END) AS lb,
  greatest(1, CASE WHEN shape = 'tail' THEN l + 1 ELSE r END) AS ra, least(len, CAST(floor((CASE WHEN shape = 'tail' THEN l + 1 ELSE r END) + ins) AS BIGINT)) AS rb,
  CAST(floor(l - ins) AS BIGINT) AS sa, CAST(floor(r + ins) AS BIGINT) AS sb FROM w WHERE NOT mj),
fx AS (SELECT *, greatest(1, sa) AS sla, least(len, (sa + sb) // 2) AS slb, greatest(1, (sa + sb) // 2 + 1) AS sra, least(len, sb) AS srb FROM fw),
sides AS (SELECT rid, k, 'left' AS u, true AS fwd, la AS a, lb AS b FROM fx WHERE shape != 'tail' UNION ALL SELECT rid, k, 'right', false, ra, rb FROM fx WHERE shape != 'head' UNION ALL SELECT rid, k, 'sv_left', true, sla, slb FROM fx UNION ALL SELECT rid, k, 'sv_right', false, sra, srb FROM fx),
f AS (SELECT rid, u, count(*) FILTER (over) AS pairs, sum(span) FILTER (over) AS bases, count(*) FILTER (discor) AS discor
  FROM (SELECT s.rid, s.u, m.span, m.discor, m.span IS NOT NULL AND CASE WHEN fwd THEN NOT minus AND mate_mid > b ELSE minus AND mate_mid < a END AS over FROM sides s JOIN m ON m.k = s.k AND m.mid BETWEEN s.a AND s.b) GROUP BY ALL),
frag AS (SELECT rid, u, pairs, coalesce(bases / nullif(pairs, 0), 0) AS frag, coalesce(discor / nullif(pairs, 0), 0) AS ratio FROM f),
tw AS (SELECT rid, k, len, shape, mj, 'tile' AS u, greatest(1, CAST(floor(CASE WHEN r - l < ins THEN l - ins ELSE l END) AS BIGINT)) AS a, least(len, CAST(floor(CASE WHEN r - l < ins THEN r + ins ELSE r END) AS BIGINT)) AS b FROM w WHERE NOT mj AND shape NOT IN ('head', 'tail')
  UNION ALL SELECT rid, k, len, shape, mj, 'sv', greatest(1, CASE WHEN mj THEN lo - 300 WHEN shape = 'head' THEN 1 WHEN shape IN ('tail', 'middle') THEN lo - 200 ELSE l END), least(len, CASE WHEN mj THEN hi + 300 WHEN shape = 'tail' THEN len WHEN shape IN ('head', 'middle') THEN hi + 200 ELSE r END) FROM w),
tn AS (SELECT *, (b - a) // 500 + 1 AS nt, (b - a + 1) // ((b - a) // 500 + 1) + 1 AS width FROM tw WHERE a <= b),
tiles AS (SELECT * FROM (SELECT *, unnest(range(0, nt)) AS n FROM tn) WHERE a + n * width <= b),
tx AS (SELECT *, a + n * width AS ta, least(a + n * width + width - 1, b) AS tb, count(*) OVER (PARTITION BY rid, u) AS tiles FROM tiles),
tf AS (SELECT *, min((ta + tb) // 2) OVER (PARTITION BY rid, u) AS fm, max((ta + tb) // 2) OVER (PARTITION BY rid, u) AS lm FROM tx),
ts AS (SELECT *, CASE WHEN u = 'tile' OR mj THEN 0 WHEN shape IN ('head', 'inner', 'whole') OR fm + 1 < 500 THEN 1 ELSE 0 END AS s1, CASE WHEN u = 'tile' OR mj THEN 0 WHEN shape IN ('tail', 'inner', 'whole') OR lm > len - 500 THEN 1 ELSE 0 END AS s2 FROM tf),
tk AS (SELECT *, least(s1, tiles - 1) AS q1, greatest(tiles - s2 - 1, 0) AS q2 FROM ts),
tcov AS (SELECT rid, u, n, sum(dis) AS dis, sum(zero) AS zero FROM (SELECT rid, u, n, k, unnest(range(ta, tb + 1)) AS p FROM tk) JOIN marks USING (k, p) GROUP BY ALL),
tm AS (SELECT t.rid, t.u, t.n, count(*) FILTER (same) AS paired, count(*) FILTER (discor) AS discor, count(*) FILTER (multi) AS multi, count(*) AS reads FROM tk t JOIN m ON m.k = t.k AND m.mid BETWEEN t.ta AND t.tb GROUP BY ALL),
tt AS (SELECT rid, u, sum(dis) AS t_dis, sum(zero) AS t_zero, count(*) FILTER (discor >= 3 AND discor > 0.1 * paired) AS discor_bins, count(*) FILTER (multi > 0.05 * reads) AS multi_bins
  FROM tk JOIN tcov USING (rid, u, n) LEFT JOIN tm USING (rid, u, n) WHERE n BETWEEN least(q1, q2) AND greatest(q1, q2) GROUP BY ALL),
jw AS (SELECT rid, k, greatest(1, CASE WHEN l <= r THEN l - 100 ELSE r - 300 END) AS a, least(len, CASE WHEN l <= r THEN r + 100 ELSE l + 300 END) AS b FROM w WHERE mj),
jr AS (SELECT j.rid, m.same, m.discor, m.multi FROM jw j JOIN m ON m.k = j.k AND m.mid BETWEEN j.a AND j.b QUALIFY row_number() OVER (PARTITION BY m.read_id ORDER BY j.a DESC, j.rid DESC) = 1),
j AS (SELECT rid, count(*) FILTER (discor) AS discor, coalesce(count(*) FILTER (discor) / nullif(count(*) FILTER (same), 0), 0) AS discor_ratio, count(*) FILTER (multi) / count(*) AS multi, count(*) FILTER (NOT same) / count(*) AS other FROM jr GROUP BY rid),
ev AS (SELECT w.rid, w.k, w.len, w.shape, w.kind, w.l, w.r, w.lo, w.hi, w.x, w.mj, w.dq, w.ds, w.subject, w.in_gap, coalesce(c.dis, 0) AS dis, coalesce(c.zero, 0) AS zero, coalesce(c.size, 0) AS size, coalesce(c.high, 0) AS high, coalesce(c.low, 0) AS low,
  coalesce(fl.pairs, 0) AS pairs_left, coalesce(fl.frag, 0) AS frag_left, coalesce(fl.ratio, 0) AS ratio_left, coalesce(fr.pairs, 0) AS pairs_right, coalesce(fr.frag, 0) AS frag_right, coalesce(fr.ratio, 0) AS ratio_right,
  coalesce(t1.t_dis, 0) AS t_dis, coalesce(t1.t_zero, 0) AS t_zero, coalesce(t1.discor_bins, 0) AS discor_bins, coalesce(t1.multi_bins, 0) AS multi_bins,
  coalesce(j.discor, 0) AS discor, coalesce(j.discor_ratio, 0) AS discor_ratio, coalesce(j.multi, 0) AS multi, coalesce(j.other, 0) AS other,
  coalesce(t2.t_dis, 0) AS sv_t_dis, coalesce(t2.t_zero, 0) AS sv_t_zero, coalesce(t2.discor_bins, 0) AS sv_discor_bins, coalesce(t2.multi_bins, 0) AS sv_multi_bins,
  coalesce(sl.pairs, 0) AS sv_pairs_left, coalesce(sl.frag, 0) AS sv_frag_left, coalesce(sl.ratio, 0) AS sv_ratio_left, coalesce(sr.pairs, 0) AS sv_pairs_right, coalesce(sr.frag, 0) AS sv_frag_right, coalesce(sr.ratio, 0) AS sv_ratio_right
  FROM w LEFT JOIN cover c USING (rid) LEFT JOIN frag fl ON fl.rid = w.rid AND fl.u = 'left' LEFT JOIN frag fr ON fr.rid = w.rid AND fr.u = 'right' LEFT JOIN frag sl ON sl.rid = w.rid AND sl.u = 'sv_left' LEFT JOIN frag sr ON sr.rid = w.rid AND sr.u = 'sv_right'
  LEFT JOIN tt t1 ON t1.rid = w.rid AND t1.u = 'tile' LEFT JOIN tt t2 ON t2.rid = w.rid AND t2.u = 'sv' LEFT JOIN j ON j.rid = w.rid)"""

_COUNTS = ("dis", "zero", "size", "high", "low", "pairs_left", "pairs_right", "t_dis", "t_zero", "discor_bins", "multi_bins", "discor", "sv_t_dis", "sv_t_zero", "sv_discor_bins", "sv_multi_bins", "sv_pairs_left", "sv_pairs_right")
_RATIOS = ("frag_left", "ratio_left", "frag_right", "ratio_right", "discor_ratio", "multi", "other", "sv_frag_left", "sv_ratio_left", "sv_frag_right", "sv_ratio_right")


@query(_EVIDENCE_WINDOWS + " SELECT rid, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _COUNTS) + ", " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _RATIOS) + " FROM ev")
def evidence_windows(spark: SparkSession, d: str) -> DataFrame:
    """All evidence of every order's region, from the coverage and the mates of the line items."""
    return _evidence_of_orders(spark, d).select("rid", *[F.col(c).cast("long").alias(c) for c in _COUNTS], *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _RATIOS])


@query(
    _EVIDENCE_WINDOWS
    + """, y AS (SELECT *, low > 0 OR high > 0 AS uneven, CASE WHEN shape = 'head' THEN pairs_left ELSE pairs_right END AS pairs, CASE WHEN pairs_left > 0 THEN frag_left - 320.5 ELSE 0 END AS dl, CASE WHEN pairs_right > 0 THEN frag_right - 320.5 ELSE 0 END AS dr FROM ev),
    z AS (SELECT *, abs(CASE WHEN shape = 'head' THEN dl ELSE dr END) AS dif, abs(dq - ds - (dl + dr) / 2) AS da FROM y),
    v AS (SELECT *, CASE WHEN mj THEN CASE WHEN zero > 3 OR ((dis > 1 OR zero > 0 OR high > 3 OR low > 3) AND discor >= 3 AND discor_ratio > 0.1) THEN 'true' WHEN dis >= 1 AND (zero > 0 OR uneven OR size // dis < 500) THEN 'true' WHEN (multi > 0.1 OR other > 0.1) AND NOT (lo < 200 OR hi > len - 200) THEN 'true' ELSE 'uncertain' END
      WHEN shape IN ('head', 'tail') THEN CASE WHEN dis > 0 OR zero > 0 OR low > 1 OR high > 1 OR pairs = 0 OR (pairs >= 3 AND (dif > 60 OR dif > 64.1)) THEN 'true' ELSE 'uncertain' END
      WHEN shape = 'whole' THEN CASE WHEN pairs_left = 0 OR pairs_right = 0 OR t_dis >= 3 OR t_zero > 0 OR discor_bins > 0 THEN 'true' ELSE 'uncertain' END
      WHEN zero > 0 OR pairs_left < 3 OR pairs_right < 3 THEN 'true'
      WHEN da < 60 OR da < 64.1 OR ratio_left > 0.1 OR ratio_right > 0.1 THEN CASE WHEN dis > 0 OR low > 1 OR high > 1 OR ratio_left > 0.2 OR ratio_right > 0.2 OR ((ratio_left > 0.1 OR ratio_right > 0.1) AND (uneven OR ((da < 30 OR da < 32.05) AND (discor_bins > 0 OR multi_bins > 0)))) OR (ratio_left > 0.05 AND ratio_right > 0.05 AND multi_bins > 0) THEN 'true' ELSE 'uncertain' END
      WHEN dis > 0 THEN CASE WHEN size // dis < 1000 OR uneven THEN 'true' ELSE 'uncertain' END WHEN uneven AND (discor_bins > 0 OR multi_bins > 0) THEN 'true' ELSE 'uncertain' END AS first,
      CASE WHEN sv_pairs_left > 0 OR sv_pairs_right > 0 THEN abs((sv_frag_left + sv_frag_right) / 2 - 320.5) ELSE 0 END AS moved FROM z),
    s AS (SELECT *, CASE WHEN first != 'uncertain' THEN first WHEN mj THEN CASE WHEN sv_t_dis >= 3 OR sv_t_zero > 0 OR sv_discor_bins >= 1 THEN 'uncertain' ELSE 'sv' END
      WHEN ((sv_t_zero > 0 OR sv_discor_bins > 0) AND (moved > 60 OR moved > 64.1)) OR sv_t_dis >= 2 OR (sv_t_dis = 1 AND size < 300 AND (sv_t_zero > 0 OR sv_discor_bins > 0)) THEN 'uncertain' ELSE 'sv' END AS verdict FROM v),
    o AS (SELECT *, CASE WHEN verdict = 'true' AND in_gap AND NOT mj THEN 'gap' WHEN verdict = 'true' THEN 'errors' WHEN verdict = 'sv' THEN 'sv' ELSE 'warning' END AS result, CASE WHEN kind != 'gap' THEN kind WHEN dq > ds THEN 'insertion' ELSE 'deletion' END AS name, NOT mj AND shape IN ('middle', 'inner') AS placed FROM s)
    SELECT rid, k AS key, verdict, result, CASE result WHEN 'errors' THEN 'err' WHEN 'warning' THEN 'uncertain' ELSE result END || '_' || name AS mis_kind, CASE WHEN shape = 'head' AND NOT mj THEN 1 WHEN shape = 'tail' AND NOT mj THEN r ELSE lo END AS q_start,
    CASE WHEN shape = 'head' AND NOT mj THEN l WHEN shape = 'tail' AND NOT mj THEN len ELSE hi END AS q_end, CASE WHEN placed THEN x END AS s_start, CASE WHEN placed THEN x + 9 END AS s_end, CASE WHEN placed THEN subject END AS subject FROM o"""
)
def region_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdict and result row of every order's region by the evidence of the line items."""
    judged = Stages(spark).write(assembly.judge(_evidence_of_orders(spark, d), _INSERT, _SD), "judged")  # read twice
    return verdicts.result_regions(judged).join(judged.select("rid", "verdict"), "rid")


@query(
    _EVIDENCE_WINDOWS
    + """, lens AS (SELECT DISTINCT k, len FROM regs), tt2 AS (SELECT k, len, (len - 1) // 500 + 1 AS nt, len // ((len - 1) // 500 + 1) + 1 AS width FROM lens),
    t2 AS (SELECT * FROM (SELECT *, unnest(range(0, nt)) AS n FROM tt2) WHERE 1 + n * width <= len), t3 AS (SELECT k, n, 1 + n * width AS lo, least(n * width + width, len) AS hi FROM t2),
    r2 AS (SELECT t3.k, n, count(*) FILTER (discor) AS d, count(*) FILTER (same) AS s, count(*) FILTER (multi) AS u, count(*) AS c FROM t3 JOIN m ON m.k = t3.k AND m.mid BETWEEN lo AND hi GROUP BY ALL),
    z2 AS (SELECT k, p, p - row_number() OVER (PARTITION BY k ORDER BY p) AS g FROM marks WHERE zero = 1)
    SELECT k AS key, 'coverage' AS track, min(p) AS lo, max(p) AS hi, round(least(avg(total), 200), 6) AS value FROM marks GROUP BY k, (p - 1) // 50
    UNION ALL SELECT k, 'uncovered', min(p), max(p), 0 FROM z2 GROUP BY k, g
    UNION ALL SELECT k, 'disagreement', p, p, total FROM marks WHERE dis = 1 AND zero = 0
    UNION ALL SELECT t3.k, 'discordant', lo, hi, round(coalesce(d / nullif(s, 0), 0), 6) FROM t3 LEFT JOIN r2 USING (k, n) UNION ALL SELECT t3.k, 'ambiguous', lo, hi, round(coalesce(u / nullif(c, 0), 0), 6) FROM t3 LEFT JOIN r2 USING (k, n)"""
)
def drawing_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Coverage, uncovered and disagreeing positions and mate ratios of the queries that the orders' regions lie on."""
    stages = Stages(spark)
    reads = stages.write(_reads_of_lines(spark, d), "reads").withColumn("end", F.col("pos") + F.col("size") - 1)
    lengths = stages.write(_regions_of_orders(spark, d).select("key", "len").distinct(), "lengths")
    stretches = stages.write(pileup.span_steps(reads, "key", "pos", "end", "base", lambda df: stages.write(df, "steps")), "coverage")  # a row for each step of the depth, read by two tracks
    coverage = pileup.stepped(stretches, "key").join(lengths, "key").where("pos <= len").drop("len")
    spans = reads.select("key", F.col("pos").alias("lo"), F.col("end").alias("hi"))
    drawn = tracks.coverage_track(coverage, lengths).unionByName(tracks.uncovered_track(spans, lengths)).unionByName(tracks.disagreement_track(coverage))
    every = drawn.unionByName(tracks.ratio_tracks(evidence.placed_mates(reads, _INSERT, _SD), lengths))
    return every.withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey AS o, CASE WHEN bool_or(l_returnflag = 'R' AND (l_linestatus = 'F' OR l_linenumber % 2 = 1)) THEN 'true' ELSE 'uncertain' END AS verdict FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1")
def query_verdict(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "lineitem").where("l_linestatus in ('F', 'O')")
    regions = lines.select(F.col("l_orderkey").alias("o"), F.when(F.col("l_returnflag") == "R", "true").otherwise("uncertain").alias("verdict"), F.when(F.col("l_linestatus") == "F", "misjoin").otherwise("insertion").alias("kind"), (F.col("l_linenumber") % 2 == 0).alias("in_gap"))
    return verdicts.query_verdict(regions, "o")


@query(
    """WITH c AS (SELECT conv_id AS k, turn * 100 + 50 AS "left", turn * 100 + 60 AS "right" FROM conversations), n AS (SELECT k, 100 * count(*) + 100 AS len FROM c GROUP BY k),
    p AS (SELECT k, row_number() OVER w AS piece, coalesce(lag("left") OVER w, 1) AS lo, "right" AS hi FROM c WINDOW w AS (PARTITION BY k ORDER BY "left"))
    SELECT * FROM p UNION ALL SELECT c.k, count(*) + 1, max("left"), max(len) FROM c JOIN n ON c.k = n.k GROUP BY c.k"""
)
def split_pieces(spark: SparkSession, d: str) -> DataFrame:
    cuts = t(spark, d, "conversations").select(F.col("conv_id").alias("k"), (F.col("turn") * 100 + 50).alias("left"), (F.col("turn") * 100 + 60).alias("right"))
    whole = cuts.groupBy("k").agg((100 * F.count("*") + 100).alias("len"))
    return verdicts.split_pieces(cuts, whole, "k", "len").withColumn("piece", F.col("piece").cast("long"))


@query("WITH a AS (SELECT doc_id AS id, length(text) AS n, 'documents' AS src FROM documents UNION ALL SELECT page_id, length(html), 'pages' FROM pages UNION ALL SELECT item_id, length(text), 'benchmark' FROM benchmark) SELECT src, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars FROM a GROUP BY src")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    parts = [t(spark, d, name).select(F.length(text).alias("c"), F.lit(name).alias("src")) for name, text in (("documents", "text"), ("pages", "html"), ("benchmark", "text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


@query()
def align_dp(spark: SparkSession, d: str) -> DataFrame:
    """Each whole item against its whole successor: the best overlap with free ends."""
    items = _items(spark, d)
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("seq").alias("b"))
    pairs = items.select("item_id", F.col("seq").alias("a")).join(after, "item_id")
    out = pairs.withColumn("o", alignment.overlap_alignment(F.col("a"), F.col("b")))
    return out.select("item_id", "o.score", "o.mismatches", alignment.gap_counts(F.col("o.row1"), F.col("o.row2")).alias("g")).select("item_id", "score", "mismatches", "g.gaps1", "g.gaps2")

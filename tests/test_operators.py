"""Rules by hand: each case follows from a decision table."""

import random

import pytest
from pyspark.sql import functions as F

from kontig.functions import sequences as sq
from kontig.operators import alignment, chaining, intervals, kmers, lengths, pileup, reference, verdicts
from kontig.plans import assembly, table_queries
from kontig.sources import sinks, text_formats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("lens, want", [([500, 400, 300, 200, 100, 50], (5, 1500, 500, 300.0, 400, 300)), ([400, 300, 200, 100], (4, 1000, 400, 250.0, 300, 200))])
def test_length_metrics(spark, lens, want):
    assert tuple(lengths.length_metrics(spark.createDataFrame([(n,) for n in lens], "len long"), "len").first()) == want


def test_sequence_functions(spark):
    assert one(spark, sq.gc_ratio(F.col("s")), s="ACGTNacgt.") == 0.5
    assert one(spark, sq.reverse_complement(F.col("s")), s="AACGTN") == "NACGTT"
    for s, want in (("AAAAAAAACC", True), ("AAAAAAAAAC", False), ("aaaaaaaaaa", True), ("ACGTN", False)):
        assert one(spark, sq.read_valid(F.col("s")), s=s) is want
    assert one(spark, sq.replace_unknown(F.col("s")), s="ACGTN") == "ACGTC"
    assert one(spark, sq.unpack(sq.pack(F.col("s")), 6), s="AACGTT") == "AACGTT"
    assert one(spark, sq.reverse_complement(sq.reverse_complement(F.col("s"))), s="ACGTTGCA") == "ACGTTGCA"


@pytest.mark.parametrize("n, want", [(60, [1, 26, 36]), (50, [1, 26]), (49, [1, 25]), (48, [1, 24]), (24, [])])
def test_kmer_tiles(spark, n, want):
    df = spark.createDataFrame([(1, "A" * n)], "id int, seq string")
    assert sorted(r.pos for r in kmers.tiles(df, "id", "seq").collect()) == want


def seg(q1, q2, s1, s2, match, total, hsp=1, strand=0):
    return dict(q_start=q1, q_end=q2, s_start=s1, s_end=s2, match_len=match, total_len=total, hsp=hsp, strand=strand)


@pytest.mark.parametrize(
    "n, segs, want",
    [
        (1000, [seg(1, 1000, 1, 1000, 1000, 1000)], 0),
        (1000, [seg(1, 1000, 1, 1000, 950, 1000)], 1),
        (1000, [seg(1, 1000, 1, 1000, 850, 1000)], 3),
        (200, [seg(1, 200, 1, 200, 150, 200)], 1),
        (1000, [seg(1, 500, 1, 500, 500, 500), seg(501, 1000, 501, 1000, 500, 500, 2)], 1),
        (1000, [seg(1, 500, 1, 500, 500, 500), seg(501, 1000, 10001, 10500, 500, 500, 2)], 2),
        (1000, [], 3),
    ],
)
def test_match_kind(n, segs, want):
    assert chaining.match_kind(n, segs) == want


@pytest.mark.parametrize("counts, want", [((9, 1, 0, 0, 0), (False, False)), ((8, 1, 0, 0, 0), (False, False)), ((8, 2, 0, 0, 0), (True, False)), ((3, 1, 0, 0, 0), (True, False)), ((0, 0, 0, 0, 0), (True, True))])
def test_disagreement(spark, counts, want):
    df = spark.createDataFrame([(*counts, sum(counts))], "a long, c long, g long, t long, n long, total long")
    row = pileup.disagreement(df).first()
    assert (row.disagree, row.zero) == want


def test_bins(spark):
    cov = [(1, p, 10 if p <= 50 else 20 if p <= 100 else 30) for p in range(1, 121)]
    stats = pileup.bin_statistics(pileup.bin_means(spark.createDataFrame(cov, "k int, pos long, total long"), "k", "pos", "total"), "k").first()
    assert (stats.bins, stats["mean"], round(stats.sd, 6)) == (3, 20.0, 8.164966)


def test_region_tiles(spark):
    df = spark.createDataFrame([(1, 1000)], "lo long, hi long")
    assert [tuple(r) for r in intervals.tiles(df, "lo", "hi", 500).select("tile_lo", "tile_hi", "tile_mid").collect()] == [(1, 501, 251), (502, 1000, 751)]


@pytest.mark.parametrize("q, s, want", [(511, 501, "insertion"), (501, 512, "deletion"), (520, 530, "gap"), (501, 501, None), (501, 10001, "misjoin")])
def test_breakpoints(spark, q, s, want):
    df = spark.createDataFrame([(1, 1, 0, 1, 500, 1, 500), (1, 1, 0, q, q + 499, s, s + 499)], "k int, subject int, strand int, q_start long, q_end long, s_start long, s_end long")
    assert [r.kind for r in verdicts.breakpoints(df, "k").collect()] == ([want] if want else [])


def test_breakpoints_all_takes_every_line(spark, tmp_path):
    rows = [(1, o, 1, "N", p, 10.0, tax) for o, p, tax in ((1, 100, 0.0), (3, 120, 0.08), (5, 6000, 0.0), (7, 6100, 0.05))]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber long, l_returnflag string, l_partkey long, l_quantity double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.kind: (r.n, r.dq) for r in table_queries.breakpoints_all(spark, str(tmp_path)).collect()}
    assert got == {"gap": (2, 20), "misjoin": (1, 10)}  # one step between each two neighbours


@pytest.mark.parametrize(
    "values, want",
    [((4, 4, 50, 0, 0, 0, 0.0, 0.0, 0.0, False), "true"), ((0, 2, 1000, 0, 0, 3, 0.2, 0.0, 0.0, False), "true"), ((0, 1, 50, 0, 0, 0, 0.0, 0.0, 0.0, False), "true"), ((0, 0, 0, 0, 0, 0, 0.0, 0.2, 0.0, False), "true"), ((0, 0, 0, 0, 0, 0, 0.0, 0.2, 0.0, True), "uncertain"), ((0, 0, 0, 3, 0, 5, 0.5, 0.0, 0.0, False), "uncertain")],
)
def test_misjoin_verdict(spark, values, want):
    df = spark.createDataFrame([values], "zero int, dis int, size int, high int, low int, discor int, discor_ratio double, multi double, other double, at_end boolean")
    assert df.select(verdicts.misjoin_verdict()).first()[0] == want


@pytest.mark.parametrize("dis, zero, bins, want", [(2, 0, 0, "sv"), (3, 0, 0, "uncertain"), (0, 1, 0, "uncertain"), (0, 0, 1, "uncertain")])
def test_sv_misjoin(spark, dis, zero, bins, want):
    assert spark.createDataFrame([(dis, zero, bins)], "dis int, zero int, discor_bins int").select(verdicts.sv_misjoin()).first()[0] == want


def test_split(spark):
    cuts = spark.createDataFrame([(1, 300, 320), (1, 600, 610)], "k int, left long, right long")
    whole = spark.createDataFrame([(1, 1000)], "k int, len long")
    got = sorted(tuple(r) for r in verdicts.split_pieces(cuts, whole, "k", "len").select("piece", "lo", "hi").collect())
    assert got == [(1, 1, 320), (2, 300, 610), (3, 600, 1000)]


def test_overlap():
    assert alignment.overlap("ACGT", "CGT") == ("CGT", "CGT", 3, 0)
    assert alignment.overlap("", "A") == ("", "", 0, 0)


def best_overlap(a, b):
    """The best score by plain recursion from every free begin to every free end."""
    from functools import cache

    from kontig.params import GAP, MATCH, MISMATCH

    @cache
    def upto(i, j):
        if not i or not j:
            return 0
        return max(upto(i - 1, j - 1) + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), upto(i - 1, j) + GAP, upto(i, j - 1) + GAP)

    return max([upto(len(a), j) for j in range(len(b) + 1)] + [upto(i, len(b)) for i in range(len(a) + 1)])


def test_align_dp_takes_whole_items(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = text(200)  # longer than the 120 bases that were aligned once
    texts = [text(60) + shared, shared[:90] + "q" + shared[91:] + text(50), text(30), text(140)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.item_id: r for r in table_queries.align_dp(spark, str(tmp_path)).collect()}
    seqs = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sq.dna(F.col("t")).alias("s")).collect()]
    assert {i: r.score for i, r in got.items()} == {i: best_overlap(seqs[i], seqs[i + 1]) for i in range(3)}
    assert got[0].score > 120 and (got[0].gaps1, got[0].gaps2) == (0, 0)


def test_exact_map_whole(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    head, read, short = text(75), text(83), text(30)
    docs = [(0, head + text(60)), (1, head + text(60)), (50, read), (2, text(7) + read + text(11) + read), (3, read[:-1]), (100, text(20)), (150, short), (4, text(9) + short + short)]
    spark.createDataFrame([(*r, "en") for r in docs], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in table_queries.exact_map_whole(spark, str(tmp_path)).select("read_id", "doc_id", "diag", "n").collect())
    assert got == [(0, 0, 0, 6), (50, 2, 7, 4), (50, 2, 101, 4), (50, 50, 0, 4), (150, 4, 9, 2), (150, 4, 39, 2), (150, 150, 0, 2)]
    tiled = {(r.read_id, r.doc_id) for r in table_queries.exact_map_intersect(spark, str(tmp_path)).collect()}
    assert {(0, 0), (50, 50)} <= tiled and (0, 1) not in tiled  # the first tiles alone are no hit


def test_exact_map_intersect_reads_every_document(spark, tmp_path):
    rng = random.Random(14)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    read = text(75)
    docs = [(7, read), (8, read), (9, read + text(50)), (50, text(60)), (51, text(20))]  # one of them with an id that 50 divides
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in table_queries.exact_map_intersect(spark, str(tmp_path)).select("read_id", "doc_id", "diag").collect()}
    assert got == {(a, b, 0) for a in (7, 8) for b in (7, 8, 9)} | {(9, 9, 0), (50, 50, 0)}
    assert "% 50" not in table_queries.ORACLE_SQL["exact_map_intersect"]


def test_tiles_in_blocks(spark):
    rng = random.Random(8)
    seqs = {i: "".join(rng.choices("ACGT", k=n)) for i, n in enumerate([24, 25, 26, 49, 50, 60, 4095, 4096, 4100, 4101, 8192, 8200, 8217, 20_011])} | {90: None, 91: ""}
    df = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    for step in (None, 1, 7):
        want = set()
        for i, s in seqs.items():
            n = len(s or "")
            starts = set(range(0, n - 24, step or 25)) | ({n - 25} if step is None and n >= 25 else set())
            want |= {(i, p + 1, s[p : p + 25]) for p in starts}
        got = [tuple(r) for r in kmers.tiles(df, "id", "seq", step=step).collect()]
        assert len(got) == len(want) and set(got) == want
    cut = kmers.runs(spark.createDataFrame([(1, "NNACGTNacgtA.T"), (2, "NN"), (3, None)], "id long, seq string"), "id", "seq")
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 2, "ACGT"), (1, 7, "acgtA"), (1, 13, "T")]


def test_classification_fixtures(spark):
    """The match kinds by hand, as pairs and for whole queries."""
    seg = lambda q, s, n, hsp, q0, s0, hit, total: (q, s, n, hsp, q0, q0 + total - 1, s0, s0 + total - 1, 0, hit, total)
    rows = [
        seg(1, 1, 1000, 1, 1, 1, 1000, 1000), seg(2, 1, 1000, 1, 1, 1, 950, 1000), seg(3, 1, 1000, 1, 1, 1, 850, 1000), seg(4, 1, 200, 1, 1, 1, 150, 200),
        seg(5, 1, 1000, 1, 1, 1, 500, 500), seg(5, 1, 1000, 2, 501, 501, 500, 500), seg(6, 1, 1000, 1, 1, 1, 500, 500), seg(6, 1, 1000, 2, 501, 10001, 500, 500),
    ]
    names = "query_id long, subject_id long, query_len long, hsp long, q_start long, q_end long, s_start long, s_end long, strand int, match_len long, total_len long"
    kinds = {r.query_id: r.kind for r in chaining.classify_pairs(spark.createDataFrame(rows, names)).collect()}
    assert kinds == {1: 0, 2: 1, 3: 3, 4: 1, 5: 1, 6: 2}
    pairs = [(1, 1, 1, 900, 950, 1, 950, 1000), (2, 1, 0, 1000, 1000, 1, 1000, 1000), (2, 2, 3, 100, 100, 1, 1000, 1000), (3, 1, 1, 900, 950, 1, 990, 1000), (3, 2, 3, 50, 60, 0, 990, 1000), (4, 1, 3, 500, 520, 1, 950, 1000), (4, 2, 3, 400, 410, 1, 950, 1000), (5, 1, 3, 500, 520, 0, 950, 1000), (5, 2, 3, 400, 410, 0, 950, 1000), (6, 1, 3, 300, 300, 1, 950, 1000)]
    got = chaining.global_kind(spark.createDataFrame(pairs, "query_id long, subject_id long, kind int, weight long, total long, good int, covered long, query_len long"))
    assert {r.query_id: r.kind for r in got.collect()} == {1: 1, 2: 0, 3: 2, 4: 2, 5: 3, 6: 3}


def test_merged_misjoins_equal_a_loop(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        at = 0
        for _ in range(rng.randint(1, 12)):
            at += rng.choice([10, 40, 200, 700, 1500])
            rows.append((k, at, at + rng.choice([5, 300, 900])))
    want = []
    for k in range(40):
        done = []
        for _, left, right in sorted(r for r in rows if r[0] == k):
            if done and (right - done[-1][0] < 1000 or left - done[-1][1] < 50):
                done[-1] = (min(done[-1][0], left), max(done[-1][1], right), done[-1][2] + 1)
            else:
                done.append((left, right, 1))
        want += [(k, *x) for x in done]
    got = verdicts.merge_misjoins(spark.createDataFrame(rows, "k long, left long, right long"), "k")
    assert sorted(tuple(r) for r in got.select("k", "left", "right", "n").collect()) == sorted(want)


def test_reference_flags_and_ratio(spark):
    rows = [(1, 11, "ACG-TA", "ACTA-A"), (1, 12, "TC", "CC")]
    got = {(r.s, r.pos): r.flag for r in reference.base_flags(spark.createDataFrame(rows, "s long, at long, q string, r string"), "s", "at", "q", "r").collect()}
    assert got == {(1, 11): 1, (1, 12): 1, (1, 13): 1, (1, 14): 27, (1, 15): 1}
    spans = spark.createDataFrame([(1, 1, 10), (1, 5, 20), (2, 3, 3)], "s long, lo long, hi long")
    sizes = spark.createDataFrame([(1, 40), (2, 10), (3, 50)], "s long, n long")
    ratio = {r.s: (r.covered, r.ratio) for r in reference.covered_ratio(spans, sizes, "s", "n").collect()}
    assert ratio == {1: (20, 0.5), 2: (1, 0.1), 3: (0, 0.0), None: (21, 0.21)}


def test_files_and_correction(spark, tmp_path):
    fasta = tmp_path / "q.fa"
    fasta.write_text(">q1\tx\nACGT\nac.n\n>q2\nGGGG\n")
    got = {r.title: r.seq for r in text_formats.read_fasta(spark, str(fasta)).collect()}
    assert got == {"q1": "ACGTACNN", "q2": "GGGG"}
    fastq = tmp_path / "r.fq"
    fastq.write_text("@a\nACGT\n+\nIIII\n@b\nGG\n+\nII\n")
    reads = text_formats.read_fastq(spark, str(fastq))
    assert [(r.name, r.seq) for r in reads.orderBy("record").collect()] == [("a", "ACGT"), ("b", "GG")]
    assert [r.mate for r in text_formats.interleaved_pairs(reads).orderBy("read_id").collect()] == [1, 2]
    assert text_formats.read_format(spark, str(fastq)) == "fastq"
    config = text_formats.parse_config(["# c", "QUERY", "q.fa", "END", "REF", "r.fa", "END", "READS", "PE=a b", "END"])
    assert (config.queries, config.library, config.reads) == (["q.fa"], "PE", ["a", "b"])
    queries = spark.createDataFrame([(1, "t", "ACGTACGTAC", 10), (2, "u", "GG", 2)], "query_id long, title string, seq string, len int")
    regions = spark.createDataFrame([(1, "misjoin", "true", 4, 6)], "query_id long, kind string, verdict string, left long, right long")
    pieces = assembly.correct(queries, regions)
    assert sorted((r.title, r.seq) for r in pieces.collect()) == [("t_1_1_6", "ACGTAC"), ("t_2_4_10", "TACGTAC"), ("u", "GG")]
    sinks.write_fasta(pieces, "title", "seq", str(tmp_path / "out"))
    assert text_formats.read_fasta(spark, str(tmp_path / "out")).count() == 3


def test_metrics_plan(spark):
    queries = spark.createDataFrame([(1, "A" * 1000, 1000), (2, "C" * 500, 500)], "query_id long, seq string, len int")
    refs = spark.createDataFrame([("ACGT" * 500, 2000)], "seq string, len long")
    items = spark.createDataFrame([(1, 1, 1000, 1, 1, 1000, 1, 1000, 0, 1000, 1000)], "query_id long, subject_id long, query_len int, hsp int, q_start long, q_end long, s_start long, s_end long, strand int, match_len long, total_len long")
    m = assembly.metrics(queries, refs, items)
    assert {r.name: r.n for r in m.kinds.collect()} == {"perfect": 1, "matched": 0, "disjunct": 0, "unmatched": 1}
    assert m.gc.first()[0] == 0.5


def test_fastq_over_many_splits(spark, tmp_path):
    path = tmp_path / "many.fq"
    path.write_text("".join(f"@r{i}\n{'ACGT' * (1 + i % 7)}\n+\n{'IIII' * (1 + i % 7)}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [(r.record, r.name, r.seq) for r in text_formats.read_fastq(spark, str(path)).orderBy("record").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, f"r{i}", "ACGT" * (1 + i % 7)) for i in range(500)]


def test_report_and_its_plan(spark, tmp_path):
    """A pairwise report, from text to the kinds of its queries."""
    report = """ALIGNER 1.0

Query= q one
 wrapped title

Length=12

Subject= r1 x

Length=40


 Score = 22 bits (12),  Expect = 1e-5
 Identities = 12/12 (100%), Gaps = 0/12 (0%)
 Strand=Plus/Plus

Query  1   ACGTAC  6
           ||||||
Sbjct  11  ACGTAC  16

Query  7   GTACGT  12
           ||||||
Sbjct  17  GTACGT  22

 Score = 10 bits (5),  Expect = 0.2
 Identities = 5/6 (83%), Gaps = 1/6 (17%)
 Strand=Plus/Minus

Query  2   CGTAC-  6
           |||||
Sbjct  30  CGTACG  25

Subject= r2

Length=9

***** No hits found *****

Lambda      K        H
    1.33    0.621     1.12

Query= q2

Length=7

Subject= r1 x

Length=40

***** No hits found *****
"""
    (tmp_path / "report.txt").write_text(report)
    got = [tuple(r) for r in text_formats.read_report(spark, str(tmp_path / "report.txt")).orderBy("query", "subject", "hsp").collect()]
    none = (None,) * 10
    assert got[0] == ("q one wrapped title", 12, "r1 x", 40, 1, 1, 12, 11, 22, 0, 12, 12, 0, 1.0, "ACGTACGTACGT", "ACGTACGTACGT")
    assert got[1] == ("q one wrapped title", 12, "r1 x", 40, 2, 2, 6, 30, 25, 1, 5, 6, 1, 0.8333, "CGTAC-", "CGTACG")
    assert [r[:5] for r in got[2:]] == [("q one wrapped title", 12, "r2", 9, None), ("q2", 7, "r1 x", 40, None)] and all(r[5:15] == none for r in (got[2], got[3]))


def test_span_coverage_equals_bases(spark, monkeypatch):
    monkeypatch.setattr(pileup, "STEP_BIN", 16)  # spans over many bins
    rng = random.Random(1)
    rows = [(rng.randint(1, 3), lo := rng.randint(1, 200), lo + rng.randint(-1, 60), rng.choice(["A", "c", "G", "T", "N", ".", None])) for _ in range(150)]
    df = spark.createDataFrame(rows, "k int, lo long, hi long, b string")
    got = sorted(tuple(r) for r in pileup.span_coverage(df, "k", "lo", "hi", "b").collect())
    bases = df.where("lo <= hi").select("k", F.explode(F.sequence("lo", "hi")).alias("pos"), "b")
    assert got == sorted(tuple(r) for r in pileup.allele_coverage(bases, "k", "pos", "b").collect())
    at = {(k, p) for k, lo, hi, _ in rows for p in range(lo, hi + 1)}
    assert len(got) == len(at)
    assert {(r.k, r.pos) for r in pileup.depth(df.where("lo <= hi"), "k", "lo", "hi").where("total = 0").collect()} == {(k, p + 1) for k, p in at if (k, p + 1) not in at}


def test_seed_and_extend(spark):
    rng = random.Random(21)
    target = "".join(rng.choices("ACGT", k=400))
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    spoil = lambda s, *at: "".join(other[c] if i in at else c for i, c in enumerate(s))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = {
        1: target[40:140], 2: spoil(target[40:140], 3, 50, 51, 70, 99), 3: spoil(target[40:140], 3, 20, 50, 51, 70, 99), 4: back(target[100:180]), 5: "ACGTACGTACGTACG" + target[:85], 6: "ACGTACGTACGTACGTA" + target[:83], 7: target[10:30],
    }
    got = kmers.extended(spark.createDataFrame(list(reads.items()), "read long, seq string"), spark.createDataFrame([(9, target)], "id long, seq string"), "read", "id")
    want = {(1, 9, 0, 40, 41, 100, 0), (2, 9, 0, 40, 41, 99, 4), (4, 9, 1, 100, 101, 80, 0), (5, 9, 0, -15, 1, 85, 0)}
    assert {tuple(r) for r in got.collect()} == want  # six mismatches of 100 and an overhang of 17 are too many, 20 bases have no k-mer


def test_islands_and_sessions_over_bins(spark, monkeypatch):
    monkeypatch.setattr(intervals, "BIN", 8)
    rng = random.Random(17)
    rows = [(rng.randint(1, 4), lo := rng.randint(1, 600), lo + rng.randint(0, 40), i) for i in range(160)]
    want = {}
    for k in range(1, 5):
        number, reach = 0, None
        for _, lo, hi, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if reach is None or lo > reach:
                number += 1
            reach = max(hi, reach or hi)
            want[i] = number
    df = spark.createDataFrame(rows, "k int, lo long, hi long, i int")
    assert {r.i: r.island for r in intervals.islands(df, "k").collect()} == want
    want = {}
    for k in range(1, 5):
        number, last = 0, None
        for _, lo, _, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[3])):
            number += last is None or lo - last > 3
            last, want[i] = lo, number
    assert {r.i: r.session for r in intervals.sessions(df, "k", "lo", "i", 3).collect()} == want


def test_frequent_kmers_of_whole_reads_are_not_paired(spark):
    """texts that share their first 200 bases met in all pairs."""
    rng = random.Random(9)
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    head, inner = base(200), base(130)
    texts = {i: head + base(90) for i in range(60)} | {70: base(33) + inner + base(40), 71: inner, 72: inner[5:45], 73: head[3:40], 74: base(24), 75: None, 76: inner, 77: "ACGT" * 15, 78: "ACGT" * 9}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, seq string")
    want = {(a, b, d) for a, r in texts.items() for b, t in texts.items() if r and t and len(r) >= 25 for d in range(len(t) - len(r) + 1) if t[d : d + len(r)] == r}
    assert {(r.read, r.doc_id, r.diag) for r in kmers.exact_places(docs, docs, "doc_id", "seq").collect()} == want
    tiles = kmers.tiles(docs, "doc_id", "seq").cache()
    long = docs.where("doc_id < 60").selectExpr("doc_id AS read", "seq AS _r")
    assert kmers._begun(long, tiles, "doc_id", 25).count() == 60  # 3,600 by the first k-mers
    reads = tiles.selectExpr("doc_id AS read_id", "pos AS offset", "kmer")
    rows = lambda df: {(r.read_id, r.doc_id, r.diag, r.n) for r in df.collect()}
    assert rows(kmers.exact_tiles(reads, tiles, "read_id", "doc_id")) == rows(kmers.exact_hits(kmers.probe(reads, tiles), reads, "read_id", "doc_id"))


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Depth and clusters of many intervals are dealt to as many partitions as their rows take, with the same results; no window holds a whole key."""
    monkeypatch.setattr(intervals, "PART_ROWS", 100)
    df = spark.range(2_000).selectExpr("id % 7 as k", "id as row", "id * 7919 % 90000 as lo", "id * 7919 % 90000 + id % 40 as hi")
    clusters, depth = intervals.cluster_ends(df, "k", "row"), pileup.depth_stretches(df, "k", "lo", "hi")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (clusters, depth)]
    assert ", 20), REPARTITION_BY_NUM" in plans[0] and ", 40), REPARTITION_BY_NUM" in plans[1]
    held = [[(r.lo, r.hi) for r in df.where(f"k = {k}").collect()] for k in range(7)]
    want = {(k, p): sum(lo <= p <= hi for lo, hi in held[k]) for k in range(7) for p in {x for lo, hi in held[k] for x in (lo, hi + 1)}}
    got = {(r.k, r.pos): r for r in depth.collect()}
    assert all(want[at] == r.total for at, r in got.items())
    assert sum(r.next - r.pos for r in got.values() if r.total) == len({(k, p) for k in range(7) for lo, hi in held[k] for p in range(lo, hi + 1)})
    whole = sorted(clusters.collect())
    monkeypatch.setattr(intervals, "PART_ROWS", 10_000)
    assert whole == sorted(intervals.cluster_ends(df, "k", "row").collect()) and sum(r.n for r in whole) == 2_000


def test_tiles_are_cut_in_one_pass(spark):
    """Tiles and the k-mer that ends a sequence come from one reading of it, at all lengths around the blocks."""
    rng = random.Random(2)
    seqs = ["".join(rng.choices("ACGT", k=n)) for n in (0, 1, 24, 25, 26, 49, 50, 51, 274, 275, 276, 299, 300, 301, 549, 550, 551, 575, 600, 1_000)]
    df = spark.createDataFrame([*enumerate(seqs), (99, None)], "doc_id long, seq string")
    for step in (None, 1, 7):
        found = kmers.tiles(df, "doc_id", "seq", 25, step)
        assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
        want = {(i, p + 1, s[p : p + 25]) for i, s in enumerate(seqs) if len(s) >= 25 for p in [*range(0, len(s) - 24, step or 25), *([len(s) - 25] if step is None else [])]}
        rows = [tuple(r) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)

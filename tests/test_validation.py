"""From reads and segments to judged regions, on a small assembly whose errors are planted."""

import random

import pytest
from planted import QUERIES, SEGMENTS, R, turned
from pyspark.sql import functions as F

from kontig.operators import alignment, evidence, kmers, mapping, pileup
from kontig.plans import assembly, tracks
from kontig.plans.stages import Stages

@pytest.fixture(scope="module")
def small(spark):
    """The validated assembly: 2 x 100 bases, insert 400, a pair every 10 bases of the reference."""
    pairs = [(R[p : p + 100], turned(R[p + 300 : p + 400])) for p in range(0, len(R) - 400, 10)]
    reads = spark.createDataFrame([(2 * i + k + 1, s) for i, pair in enumerate(pairs) for k, s in enumerate(pair)], "read_id long, seq string")
    queries = spark.createDataFrame([(k, f"q{k}", s, len(s)) for k, s in QUERIES.items()], "key long, title string, seq string, len long")
    segments = spark.createDataFrame(SEGMENTS, "key long, subject long, strand int, q_start long, q_end long, s_start long, s_end long, gap_num long")
    subjects = spark.createDataFrame([(1, R)], "subject long, seq string")
    stages = Stages(spark)
    placed = assembly.place_reads(reads, queries, stages)
    inner = alignment.inner_indels(segments, queries, subjects)
    return placed, assembly.validate(queries, segments, placed.coverage, placed.placements, placed.insert, placed.sd, stages, inner, subjects)


def test_reads_are_placed(small):
    placed, _ = small
    assert placed.insert == pytest.approx(400, abs=1) and placed.sd < 3  # pairs over the inserted bases are longer
    counts = {r.key: r["count"] for r in placed.placements.groupBy("key").count().collect()}
    assert set(counts) == {1, 2, 3, 4}
    first = placed.placements.where("read_id = 1").first()
    assert (first.key, first.pos, first.orient, first.size, first.multi) == (1, 1, 0, 100, False)
    deep = {r.pos: r for r in placed.coverage.where("key = 1").collect()}
    assert deep[1000].total == 20 and max(deep[1000].a, deep[1000].c, deep[1000].g, deep[1000].t) == 20


def test_planted_errors_are_judged(small):
    _, found = small
    regions = {(r.key, r.shape, r.kind): r for r in found.regions.collect()}
    assert set(regions) == {(2, "middle", "misjoin"), (3, "inner", "insertion"), (5, "whole", "insertion")}
    join, insertion, lost = regions[2, "middle", "misjoin"], regions[3, "inner", "insertion"], regions[5, "whole", "insertion"]
    assert (join.left, join.right, join.verdict, join.zero) == (4000, 4001, "true", 0)
    assert join.other > 0.1  # mates of the reads beside the junction lie elsewhere
    assert (insertion.right - insertion.left, insertion.dq, insertion.ds, insertion.verdict) == (21, 20, 0, "true") and abs(insertion.left - 1500) < 12
    assert insertion.zero > 0
    assert lost.verdict == "true"
    assert {r.key: r.verdict for r in found.queries.collect()} == {2: "true", 3: "true", 5: "true"}
    results = {(r.key, r.result, r.mis_kind, r.q_start, r.q_end) for r in found.results.collect()}
    assert (2, "errors", "err_misjoin", 4000, 4001) in results and (5, "errors", "err_insertion", 1, 3000) in results


def test_correction_cuts_the_misjoin(small):
    _, found = small
    pieces = {(r.query_id, r.piece): r.seq for r in found.corrected.collect()}
    assert pieces[2, 1] == QUERIES[2][:4001] and pieces[2, 2] == QUERIES[2][3999:]
    assert all(pieces[k, 0] == QUERIES[k] for k in (1, 3, 4, 5))


def test_candidates(spark):
    kinds = spark.createDataFrame([(1, 50, 0), (2, 70, 1), (3, 70, 2), (4, 10, 3)], "query_id long, len long, kind int")
    assert sorted((r.query_id, r.rank) for r in assembly.candidates(kinds).collect()) == [(2, 1), (3, 2), (4, 0)]


# the prefix-sum index


def test_piece_sums_equal_loops(spark):
    rng = random.Random(1)
    lengths = {1: 1, 2: 199, 3: 200, 4: 201, 5: 1003}
    cover = {(k, p): (rng.randint(0, 6), rng.randint(0, 2)) for k, n in lengths.items() for p in range(1, n + 1) if rng.random() < 0.7}
    cover = {at: x for at, x in cover.items() if sum(x)}
    rows = [(k, p, a, c, 0, 0, 0, a + c) for (k, p), (a, c) in cover.items()]
    coverage = spark.createDataFrame(rows, "key long, pos long, a long, c long, g long, t long, n long, total long")
    size = spark.createDataFrame(list(lengths.items()), "key long, len long")
    index = evidence.prefix_index(evidence.index_cells(coverage, size, "key", "len"), "key")
    pieces = []
    for i in range(300):
        k = rng.choice(list(lengths))
        pieces.append((i, k, *sorted((rng.randint(1, lengths[k]), rng.randint(1, lengths[k])))))
    got = {r.i: r for r in evidence.piece_sums(spark.createDataFrame([*pieces, (-1, 5, 9, 8)], "i long, key long, lo long, hi long"), index, "key", ["i"]).collect()}

    def disagrees(a, c):
        most, least = max(a, c), min(a, c)
        return 10 * most < 9 * (a + c) and not (least == 1 and most >= 4)

    assert set(got) == {p[0] for p in pieces}
    for i, k, lo, hi in pieces:
        here = [cover.get((k, p)) for p in range(lo, hi + 1)]
        assert (got[i].total, got[i].zero) == (sum(sum(x) for x in here if x), sum(x is None for x in here))
        assert got[i].dis == sum(x is None or disagrees(*x) for x in here)
        n = lengths[k]
        bins = [[sum(cover.get((k, p), (0, 0))) for p in range(b, min(b + 50, n + 1))] for b in range(1, n + 1, 50)]
        assert got[i]["mean"] == pytest.approx(sum(sum(b) / len(b) for b in bins) / len(bins))


def test_coverage_of_just_one_and_a_half_means_is_not_high(spark):
    """in sums of fractions the mean of these bins is too low by its last digit."""
    totals = [504 if i == 20 else 324 if not i % 2 else 339 for i in range(40)]
    assert 2 * 504 * 40 == 3 * sum(totals)
    for length, more in ((2000, []), (2010, [(1, 2001 + i, 0, 0, 0, 0, 0, 8) for i in range(10)])):  # a last bin of 10 positions with as many again
        deep = [(1, 50 * b + o + 1, 0, 0, 0, 0, 0, n // 50 + (o < n % 50)) for b, n in enumerate(totals) for o in range(50)]
        coverage = spark.createDataFrame([*deep, *more], "key long, pos long, a long, c long, g long, t long, n long, total long")
        index = evidence.prefix_index(evidence.index_cells(coverage, spark.createDataFrame([(1, length)], "key long, len long"), "key", "len"), "key")
        main = spark.createDataFrame([(7, 1, length, 951, 1100, 0), (8, 1, length, 951, 1100, 0)], "rid long, key long, len long, lo long, hi long, skip int")
        sums = evidence.piece_sums(evidence.bins_of(main).select("rid", "key", "n", "lo", "hi"), index, "key", ["rid", "n"])
        bins = sums.join(main.select("rid", "len", "skip", F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi")), "rid")
        mean = (sum(totals) / 50 + sum(m[-1] for m in more) / 10) / (40 + bool(more))
        assert bins.first()["mean"] == pytest.approx(mean)
        assert {(r.rid, r.high, r.low) for r in evidence.window_coverage(bins).collect()} == {(7, 0, 0), (8, 0, 0)}


@pytest.mark.parametrize("single_cell", [False, True])
def test_evidence_by_parts_of_queries(spark, monkeypatch, single_cell):
    """a region meets a query's parts as one row each, and wherever these are cut its evidence is the same, that of the index and its pieces."""
    rng = random.Random(11)
    regions = []
    for rid in range(240):
        left = rng.randint(1, 3900)
        regions.append((rid, rid % 3, 4000, rng.choice(["head", "tail", "middle", "inner", "whole"]), rng.choice(["misjoin", "insertion", "deletion", "gap"]), left, min(4000, left + rng.randint(-30, 900)), 60, 10))
    regions = spark.createDataFrame(regions, "rid long, key long, len long, shape string, kind string, left long, right long, dq long, ds long")
    reads = [(2 * i + m + 1, rng.randrange(3) if rng.random() < 0.05 else i % 3, max(1, min(3930, at + m * rng.randint(60, 160))), m, 70, rng.random() < 0.1, rng.choice("AAAAC")) for i in range(500) for at in (rng.randint(1, 3900),) for m in (0, 1)]
    placed = spark.createDataFrame(reads, "read_id long, key long, pos long, orient int, size long, multi boolean, base string")
    spans = placed.withColumn("end", F.least(F.col("pos") + F.col("size") - 1, F.lit(4000)))
    coverage, stretches = pileup.span_coverage(spans, "key", "pos", "end", "base").cache(), pileup.span_steps(spans, "key", "pos", "end", "base")
    lengths, stages = regions.select("key", "len").distinct(), Stages(spark)

    def gathered(cover):
        return {r.rid: r.asDict() for r in assembly.gather_evidence(regions, lengths, cover, placed, 100.0, 10.0, stages, single_cell).collect()}

    want = gathered(coverage)
    assert gathered(stretches) == want
    assert evidence.region_parts(regions, 100.0).count() == 240
    for size in (97, 1000):
        monkeypatch.setattr(evidence, "PART", size)
        assert gathered(stretches) == want
    index = evidence.prefix_index(evidence.index_cells(coverage, lengths, "key", "len"), "key")
    main = evidence.main_windows(regions, 100.0)
    sums = evidence.piece_sums(evidence.bins_of(main).select("rid", "key", "n", "lo", "hi"), index, "key", ["rid", "n"])
    bins = sums.join(main.select("rid", "len", "skip", F.col("lo").alias("w_lo"), F.col("hi").alias("w_hi")), "rid")
    rows = evidence.window_coverage(bins, single_cell).collect()
    assert len(rows) > 150 and any(r.high for r in rows) and any(r.low for r in rows)
    for r in rows:
        assert r.asDict() == {x: want[r.rid][x] for x in ("rid", "dis", "zero", "size", "high", "low")}


def test_no_coverage_and_no_reads(spark):
    """A query without a read: all of it is uncovered, whatever its shape."""
    regions = spark.createDataFrame([(1, 7, 900, "middle", "gap", 400, 450, 60, 10, False), (2, 7, 900, "head", "insertion", 4, 5, None, None, False), (3, 7, 900, "whole", "insertion", 1, 900, None, None, True)], "rid long, key long, len long, shape string, kind string, left long, right long, dq long, ds long, in_gap boolean")
    coverage = spark.createDataFrame([], "key long, pos long, a long, c long, g long, t long, n long, total long")
    placed = spark.createDataFrame([], "read_id long, key long, pos long, orient int, size long, multi boolean")
    stages = Stages(spark)
    got = assembly.judge(assembly.gather_evidence(regions, regions.select("key", "len").distinct(), coverage, placed, 100.0, 10.0, stages), 100.0, 10.0)
    rows = {r.rid: r for r in got.collect()}
    assert {r.verdict for r in rows.values()} == {"true"}
    assert (rows[1].zero, rows[1].dis, rows[1].size, rows[1].pairs_left) == (251, 251, 251, 0)
    assert assembly.gather_evidence(regions.limit(0), regions.select("key", "len"), coverage, placed, 100.0, 10.0, stages).count() == 0


# alignment


def test_shifts():
    assert alignment.align("ACGT", "CGT") == ("CGT", "CGT", 3, 0, 1, 0, 0, 0)
    assert alignment.align("", "AC") == ("", "", 0, 0, 0, 0, 0, 2)
    rng = random.Random(7)
    for _ in range(200):
        a, b = ("".join(rng.choices("ACG", k=rng.randint(1, 15))) for _ in range(2))
        x = alignment.align(a, b)
        assert a == a[: x.left1] + x.row1.replace("-", "") + a[len(a) - x.right1 :] and b == b[: x.left2] + x.row2.replace("-", "") + b[len(b) - x.right2 :]


def column_score(row1, row2):
    return sum(-4 if "-" in (p, q) else 1 if p == q else -2 for p, q in zip(row1, row2, strict=True))


def gap_span(row1, row2):
    at = [i for i, (p, q) in enumerate(zip(row1, row2, strict=True)) if "-" in (p, q)]
    return at[-1] - at[0] if at else -1


def test_settled_gaps():
    assert alignment.settle_gaps("AC-A-GT", "ACAAAGT") == ("ACA--GT", "ACAAAGT")
    assert alignment.settle_gaps("AC-AGT", "ACAAGT") == ("AC-AGT", "ACAAGT")  # one run stays
    assert alignment.settle_gaps("ACGT", "ACTT") == ("ACGT", "ACTT")
    rng = random.Random(11)
    moved = 0
    for _ in range(2000):
        a = "".join(rng.choices("AC", k=rng.randint(2, 14)))
        rows = [(c, c) if (x := rng.random()) < 0.7 else ("-", rng.choice("AC")) if x < 0.85 else (rng.choice("AC"), "-") for c in a]
        row1, row2 = "".join(r[0] for r in rows), "".join(r[1] for r in rows)
        done = alignment.settle_gaps(row1, row2)
        moved += done != (row1, row2)
        assert [r.replace("-", "") for r in done] == [row1.replace("-", ""), row2.replace("-", "")]
        assert column_score(*done) == column_score(row1, row2) and alignment.settle_gaps(*done) == done
        assert alignment.count_gaps(*done) == alignment.count_gaps(row1, row2)
        if alignment.count_gaps(row1, row2)[2] == row1.count("-") + row2.count("-"):
            assert gap_span(*done) <= gap_span(row1, row2)
    assert moved > 200


def test_anchors_equal_a_scan():
    rng = random.Random(13)
    for n in (30, 150, 230, 420, 900):
        noise = "".join(rng.choices("ACGT", k=n))
        tail = "".join(rng.choices("ACGT", k=1500))
        q, s = noise + tail, "".join(rng.choices("ACGT", k=n)) + tail
        found = alignment.find_anchor(q, s, 0, 0)
        for size in range(200, len(q) + 1, 200):
            x = alignment.align(q[:size], s[:size])
            if alignment.anchored(x.row1, x.row2)[1]:
                assert found == (size - x.right1, size - x.right2)
                break
    assert alignment.find_anchor("A" * 10, "C" * 10, 0, 0) is None
    assert alignment.find_anchor(R[:300], R[:300], 0, 0) == (200, 200)
    assert alignment.anchored("A" * 50 + "C" + "A" * 49, "A" * 50 + "G" + "A" * 49) == (True, False)


def test_inner_indels_on_both_strands(spark):
    rng = random.Random(17)
    segments, queries, truth = [], [], {}
    for key in range(12):
        lo = rng.randint(0, 4000)
        stretch = R[lo : lo + 9000]
        out, want, at = "", [], 0
        for place in range(800, 8400, 900):
            n = rng.randint(5, 45)
            insert = rng.random() < 0.5
            out += stretch[at:place] + ("".join(rng.choices("ACGT", k=n)) if insert else "")
            at = place + (0 if insert else n)
            want.append((place, n if insert else -n))
        out += stretch[at:]
        minus = key % 2 == 1
        queries.append((key, turned(out) if minus else out))
        segments.append((key, 1, int(minus), 1, len(out), lo + 9000 if minus else lo + 1, lo + 1 if minus else lo + 9000, 9))
        truth[key] = [(lo + p, d) for p, d in want]
    names = "key long, subject long, strand int, q_start long, q_end long, s_start long, s_end long, gap_num long"
    found = alignment.inner_indels(spark.createDataFrame([*segments, (0, 1, 0, 1, 500, 1, 500, 4)], names), spark.createDataFrame(queries, "key long, seq string"), spark.createDataFrame([(1, R)], "subject long, seq string"))
    got = {}
    for r in found.collect():
        assert r.kind == ("insertion" if r.dq > r.ds else "deletion") and r.shape == "inner"
        got.setdefault(r.key, []).append((r.s_left, r.dq - r.ds))
    for key, want in truth.items():
        mine = sorted(got[key])
        assert [d for _, d in mine] == [d for _, d in want]
        assert all(abs(a - b) <= 12 for (a, _), (b, _) in zip(mine, want, strict=True))


# mapping


def test_extended_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(kmers, "TARGET_BLOCK", 128)
    rng = random.Random(19)
    reads = []
    for i in range(80):
        p = rng.choice([0, 1, 28, 100, 127, 128, 129, 700, 19_890]) + rng.randint(0, 9)
        s = list(R[p : p + 100])
        for at in rng.sample(range(len(s)), rng.randint(0, 2)):
            s[at] = "ACGT"[("ACGT".index(s[at]) + 1) % 4]
        reads.append((i, p, "".join(s) if i % 2 else turned("".join(s))))
    df = spark.createDataFrame(reads, "read_id long, p long, seq string")
    target = spark.createDataFrame([(1, R), (2, R[500:560])], "key long, seq string")
    got = {}
    for r in kmers.extended(df, target, "read_id", "key").collect():
        got.setdefault(r.read_id, []).append(r)
    for i, p, s in reads:
        same = s if i % 2 else turned(s)
        mine = [r for r in got[i] if r.key == 1]
        assert len(mine) == 1 and mine[0].strand == 1 - i % 2 and mine[0].diag == p
        marks = [x != y for x, y in zip(same, R[p : p + 100])]
        head = next(k for k, bad in enumerate(marks) if not bad)
        tail = next(k for k, bad in enumerate(marks[::-1]) if not bad)
        assert (mine[0].start, mine[0].size, mine[0].mismatches) == (p + 1 + head, len(marks) - head - tail, sum(marks) - head - tail)


HITS = "read_id long, key long, strand long, start long, size long, skip long, mismatches long, len long"


def placements(spark, hits, mean=400.0, sd=10.0, sizes=((1, 5000), (2, 5000))):
    df = spark.createDataFrame([(r, k, s, at, 100, 0, m, 100) for r, k, s, at, m in hits], HITS)
    queries = spark.createDataFrame(list(sizes), "key long, len long")
    mated = mapping.mated_hits(df, mean, sd)
    out = assembly.choose_twice(df, mated, queries, Stages(spark)).collect()
    assert len({r.read_id for r in out}) == len(out)
    return {r.read_id: (r.key, r.start, r.multi) for r in out}


def test_choice_of_placements(spark):
    hits = [
        (1, 1, 0, 100, 0), (2, 1, 1, 400, 0), (2, 2, 1, 400, 0),  # one mated pair of two
        (3, 1, 0, 1000, 1), (4, 1, 1, 1300, 0), (3, 2, 0, 1000, 0), (4, 2, 1, 1300, 0),  # two mated pairs, one with fewer mismatches
        (5, 1, 0, 2000, 2), (5, 2, 0, 2500, 1),  # no mate: the fewest mismatches
        (7, 1, 0, 3000, 0), (8, 2, 1, 3000, 0),  # unmated, one hit each
        (9, 1, 0, 100, 0), (9, 2, 0, 4000, 0), (10, 1, 1, 400, 0), (10, 2, 1, 4300, 0),  # equals: the second pass prefers what is uncovered
    ]
    got = placements(spark, hits)
    assert got[1] == (1, 100, False) and got[2] == (1, 400, False)
    assert got[3] == (2, 1000, True) and got[4] == (2, 1300, True)
    assert got[5] == (2, 2500, True) and 6 not in got
    assert got[7] == (1, 3000, False) and got[8] == (2, 3000, False)
    assert got[9] == (2, 4000, True) and got[10] == (2, 4300, True)


def test_facing_fragments(spark):
    rows = [(1, 1, 0, 100, 0), (2, 1, 1, 400, 0), (3, 1, 1, 400, 0), (4, 1, 0, 90, 0), (5, 1, 0, 400, 0), (6, 1, 1, 100, 0), (7, 1, 0, 1, 0), (8, 1, 1, 300, 1), (9, 1, 0, 1, 0), (10, 2, 1, 1, 0), (11, 1, 0, 5, 0), (11, 1, 0, 50, 0), (12, 1, 1, 300, 0)]
    df = spark.createDataFrame([(r, k, s, at, 100, 0, m, 100) for r, k, s, at, m in rows], HITS)
    assert sorted(tuple(r) for r in mapping.facing_fragments(df).collect()) == [(1, 400), (2, 410)]


def test_rescued_mates(spark):
    """A mate with three mismatches that hangs over nothing but has no seed is found at the query's end, one outside the window is not."""
    query = R[:2000]
    near = list(query[1890:1990])
    for at in (20, 45, 70):
        near[at] = "ACGT"[("ACGT".index(near[at]) + 1) % 4]
    worse = near[:]
    worse[90] = "ACGT"[("ACGT".index(worse[90]) + 2) % 4]
    over = query[1930:] + R[5000:5030]
    reads = [(1, query[1650:1750]), (2, turned("".join(near))), (3, query[1650:1750]), (4, turned("".join(worse))), (5, query[1650:1750]), (6, turned(R[9000:9100])), (7, query[1650:1750]), (8, turned(over)), (9, query[900:1000]), (10, turned(query[1200:1300])), (12, turned(query[250:350])), (11, query[10:110])]
    hits = [(1, 1, 0, 1651, 100, 0, 0, 100), (3, 1, 0, 1651, 100, 0, 0, 100), (5, 1, 0, 1651, 100, 0, 0, 100), (7, 1, 0, 1651, 100, 0, 0, 100), (9, 1, 0, 901, 100, 0, 0, 100), (12, 1, 1, 251, 100, 0, 0, 100)]
    df = spark.createDataFrame(hits, HITS)
    queries = spark.createDataFrame([(1, query)], "key long, seq string")
    found = mapping.rescued_mates(df, mapping.mated_hits(df, 340.0, 10.0), spark.createDataFrame(reads, "read_id long, seq string"), queries, 340.0, 10.0)
    got = {r.pair: (tuple(r.h1), tuple(r.h2)) for r in found.collect()}
    assert set(got) == {1, 4, 6}  # a fourth mismatch, another sequence and a window inside the query don't do
    assert got[1][1] == (1, 1891, 100, 0, 3, 100)
    assert got[4][1] == (1, 1931, 70, 0, 0, 100)  # 30 bases hang over the end
    assert got[6][0] == (0, 11, 100, 0, 0, 100)
    same = spark.createDataFrame([(1, 1, 0, 1651, 100, 0, 0, 100), (2, 1, 1, 1891, 100, 0, 3, 100)], HITS)
    assert mapping.rescued_mates(same, mapping.mated_hits(same, 340.0, 10.0), spark.createDataFrame(reads, "read_id long, seq string"), queries, 340.0, 10.0).count() == 0


def test_blocks(spark):
    df = spark.createDataFrame([(1, "ABCDEFGHIJ"), (2, ""), (3, None), (4, "AB")], "k long, s string")
    assert sorted(tuple(r) for r in kmers.blocks(df, "k", "s", 4, 3).collect()) == [(1, 10, 0, "ABCDEFG"), (1, 10, 1, "EFGHIJ"), (1, 10, 2, "IJ"), (4, 2, 0, "AB")]


def test_span_and_base_coverage_agree(spark):
    """Coverage by spans equals coverage by placed bases where a read has one base throughout."""
    spans = spark.createDataFrame([(1, 3, 9, "A"), (1, 5, 12, "C")], "key long, lo long, hi long, base string")
    bases = spans.select("key", F.explode(F.sequence("lo", "hi")).alias("pos"), "base")
    one, two = pileup.span_coverage(spans, "key", "lo", "hi", "base"), pileup.allele_coverage(bases, "key", "pos", "base")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(*one.columns).collect()))


# margins


def spoilt(rng, seq, share):
    return "".join(rng.choice("ACGT") if rng.random() < share else x for x in seq)


def test_density_margin():
    rng = random.Random(23)
    for clean in (120, 300, 450, 777):
        good = "".join(rng.choices("ACGT", k=clean))
        tail = "".join(rng.choices("ACGT", k=600))
        assert abs(alignment.end_margin(good + tail, good + spoilt(rng, tail, 0.32)) - clean) <= 25
    same = "".join(rng.choices("ACGT", k=900))
    assert alignment.end_margin(same, same) is None
    assert alignment.end_margin(same, spoilt(rng, same, 0.03)) is None  # sparse mismatches are no margin
    lone = same[:300] + spoilt(rng, same[300:400], 0.5) + same[400:]
    assert alignment.density_margin(same, lone) is None  # one dense window alone is none
    assert alignment.density_margin("A" * 400, "C" * 400) is None  # unlike from the begin on
    assert alignment.density_margin("A" * 250, "A" * 200 + "C" * 50) == 199  # the shorter last window
    long = "".join(rng.choices("ACGT", k=5_000))
    row1, row2 = alignment.align_chunks(long, long[:2_500] + long[2_510:])
    assert row1.replace("-", "") == long[: len(row1.replace("-", ""))] and row2.count("-") >= 10 and len(row1) >= 4_980


def test_refined_margins(spark):
    """Two segments that an aligner drew 200 bases too far into each other, on every pair of strands, some over the subject's end."""
    rng = random.Random(29)
    points, queries, subjects = [], [], []
    base = lambda n: "".join(rng.choices("ACGT", k=n))
    for key, (s1, s2) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1), (0, 0), (1, 1)]):
        one, two = base(800), base(800)
        # beyond their seam the subject goes on with something like the other segment
        piece1, piece2 = one + spoilt(rng, two[:200], 0.32), spoilt(rng, one[-200:], 0.32) + two
        subject = base(500) + (turned(piece1) if s1 else piece1) + base(300) + (turned(piece2) if s2 else piece2) + base(500)
        at = (501 if s1 else 1500, 2800 if s2 else 1801)
        turn = 0 if key < 4 else 1400 - 800 * s1  # the ring is opened within the first piece
        queries.append((key, one + two))
        subjects.append((key, subject[turn:] + subject[:turn]))
        end1, begin2 = ((p - 1 - turn) % len(subject) + 1 for p in at)
        points.append((key, 1000, end1, s1, key, 601, begin2, s2, key, "misjoin"))
    points.append((0, 700, 50, 0, 0, 690, 2_000, 0, 0, "misjoin"))  # overlaps by less than 100: the ends stay
    df = spark.createDataFrame(points, "key long, p_q_end long, p_s_end long, p_strand int, p_subject long, q_start long, s_start long, strand int, subject long, kind string")
    found = alignment.refine_margins(df, spark.createDataFrame(queries, "key long, seq string"), spark.createDataFrame(subjects, "subject long, seq string"))
    rows = [(r.key, r.left, r.right) for r in found.collect()]
    assert (0, 690, 700) in rows and len(rows) == 7
    assert all(785 <= left <= right <= 815 for _, left, right in rows if left != 690)


def test_tracks(spark):
    lengths = spark.createDataFrame([(1, 10), (2, 4)], "key long, len long")
    spans = spark.createDataFrame([(1, -3, 2), (1, 5, 6), (1, 6, 20)], "key long, lo long, hi long")
    assert sorted((r.key, r.lo, r.hi) for r in tracks.uncovered_track(spans, lengths).collect()) == [(1, 3, 4), (2, 1, 4)]
    unknown = tracks.unknown_track(spark.createDataFrame([(1, "NNACn.GT"), (2, "ACGT"), (3, None)], "key long, seq string"))
    assert sorted((r.key, r.lo, r.hi, r.value) for r in unknown.collect()) == [(1, 1, 2, 2.0), (1, 5, 6, 2.0)]
    results = spark.createDataFrame([(1, "sv", 3, 9), (1, "errors", 1, 2)], "key long, result string, q_start long, q_end long")
    assert sorted((r.lo, r.hi, r.value) for r in tracks.result_track(results).collect()) == [(1, 2, 1.0), (3, 9, 2.0)]


def test_uncovered_positions_of_hits(spark):
    """Positions under hits that no placed read covers, against sets of positions; nothing is a row for a position."""
    rng = random.Random(4)
    spans = lambda n: [(rng.randint(0, 2), rng.randint(1, 900), rng.choice([1, 2, 61, 62, 63, 100, 400])) for _ in range(n)]
    hits, placed = spans(80), spans(12)
    frame = lambda rows: spark.createDataFrame(rows, "key long, start long, size long")
    held = {(k, p) for k, start, size in placed for p in range(start, start + size)}
    want = {(k, start, size): sum((k, p) not in held for p in range(start, start + size)) for k, start, size in hits}
    assert {(r.key, r.start, r.size): r.zero for r in assembly.uncovered(frame(hits + hits[:9]), frame(placed)).collect()} == want
    assert all(r.zero == r.size for r in assembly.uncovered(frame(hits), frame(placed).limit(0)).collect())


def test_choice_goes_by_pair(spark):
    """Hits are shuffled by their pair alone; windows and joins of reads lie within that."""
    hits = spark.createDataFrame([(1, 7, 0, 10, 100, 0, 0, 100), (2, 7, 1, 260, 100, 0, 1, 100), (3, 7, 0, 40, 100, 0, 0, 100)], "read_id long, key long, strand long, start long, size long, skip long, mismatches long, len long")
    chosen = mapping.choose(hits, mapping.mated_hits(hits, 350.0, 50.0))
    assert "hashpartitioning(read_id" not in chosen._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.read_id, r.start, r.multi) for r in chosen.collect()) == [(1, 10, False), (2, 260, False), (3, 40, False)]


def test_tracks_read_the_tables_once(spark):
    """The reads and the steps of their coverage are made once for all tracks: what is drawn comes from written tables alone."""
    from kontig.plans import table_queries

    drawn = table_queries.drawing_tracks(spark, "/root/testdata/sf0.001")
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert not any(name in plan for name in ("l_orderkey", "o_orderkey")) and {r.track for r in drawn.select("track").distinct().collect()} == {"coverage", "uncovered", "disagreement", "discordant", "ambiguous"}

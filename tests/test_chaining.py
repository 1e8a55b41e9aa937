"""Chains of segments against plain loops, and holes of queries that other subjects cover."""

import random
import time

import pytest

from kontig.operators import chaining
from kontig.params import END_VARIATION, MIN_SEGMENT_LEN


def seg(hsp, q1, q2, s1, s2, strand=0, match=None, subject=1):
    n = q2 - q1 + 1
    return dict(hsp=hsp, q_start=q1, q_end=q2, s_start=s1, s_end=s2, strand=strand, match_len=n if match is None else match, total_len=n, subject_id=subject)


def plain_chain(segs):
    """The greedy chain by a scan of all segments for every step."""
    left, chain = segs[1:], [segs[0]]

    def pick(edge, right):
        best = None
        for s in left:
            if s["total_len"] <= MIN_SEGMENT_LEN or (s["q_start"] <= edge["q_start"] if right else s["q_end"] >= edge["q_end"]):
                continue
            a, b = (edge, s) if right else (s, edge)
            dq = abs(b["q_start"] - a["q_end"])
            ds = abs(b["s_start"] - a["s_end"])
            same = s["strand"] == edge["strand"]
            tier = 0 if same and dq <= END_VARIATION and ds <= END_VARIATION else 1 if same else 2
            if best is None or (tier, dq, ds, s["hsp"]) < best[0]:
                best = ((tier, dq, ds, s["hsp"]), s)
        return best[1] if best else None

    for right in (True, False):
        while (found := pick(chain[-1] if right else chain[0], right)) is not None:
            left.remove(found)
            chain.insert(len(chain) if right else 0, found)
    return chain


def random_segments(rng, n, reach):
    out = []
    for hsp in range(1, n + 1):
        q, s, size, strand = rng.randint(1, reach), rng.randint(1, reach), rng.randint(60, 900), rng.randint(0, 1)
        out.append(seg(hsp, q, q + size, *((s, s + size) if strand == 0 else (s + size, s)), strand))
    return out


@pytest.mark.parametrize("reach", [900, 6_000, 40_000])
def test_chain_equals_scan(reach):
    rng = random.Random(reach)
    for _ in range(250):
        segs = random_segments(rng, rng.randint(1, 14), reach)
        want = [s["hsp"] for s in plain_chain(segs)]
        got = [s["hsp"] for s in chaining._chain(segs)]
        assert [h for h in got if h in set(want)] == want


def test_ten_thousand_segments():
    rng = random.Random(3)
    segs = random_segments(rng, 10_000, 5_000_000)
    began = time.perf_counter()
    assert len(chaining._chain(segs)) > 1_000
    assert time.perf_counter() - began < 10


def test_left_over_segments_fill_holes():
    chain = [seg(1, 1, 1000, 1, 1000), seg(2, 1101, 2000, 1101, 2000)]
    small = [seg(3, 1001, 1100, 9001, 9100, match=99), seg(5, 990, 1110, 7001, 7121, match=110), seg(4, 950, 1150, 8001, 8201, match=180)]
    assert [s["hsp"] for s in chaining._fill(chain, sorted((s for s in small if s["match_len"] >= 100), key=lambda s: s["q_start"]))] == [1, 4, 2]
    assert [s["hsp"] for s in chaining._fill(chain, [])] == [1, 2]


def test_perfect_tiling_drops_the_rest():
    tiles = [seg(1, 1, 500, 4501, 5000), seg(2, 501, 900, 1, 400), seg(3, 901, 1400, 401, 900)]
    extra = seg(9, 300, 700, 20, 420)
    assert [s["hsp"] for s in chaining._perfect_tiling([tiles[0], extra, *tiles[1:]], 1400, 5000)] == [1, 2, 3]
    assert [s["hsp"] for s in chaining._perfect_tiling([tiles[0], extra, *tiles[1:]], 1400, None)] == [1, 9, 2, 3]  # only a circular subject goes on at 1
    minus = [seg(1, 1, 500, 500, 1, 1), seg(2, 501, 900, 5000, 4601, 1)]
    assert chaining._perfect_tiling(minus, 900, 5000) == minus
    assert chaining._perfect_tiling([tiles[0], extra], 1400, 5000) == [tiles[0], extra]


def test_circular_subjects():
    over = [seg(1, 1, 500, 99_501, 100_000), seg(2, 501, 1000, 1, 500)]
    assert chaining.match_kind(1000, over) == chaining.DISJUNCT  # on a linear subject
    assert chaining.match_kind(1000, over, 100_000) == chaining.PERFECT
    near = [seg(1, 1, 500, 99_401, 99_900), seg(2, 501, 1000, 101, 600, match=480)]
    assert chaining.match_kind(1000, near, 100_000) == chaining.MATCHED
    back = [seg(1, 1, 500, 700, 201, 1, match=490), seg(2, 501, 1000, 99_900, 99_401, 1)]
    assert chaining.match_kind(1000, back, 100_000) == chaining.MATCHED and chaining.match_kind(1000, back) == chaining.DISJUNCT
    assert chaining._apart(near[0], near[1], 0, 100_000) == 201


NAMES = "query_id long, subject_id long, query_len long, hsp long, q_start long, q_end long, s_start long, s_end long, strand int, match_len long, total_len long"


def frame(spark, rows, query_len=10_000, query=1):
    return spark.createDataFrame([(query, r["subject_id"], query_len, r["hsp"], r["q_start"], r["q_end"], r["s_start"], r["s_end"], r["strand"], r["match_len"], r["total_len"]) for r in rows], NAMES)


def test_chained_frames(spark):
    rows = [seg(1, 3001, 6000, 3001, 6000, match=2950), seg(2, 1, 2990, 1, 2990), seg(3, 6001, 10_000, 6001, 10_000), seg(4, 50, 90, 70_000, 70_040)]
    items = frame(spark, rows).unionByName(frame(spark, [seg(1, 1, 10_000, 1, 10_000, subject=2)]))
    got = sorted((r.subject_id, r.ord, r.hsp) for r in chaining.chained(items).collect())
    assert got == [(1, 1, 2), (1, 2, 1), (1, 3, 3), (2, 1, 1)]
    kinds = {r.subject_id: r.kind for r in chaining.classify_pairs(items).collect()}
    assert kinds == {1: chaining.MATCHED, 2: chaining.PERFECT}
    assert chaining.chained(items.limit(0)).count() == 0


def test_holes_are_filled_once(spark):
    """A head, a gap and a tail, with candidates for each; one fits into two holes and is used in the first."""
    best = frame(spark, [seg(1, 1001, 3000, 1, 2000), seg(2, 6001, 8000, 5001, 7000), seg(3, 8100, 8900, 7100, 7900)])
    best = best.join(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "hsp long, ord long"), "hsp").select(*best.columns, "ord")
    pool = [
        seg(1, 1, 990, 1, 990, subject=2),  # head
        seg(1, 3101, 4500, 1, 1400, subject=3), seg(2, 4501, 5900, 1401, 2800, subject=3),  # gap, in two steps
        seg(3, 4400, 5950, 1, 1551, subject=4),  # longer than either: it begins
        seg(4, 9000, 9900, 1, 901, subject=5), seg(5, 9100, 9800, 1, 701, subject=6),  # tail: the longer one
        seg(6, 6100, 7000, 1, 901, subject=7),  # no hole there
    ]
    items = frame(spark, pool)
    out = chaining.fill_holes(best, items)
    got = [(r.subject_id, r.q_start) for r in out.orderBy("ord").collect()]
    assert got == [(2, 1), (1, 1001), (3, 3101), (4, 4400), (1, 6001), (1, 8100), (5, 9000)]
    assert [r.ord for r in out.orderBy("ord").collect()] == list(range(1, 8))
    assert chaining.fill_holes(best, items.limit(0)).count() == 3 and chaining.fill_holes(best.limit(0), items).count() == 0
    lone = frame(spark, [seg(1, 2000, 2900, 1, 901, subject=9)], query_len=12_000, query=8)
    ordered = lone.selectExpr("*", "cast(1 as long) as ord")
    wide = [seg(1, 2950, 11_900, 1, 8951, subject=3), seg(2, 2, 1950, 1, 1949, subject=3), seg(3, 2940, 3600, 1, 661, subject=4)]
    found = chaining.fill_holes(ordered, frame(spark, wide, 12_000, 8))
    assert [(r.subject_id, r.q_start) for r in found.orderBy("ord").collect()] == [(3, 2), (9, 2000), (3, 2950)]


@pytest.mark.parametrize("subject_len", [None, 9_000])
def test_few_segments_are_chained_by_a_scan(subject_len):
    """The scan for few segments and the index for many make the same chains."""
    rng = random.Random(7)
    for _ in range(300):
        segs = random_segments(rng, rng.randint(1, 30), rng.choice([900, 6_000, 9_000]))
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(chaining, "FEW_SEGMENTS", -1)
            indexed = chaining._chain(segs, subject_len)
        assert chaining._chain(segs, subject_len) == indexed


def test_kinds_come_with_chains(spark, monkeypatch):
    """A pair is chained once for its kind and its chain, which are those of ``classify_pairs`` and ``chained``."""
    rng = random.Random(5)
    items = frame(spark, [s | {"subject_id": k, "match_len": s["total_len"] - rng.randint(0, 30)} for k in range(40) for s in random_segments(rng, rng.randint(1, 6), 9_000)])
    judged = chaining.judged_chains(items)
    plain = lambda df, *names: sorted(tuple(r) for r in df.select(*names).collect())
    assert plain(judged.where("ord = 1"), "subject_id", "kind", "match_sum") == plain(chaining.classify_pairs(items), "subject_id", "kind", "match_sum")
    assert plain(judged, "subject_id", "ord", "hsp") == plain(chaining.chained(items), "subject_id", "ord", "hsp")

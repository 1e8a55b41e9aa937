"""How often and where pairs of sequences are aligned."""

import random

from kontig.operators import alignment


def test_rows_like_the_one_before_are_done_once():
    seen = []

    def each(a, b):
        seen.append((a, b))
        return a + b

    rows = [("a", "b"), ("a", "b"), ("a", "c"), ("a", "b"), ("a", "b")]
    assert list(alignment.once_each(each, rows)) == ["ab", "ab", "ac", "ab", "ab"]
    assert seen == [("a", "b"), ("a", "c"), ("a", "b")]


def test_scans_are_spread_and_equal_pairs_keep_their_rows(spark):
    """A hundred copies of a pair with a planted insertion, under one subject, and pairs without a difference."""
    rng = random.Random(5)
    subject = "".join(rng.choices("ACGT", k=3_000))
    query = subject[:1_500] + "".join(rng.choices("ACGT", k=60)) + subject[1_500:]
    seqs = [(0, subject), *[(i, query) for i in range(1, 101)], *[(i, subject) for i in range(101, 111)]]
    segments = [(i, 0, 0, 1, len(s), 1, len(subject), 9) for i, s in seqs if i]
    texts = spark.createDataFrame(seqs, "key long, seq string")
    segs = spark.createDataFrame(segments, "key long, subject long, strand int, q_start long, q_end long, s_start long, s_end long, gap_num int")
    found = alignment.inner_indels(segs, texts, texts.withColumnRenamed("key", "subject"))
    rows = found.collect()
    assert sorted(r.key for r in rows) == list(range(1, 101))
    assert len({(r.kind, r.left, r.right, r.dq, r.ds) for r in rows}) == 1 and rows[0].dq - rows[0].ds == 60
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism

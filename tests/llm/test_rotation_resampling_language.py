"""Fill-in-middle, importance resampling and language identification against brute force, SQL and held-out labels."""

import math
import os
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from kontig.llm import common, fill_in_middle, importance, language_id, queries

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "é", "abc def", "a<P>b", "x<S>", "<M", "<<P", "中文😀 é", "word " * 3000, "é😀" * 2000, "abc def", "A b C d e f g h i j k l m n o p q r s t u v"]


def frame(spark, texts=TEXTS):
    """Texts with columns whose names clash, a repeated row and a null key."""
    rows = [(i - 3, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "null key here", "y", 2)], "doc_id long, text string, form string, score int")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_importance"])
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


# 11: fill-in-middle


def brute_fim(doc_id, text):
    t, n = text or "", len(text or "")
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_fim_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    rng = random.Random(block)
    texts = [t[:50] if t else t for t in TEXTS] + ["".join(rng.choices(["a", "é", "中", "😀", "<", "<P", ">", "S>", "\n"], k=rng.randint(0, 30))) for _ in range(300)]
    for i, text in enumerate(texts):
        h = sha256(f"1:{i}".encode()).hexdigest()
        form, n, prefix, middle, out = fill_in_middle.apply((text or "").encode(), tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4)), fill_in_middle.Recipe())
        assert (n, form, prefix, middle, out.decode()) == brute_fim(i, text)
        assert fill_in_middle.invert(out, form, fill_in_middle.Recipe()).decode() == (text or "")


def test_fim_frames(spark):
    df = frame(spark)
    out = fill_in_middle.transform(df, restored=True)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and set(out.columns) == {"doc_id", "text", "score", "n_points", "form", "prefix_points", "middle_points", "output", "restored"}
    for r in rows:
        assert (r.n_points, r.form, r.prefix_points, r.middle_points, r.output) == brute_fim(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    back = fill_in_middle.restore(out.select("output", "form", "text", "restored"))
    assert all(r.restored == (r.text or "") for r in back.collect())
    assert fill_in_middle.transform(df.limit(0)).count() == 0
    broken = spark.createDataFrame([("<P>a<S>b", "psm"), ("abc", "spm"), ("<M>a<S>b<P>c", "psm"), (None, "plain"), ("x", None)], "output string, form string")
    assert [r.restored for r in fill_in_middle.restore(broken).collect()] == [None, None, None, "", None]


def test_fim_other_recipes(spark):
    recipe = fill_in_middle.Recipe(seed=4, rotated=100, spm=50, sentinels=("[pre]", "[suf]", "[mid]"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = fill_in_middle.restore(fill_in_middle.transform(docs, recipe), recipe).collect()
    assert {r.form for r in out} >= {"psm", "spm"} and all(r.restored == r.text for r in out)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("a", "xax", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            fill_in_middle.Recipe(sentinels=bad)


# 12: importance resampling


def brute_draw(docs, target, percent=25, least=20):
    def bag(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    bags, goal = [bag(t) for _, t in docs], Counter(b for t in target for b in bag(t)[1])
    pool = Counter(b for _, f in bags for b in f)
    s, t = sum(pool.values()), sum(goal.values())
    rows = []
    for (key, _), (n, f) in zip(docs, bags, strict=True):
        gains = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10_000) / ((pool[b] + 1) * (t + 10_000)))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: k + 1 for k, i in enumerate(order[: len(order) * percent // 100])}
    return sorted(((*r, rank.get(i)) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("digit", "block", "piece"), [(11, 15, 1 << 20), (2, 3, 5), (5, 0, 64)])
def test_resample_equals_brute_force(spark, monkeypatch, digit, block, piece):
    for name, value in (("DIGIT_BITS", digit), ("BLOCK_BITS", block), ("PIECE_BYTES", piece)):
        monkeypatch.setattr(importance, name, value)
    rng = random.Random(1)
    long = [" ".join(rng.choices(["The", "of", "é", "MÜ", "x1", "--", "a.b", "中文", "q"], k=rng.randint(0, 60))) for _ in range(120)]
    df = frame(spark, [*TEXTS, *long])
    df = df.union(df.where("doc_id > 100")).withColumn("rank", df["score"])
    target = ["the of the of x1", None, "", "q q q"]
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=60)
    assert sorted(map(tuple, got.collect()), key=str) == brute_draw([(r.doc_id, r.text) for r in df.collect()], target, 60)


def test_resample_edges(spark):
    df = frame(spark)
    nothing = spark.createDataFrame([], "text string")
    assert importance.resample(df.limit(0), nothing).count() == 0
    assert importance.resample(df.limit(0), df).count() == 0
    assert sorted(map(tuple, importance.resample(df, nothing, 100).collect()), key=str) == brute_draw([(r.doc_id, r.text) for r in df.collect()], [], 100)


@pytest.mark.parametrize("keys", [[-(2**63), 2**63 - 1, 0, -1, 5, 5], [None, None, 3, -7], [None, None], [9]])
def test_radix_order_of_any_keys(spark, monkeypatch, keys):
    monkeypatch.setattr(importance, "BLOCK_BITS", 1)
    scratch = common.Scratch(spark)
    rows = [(k, s) for k in keys for s in (-3, 0, 70_000)]
    written = scratch.write(spark.createDataFrame(rows, "k long, s long"), "rows")
    out = importance.radix_order(written, "k", "s", scratch).collect()
    assert sorted(r._at for r in out) == list(range(len(rows)))
    assert [(r.k, r.s) for r in sorted(out, key=lambda r: r._at)] == sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))


# 13: languages


def brute_grams(text):
    """The n-grams of a text as strings, a blank for the marks."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = f" {word} "
        for n in (1, 2, 3):
            out.update(g for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if g.strip())
    return out


@pytest.mark.parametrize("piece", [1, 4, 1 << 18])
def test_grams_equal_brute_force(monkeypatch, piece):
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "  ", "é", "中", "1", "-", "ẞ", "x", "\n", "İ"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(60)]
    texts = [t[:40] for t in texts]
    code = {}
    for gram in set().union(*map(brute_grams, texts)):
        chars = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
        begin, bucket = language_id._grams(chars)
        whole = [b for a, b in zip(begin.tolist(), bucket.tolist(), strict=True) if a == 0]
        code[gram] = whole[-1]
    monkeypatch.setattr(language_id, "PIECE_CHARS", piece)
    monkeypatch.setattr(language_id, "GROUP_CHARS", 50)
    got = [Counter() for _ in texts]
    for where, bucket in language_id.pieces(texts):
        for i, b in zip(where.tolist(), bucket.tolist(), strict=True):
            got[i][b] += 1
    for text, found in zip(texts, got, strict=True):
        want = Counter()
        for gram, n in brute_grams(text).items():
            want[code[gram]] += n
        assert found == want


def test_document_frequencies(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE_CHARS", 16)
    df = frame(spark, [t[:80] if t else t for t in TEXTS]).where("text is not null").coalesce(1)
    frequency, n = language_id.document_frequencies(df)
    want = Counter(b for r in df.collect() for b in language_id.features(r.text)[0].tolist())
    assert n == df.count() and {int(b): int(frequency[b]) for b in np.flatnonzero(frequency)} == want


def test_languages_of_held_out_texts(spark):
    where = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    out = queries.op13_language_id(spark, where).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    right = [r.lang_pred == lang[r.doc_id] for r in held]
    assert np.mean(right) >= 0.97 and all(0 <= r.score <= 1 for r in out)
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05  # calibrated


def test_training_is_sparse_and_calibrated():
    rng = random.Random(2)

    def text(syllables):
        return " ".join("".join(rng.choices(syllables, k=2)) for _ in range(rng.randint(1, 12)))

    tongues = {"p": ["ba", "do", "ki", "ru"], "q": ["el", "no", "ki", "sta"], "r": ["ug", "oz", "ru", "sta"]}
    samples, frequency = [], np.zeros(language_id.BUCKETS, np.int64)
    for name, syllables in tongues.items():
        for _ in range(150):
            at, n = language_id.features(text(syllables))
            frequency[at] += 1
            samples.append((name, at.tolist(), n.tolist()))
    model = language_id.fit(samples, frequency, len(samples))
    assert model.labels == ["p", "q", "r"] and (model.table != 0).sum() < 3 * (frequency > 0).sum()
    texts = [(name, text(s)) for name, s in tongues.items() for _ in range(100)]
    labels, scores = model.predict([t for _, t in texts])
    right = np.array([a == b for a, (b, _) in zip(labels, texts, strict=True)])
    assert right.mean() > 0.9 and abs(scores.mean() - right.mean()) < 0.08


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the of and", "en", "x"), (2, "12 - !", "en", "x"), (3, None, "en", "x"), (None, "the", "en", "x"), (1, "the of and", None, "x"), (5, "", "de", "x")], "doc_id long, text string, lang string, lang_pred string")
    alone = language_id.train(df.where("lang = 'en'"))
    got = sorted((str(r.text), r.lang_pred, r.score) for r in language_id.identify(df, alone).collect())
    assert got == [("", "und", 0.0), ("12 - !", "und", 0.0), ("None", "und", 0.0), ("the", "en", 1.0), ("the of and", "en", 1.0), ("the of and", "en", 1.0)]
    none = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), alone).count() == 0
    long = "und " * 100_000 + "x"
    assert language_id.identify(spark.createDataFrame([(long,), (long,)], "text string"), alone).where("lang_pred = 'en'").count() == 2


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_TEXTS", 10)
    df = spark.createDataFrame([(i % 50, f"t{i}", "a" if i % 3 else "b") for i in range(400)], "doc_id long, text string, lang string")
    counts = {r._label: r["count"] for r in language_id.training_sample(df, "doc_id", "lang", "text").groupBy("_label").count().collect()}
    assert counts == {"a": 5, "b": 5}

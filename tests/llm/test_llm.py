"""The training-data operators against brute force, exact round trips and the libraries."""

import json
import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from kontig.llm import byte_bpe, chat_format, common, components, decontaminate, license_scan, ngram_join, permutation_index, queries, sharding, token_count, toxicity, url_filter

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "a", "  a\n\n b", "don't <|endoftext|> x", "é中😀​", "1٣²", "\x1c\x85", "abc" * 400, None]


def texts_frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), schema)


# 10 and 5: tokens


def test_bpe_equals_library(spark):
    import tiktoken

    codec = byte_bpe.codec(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    alphabet = ["a", "B", " ", "  ", "\n", "é", "中", "1", "!", "'s", "the", "\x1c", "\xa0", "×"]
    texts = [t for t in ODD if t] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(200)]
    assert [x.tolist() for x in codec.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("few", [0, 10_000])
def test_bpe_of_long_pre_tokens(monkeypatch, few):
    """Runs of letters, marks and blanks of many lengths, side by side and alone."""
    import tiktoken

    monkeypatch.setattr(byte_bpe, "FEW", few)
    codec = byte_bpe.SegmentTreeBpe(byte_bpe.codec(RANKS, P.PATTERN).ranks, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choices(alphabet, k=n)) for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "éß中", "=-", "th") for n in (1, 2, 3, 5, 17, 64, 65, 500, 513, 3_000)]
    texts += ["a" * 2_049, "x" * 20_000, "=" * 4_096, " " * 5_000 + "y"]
    assert [x.tolist() for x in codec.encode_batch(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_bpe_round_trip(spark):
    df = texts_frame(spark, ODD + ODD).withColumnRenamed("doc_id", "ids").withColumn("doc_id", F.col("ids"))  # a clashing name
    out = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).orderBy("doc_id").collect()
    assert [bytes(r.decoded) for r in out] == [(t or "").encode() for t in ODD + ODD]
    assert byte_bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_token_counts_equal_library(spark):
    tool = token_count.counter(P.path("byte_bpe_50k.json"))
    texts = ODD + ["word " * 30_000, "x" * 70_000]
    want = [len(tool.tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]
    out = token_count.count_tokens(texts_frame(spark, texts), P.path("byte_bpe_50k.json")).orderBy("doc_id")
    assert [r.n_tokens for r in out.collect()] == want
    rng = random.Random(5)
    for _ in range(150):  # small chunks force widening
        t = "".join(rng.choices(["a", " ", "\n", "é", "1", "!", "<|endoftext|>", "the", "  "], k=rng.randint(0, 80)))
        assert token_count.splice_counts(t, tool.starts, 12, 2) == len(tool.tokenizer.encode(t, add_special_tokens=False))


def test_token_counts_by_other_files(spark, tmp_path):
    """Files for which texts must not be cut: an added token with a blank, one that strips, another pattern."""
    path = P.path("byte_bpe_50k.json")
    said = json.loads(open(path, encoding="utf-8").read())
    added = said["added_tokens"][0]
    pattern = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"[^\s\p{L}\p{N}]+[\r\n]*|\s+|[\p{L}\p{N}]+"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    changes = [{"added_tokens": [added, added | {"id": 50257, "content": "the cat"}]}, {"added_tokens": [added | {"lstrip": True}]}, {"pre_tokenizer": pattern}]
    texts = ["see the cat run the cat", "x  <|endoftext|> y", "end.\n\nnew!\n line", None, "", "a b " * 9_000 + "the cat"]
    assert token_count.cuts_hold(path)
    for k, change in enumerate(changes):
        other = tmp_path / f"{k}.json"
        other.write_text(json.dumps(said | change), encoding="utf-8")
        assert not token_count.cuts_hold(str(other))
        tool = token_count.counter(str(other))
        want = [len(tool.tokenizer.encode(t or "", add_special_tokens=False)) for t in texts]
        out = token_count.count_tokens(texts_frame(spark, texts), str(other)).orderBy("doc_id")
        assert [r.n_tokens for r in out.collect()] == want


def test_token_counts_edges(spark):
    path = P.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, 8)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in token_count.count_tokens(df, path).collect()) == [0, 2, 2]
    assert token_count.count_tokens(df.limit(0), path).count() == 0
    rng = random.Random(12)
    tool = token_count.counter(path)
    texts = ["".join(rng.choices(["a", " ", "\n", "\t", "é", "1", "!", "'s", "<|endoftext|>", "the", "  ", "\u3000", "\r\n"], k=rng.randint(0, 60))) for _ in range(400)]
    assert tool.count_batch(texts) == [len(tool.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


# 3: chats


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>&amp;<|"), (1, 2, "assistant", "a\n&#60;|b"), (2, 0, "assistant", None), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, None, "r"), (5, 0, "us\ner<|", "q")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, valid string")
    out = chat_format.format_chats(df).withColumns({"turns": chat_format.read_back(F.col("formatted")), "loss": chat_format.loss_text(F.col("segments"))})
    got = {r.conv_id: r for r in out.collect()}
    for conv in range(1, 6):
        assert [(t.role, t.text) for t in got[conv].turns] == [(r or "", t or "") for c, _, r, t in rows if c == conv]
    assert got[1].loss == "a\n&#60;|b" and got[1].valid and not got[2].valid and got[3].bad_turn == 1
    assert chat_format.format_chats(df.limit(0)).count() == 0


# 4: shards


def test_sharding(spark, monkeypatch):
    def jump(key, shards):
        key, b, j = key & (2**64 - 1), -1, 0
        while j < shards:
            b = j
            key = (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    keys = [*range(-50, 3000), 2**62, 5, 5, None]
    df = spark.createDataFrame([(k, i, 9) for i, k in enumerate(keys)], "doc_id long, row long, shard int")
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    out = sharding.assign_shards(df, 8, "doc_id", ("row",)).collect()
    assert {r.row: r.shard for r in out} == {i: jump(k or 0, 8) for i, k in enumerate(keys)}
    assert all(r.grown_shard in (r.shard, 8) for r in out)
    for s in range(8):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        ids = [r.doc_id for r in mine if r.doc_id is not None]
        assert ids == sorted(ids)
    assert sharding.assign_shards(df.limit(0), 8).count() == 0


def test_sharding_of_hot_keys(spark, monkeypatch):
    """A third of the rows under one key, a third without a key: slots stay gapless and by key, and no group holds them all."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 50)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, row long")
    cuts, parts = sharding._cuts(df, "doc_id")
    assert parts[-1] == 20 and max(n for r, n in parts.items() if r >= 0) >= 15 and 7.0 in cuts and 8.0 in cuts
    out = sharding.assign_shards(df, 8, "doc_id", ("row",)).collect()
    assert sorted(r.row for r in out) == list(range(3_000))
    for s in range(8):
        mine = sorted((r for r in out if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in mine]
        assert keys == sorted(keys)
    assert len({r.shard for r in out if r.doc_id == 7}) == len({r.shard for r in out if r.doc_id is None}) == 1


def test_op4_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op4_sharding(spark, SF).collect():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")


# 6: near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("nodes", [64, 1])
def test_ngram_join_equals_brute_force(spark, nodes, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)  # few: bundles have several blocks
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = [word() for _ in range(55)]
    texts = [None, "", " \t ", "one two", "ONE two", "one two three"]
    base = [word() for _ in range(120)]
    for k in range(40):  # a chain of copies that drift apart
        base = [word() if rng.random() < 0.012 else w for w in base]
        texts.append(" ".join(base))
    for _ in range(25):  # a common passage with little besides
        own = [word() for _ in range(rng.randint(2, 30))]
        texts.append(" ".join(own + shared))
    for _ in range(20):
        texts.append(" ".join(word() for _ in range(rng.randint(5, 60))))
    texts += texts[10:20]
    rng.shuffle(texts)
    got = ngram_join.link_documents(texts_frame(spark, texts).withColumn("component_id", F.lit("x")))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_hot_passages(spark, monkeypatch):
    """A passage in half of 300 texts, with little besides of many sizes, and a drifting crowd; blocks of a few nodes."""
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 2)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared, other = [word() for _ in range(60)], [word() for _ in range(40)]
    texts = [" ".join(shared)] * 2
    for k in range(150):
        own = [word() for _ in range(rng.randint(0, 24))]
        texts.append(" ".join(own + shared + other[: rng.choice([0, 0, 8, 16])]))
    base = [word() for _ in range(100)]
    for k in range(110):  # near and far copies: some link with the base, some with each other only
        texts.append(" ".join(word() if rng.random() < rng.choice([0.005, 0.02, 0.04]) else w for w in base))
    texts += [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rng.shuffle(texts)
    got = ngram_join.link_documents(texts_frame(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_components(texts)


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 9)
        counts = Counter(x for one in lists for x in one)
        assert dict(ngram_join.divide_skip(lists, least)) == {x: n for x, n in counts.items() if n >= least}


def test_ngram_join_of_null_and_repeated_keys(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (5, text + " x"), (5, "other words that stand alone in here"), (7, None), (None, "quite alone with these few words"), (5, text + " x"), (3, text)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 36, 3), (5, 37, 3), (5, 3, 5), (7, 0, 7), (None, 2, None), (5, 37, 3), (3, 36, 3)], key=str)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.link_documents(texts_frame(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (7, None)] + [(100, k) for k in range(101, 160)], "src long, dst long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 160)}
    assert components.connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [0, 1, 3, 64])
def test_links_by_size_bands(monkeypatch, frequent):
    """The search within a bundle against all pairs, whatever counts as frequent."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng = random.Random(frequent)

    def labels(m, links):
        parent = list(range(m))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[top(a)] = top(b)
        return [min(j for j in range(m) if top(j) == top(i)) for i in range(m)]

    for _ in range(200):
        m, hot = rng.randint(2, 14), range(rng.randint(1, 12))
        sets = [np.array(sorted({*rng.sample(hot, rng.randint(0, len(hot))), *(100 + rng.randrange(30) for _ in range(rng.randint(1, 8)))})) for _ in range(m)]
        n = [len(x) + rng.choice([0, 0, 0, 1]) for x in sets]
        shared = lambda i, j: len({*sets[i].tolist()} & {*sets[j].tolist()})
        want = [(i, j) for i in range(m) for j in range(i) if 100 * shared(i, j) >= 75 * (n[i] + n[j] - shared(i, j))]
        got = ngram_join.links_of(list(range(m)), n, sets, list(range(m)), [True] * m, [False] * m)
        assert labels(m, got) == labels(m, want)


def test_boilerplate_is_not_quadratic():
    """3,000 texts with 80 shingles of boilerplate and 20 of their own, each of which has one near copy with the same boilerplate."""
    import time

    sets = []
    for i in range(1_500):
        own = 1_000 + 40 * i + np.arange(20)
        near = own.copy()
        near[0] += 20
        sets += [np.concatenate([np.arange(80), own]), np.concatenate([np.arange(80), np.sort(near)])]
    began = time.perf_counter()
    found = ngram_join.links_of(list(range(3_000)), [100] * 3_000, sets, list(range(3_000)), [True] * 3_000, [False] * 3_000)
    assert sorted(tuple(sorted(x)) for x in found) == [(2 * i, 2 * i + 1) for i in range(1_500)]
    assert time.perf_counter() - began < 30


# 7: urls


def test_url_filter(spark):
    link = '<html><link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.net/es/x", None), (2, "http://B.org/y?utm_source=z", link.format("https://a.net/es/x/")), (3, "https://c.com/", '<META http-equiv="refresh" content="0; url=http://b.org/y">'),
        (4, "https://www.example.com/en/1", ""), (5, "https://m.example.com/en/1#top", None), (6, "nothing", None), (7, None, None), (8, "http://lone.org", None), (9, "http://d.org/", link.format("/z")), (10, "http://d.org/z", None), (10, "http://d.org/z", None),
    ]
    df = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect() if r.page_id != 10)
    assert got == [
        (1, "a.net", "/es/x", "net/es/", "block"), (2, "b.org", "/y", None, "block"), (3, "c.com", "/", "com/", "allow"), (4, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (5, "m.example.com", "/en/1", "example.com/en/", "block"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "lone.org", "", None, "allow"), (9, "d.org", "/", None, "allow"),
    ]
    assert url_filter.judge(df).count() == len(rows) and url_filter.judge(df.limit(0)).count() == 0


def test_links_and_nothing_else_make_aliases(spark):
    block, canonical = "https://a.net/es/", '<link href={} rel=canonical>'
    rows = [
        (1, block, None, "block"), (2, "https://a.net/es", None, "allow"), (3, "https://a.net/es?ref=1", None, "allow"),  # no link, other urls
        (4, "http://x.org/d/page", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=../up/./b.html">', "block"), (5, "http://x.org/up/b.html#top", canonical.format("'?x=1&amp;y=2'"), "block"),
        (6, "http://X.org:80/up/b.html?x=1&y=2", canonical.format('"HTTPS://A.net:443/es/"'), "block"), (7, "http://y.org", '<base href="http://x.org/up/"><link rel="canonical" href="b.html">', "block"),
        (8, "http://z.org/", '<link rel="canonical" href="mailto:a@b"><link rel="canonical" href="#here">', "allow"), (9, "http://w.org/", '<link rel="canonical" href="http://ok.org"><link rel=canonical href=//q.net/fr/1>', "block"),
        (10, "http://ok.org/", None, "block"), (11, "http://good.com/", canonical.format(block), "allow"), (12, "http://v.org/", canonical.format("http://good.com"), "block"), (13, None, canonical.format(block), "allow"), (14, "http://u.org/a.html", '<link rel="stylesheet" href="https://a.net/es/">', "allow"),
    ]
    got = url_filter.judge(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in got.collect()} == {r[0]: r[3] for r in rows}


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(9)
    hosts = ["a.net/es", "b.net/fr", "c.org/es", "d.org/x", "e.com/es", "www.example.com/en", "example.com/en", "f.org/y"]
    urls = [f"http://{rng.choice(hosts)}/{k}" for k in range(150)]
    links = {u: rng.sample([*urls, "http://out.net/es/1", "http://out.org/1"], rng.choice([0, 0, 1, 1, 2])) for u in urls}
    rows = [(k, u, "".join(f'<link rel="canonical" href="{t}">' for t in links[u])) for k, u in enumerate(urls)]

    def rule(url):
        host, _, path = url.removeprefix("http://").partition("/")
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and f"/{path}".startswith(r.path)]
        return max(fits, key=lambda r: len(r.name)).verdict if fits else None

    group = {u: {u} for u in [*urls, "http://out.net/es/1", "http://out.org/1"]}
    for u in urls:
        for t in links[u]:
            if group[u] is not group[t]:
                joined = group[u] | group[t]
                for x in joined:
                    group[x] = joined
    want = {k: rule(u) or ("block" if any(rule(x) == "block" for x in group[u]) else "allow") for k, u in enumerate(urls)}
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.verdict for r in got.collect()} == want and {"allow", "block"} == set(want.values())


# 8: neighbours


def test_neighbours_of_few(spark):
    vectors = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [1.0, 0.0], None, [0.0, 0.0], [float("nan"), 1.0], [1.0, None], [2.0, 2.0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in permutation_index.search(df, F.col("id") == 0).collect():
        got[r["rank"]] = (r.id, round(r.score, 6))
    assert [got[k] for k in sorted(got)] == [(3, 0.0), (1, 0.1), (2, 1.414214), (8, 2.236068)]
    assert permutation_index.search(df.limit(0), F.col("id") == 0).count() == 0


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    found, asked = 0, 0
    got = {}
    for r in queries.op8_permutation_index(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - np.linalg.norm(x[ids == r.query_id][0] - x[ids == r.vec_id][0])) < 1e-12
    for i in ids[ids % 100 == 0]:
        d = np.linalg.norm(x - x[ids == i][0], axis=1)
        d[ids == i] = np.inf
        found += len(got[i] & set(ids[np.argsort(d)[:10]].tolist()))
        asked += 10
    assert found >= 0.9 * asked


def test_recall_on_many(spark):
    """20,000 vectors with repeated ones, 200 of them asked for, against brute force."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(60, size=20_000)] + 0.6 * rng.normal(size=(20_000, 32))).round(4)
    x[5000:5040] = x[4999]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}))
    got = {}
    for r in permutation_index.search(frame, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    found = 0
    for i in range(0, 20_000, 100):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        assert len(got[i]) == 10 and i not in got[i]
        found += len(set(got[i]) & set(np.lexsort((np.arange(20_000), d))[:10].tolist()))
    assert found >= 0.9 * 10 * 200


# 9: leaks


def test_leaks(spark):
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu."
    items = spark.createDataFrame([(1, item, "x"), (2, "Short one", "x"), (3, "", "x"), (4, None, "x"), (1, item, "x")], "item_id long, text string, n_item string")
    texts = [f"xx {item.lower()} yy", "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a SHORT, one!", "clean text here with nothing to find", None, "", "short none"]
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find_leaks(texts_frame(spark, texts), items).collect())
    assert got == [(0, 1, 8, 8), (1, 1, 8, 6), (2, 2, 1, 1)]
    kept = decontaminate.decontaminate(texts_frame(spark, texts), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.find_leaks(texts_frame(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(texts_frame(spark, texts).limit(0), items).count() == 0


# 2: licences


def test_licences(spark):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."]
    texts = ["intro\n" + "\nwhatever.\n".join(mit), "\n".join(reversed(mit)), "x. Released under the MIT License. y", "LICENSED under cc by-nc 4.0\nfoo", "no licence", "", None]
    out = license_scan.scan(texts_frame(spark, texts).withColumn("licenses", F.lit(1))).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == [["MIT"], [], ["MIT"], ["CC-BY-NC-4.0"], [], [], []]
    assert license_scan.scan(texts_frame(spark, texts).limit(0)).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    from kontig.llm.license_rules import RULES, SENTENCES

    said = dict(SENTENCES)
    rules = [next(r for r in RULES if r[0] == name and r[1][0] == first) for name, first in (("BSD-3-Clause", "bsd-redistribution"), ("BSD-2-Clause", "bsd-redistribution"), ("MIT", "mit-grant"), ("GPL-3.0-or-later", "gpl-redistribute"))]
    texts, want = [], []
    for name, order in rules:
        notice = ".\n\n".join(said[i] for i in order) + "."
        for mark in ("", "// ", " * ", "# ", "rem ", "dnl "):
            for width, end in ((78, "\n"), (50, "\r\n")):
                lines = [line for part in notice.split("\n") for line in (textwrap.wrap(part, width) or [""])]
                texts.append("MIT License\n\nCopyright (c) 2020 x\n\n" * (name == "MIT") + end.join((mark + line).rstrip() for line in lines) + end)
                want.append([name])
    # a sentence between lines without full stops, two notices in neighbouring lines, and a broken link
    texts += ["foo\nLicensed under CC BY\n4.0\nbar", "Released under the MIT License\nLicensed under CC BY 4.0", said["apache2-copy"].replace(" at ", " at\n\n    "), "foo released under the MIT. License", "- " * 20_000 + "MIT"]
    want += [["CC-BY-4.0"], ["MIT", "CC-BY-4.0"], [], [], []]
    out = license_scan.scan(texts_frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in out] == want
    assert out[-3].sentence_ids == ["apache2-copy"]


# 1: toxicity


def test_rules_consume_identifiers(spark):
    """Random orders of known sentences against the rules applied one after the other."""
    rng = random.Random(4)
    sentences = [(name, text) for name, text in license_scan.SENTENCES]
    texts, ids = [None, "", "no licence"], [[], [], []]
    for _ in range(120):
        chosen = [rng.choice(sentences) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.4:  # a whole rule
            order = rng.choice(license_scan.RULES)[1]
            chosen = [next(x for x in sentences if x[0] == name) for name in order] + chosen[:2]
        texts.append("Foo bar.\n" + ". Some words between.\n".join(t.replace(" ", rng.choice([" ", "\n# "])) for _, t in chosen) + ".")
        ids.append([name for name, _ in chosen])

    def licences(left):
        found, left = [], list(left)
        for name, order in license_scan.RULES:
            at, taken = 0, []
            for want in order:
                while at < len(left) and left[at] != want:
                    at += 1
                taken.append(at)
                at += 1
            if at <= len(left):
                # the last place of the first identifier before the second one's, and so on, makes no difference to what is left
                left = [x for k, x in enumerate(left) if k not in taken]
                found += [name] if name not in found else []
        return found

    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan.scan(texts_frame(spark, texts)).collect()}
    for k, want in enumerate(ids):
        assert got[k] == (want, licences(want)), texts[k]
    assert license_scan.scan(texts_frame(spark, texts).limit(0)).count() == 0


def slow_kernel(a, b):
    from itertools import combinations

    def feats(u):
        out, u = {}, f"\x01{u}\x02"  # a unit's ends are symbols too
        for at in combinations(range(len(u)), toxicity.LENGTH):
            span = at[-1] - at[0] + 1
            s = "".join(u[i] for i in at)
            if span <= toxicity.SPAN and s.strip("\x01\x02").isalnum():
                out[s] = out.get(s, 0) + toxicity.DECAY**span
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    p, q = feats(a), feats(b)
    return sum(v * q.get(k, 0) for k, v in p.items())


def test_kernel_equals_definition():
    units = ["idiot", "i.diot", "banana", "abcabcab", "ab", "é中xyz", "idxiot"]
    got = toxicity.Table.of_landmarks(units).kernels(units)
    want = [[slow_kernel(a, b) ** toxicity.POWER for b in units] for a in units]
    assert np.allclose(got, want, atol=1e-6)
    assert toxicity.units_of("i d i o t") >= {"idiot"} and "idiot" in toxicity.units_of("x i.d.i.o.t")


@pytest.mark.parametrize("form", ["i..d..i..o..t", "i  d  i  o  t", "i \t d\ni  o  t", "i*-d*-i*-o*-t", "i - d - i - o - t", "i.. d , i__o -- t", "i...d...iot", "i_____diot", "id--i.o--t"])
def test_spelled_with_wide_separators(form):
    assert "idiot" in toxicity.units_of(f"you {form}, really")
    assert "idiot" not in toxicity.units_of("you and i d. is idle. i ought to")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op1_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    clean = [r for r in rows if truth[r.doc_id] == 0]
    toxic = [r for r in rows if truth[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)


def insulting(rng, insults, count):
    """Sentences of made-up words, every fourth with one of the insults, and their labels."""
    word = lambda: "".join(rng.choice(["the", "re", "on", "and", "sti", "lo", "ca", "mer", "vi", "ta"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for k in range(count):
        words = [word() for _ in range(rng.randint(6, 40))]
        if k % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        texts.append(" ".join(words) + ".")
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_inserted_characters():
    """One letter, digit or sign at any inner place of an insult, against at most 2 % of clean texts rejected."""
    rng = random.Random(3)
    insults = ["grumbold", "stinker", "pigface", "dumbhead", "wretch"]
    model = toxicity.fit(*insulting(rng, insults, 900))
    judged = lambda texts: [float(model.probability(np.array([model.worst(toxicity.units_of(t))]))[0]) >= 0.5 for t in texts]
    texts, labels = insulting(rng, insults, 900)
    found = judged(texts)
    assert sum(f for f, y in zip(found, labels, strict=True) if not y) <= 0.02 * labels.count(0)
    assert sum(f for f, y in zip(found, labels, strict=True) if y) >= 0.98 * labels.count(1)
    forms = [f"the {w[:k]}{c}{w[k:]} and" for w in insults for c in "axz19*-" for k in range(1, len(w))]
    assert sum(judged(forms)) >= 0.8 * len(forms)
    assert all(judged(["the " + " ".join("stinker"), "p.i.g.f.a.c.e", "w - r - e - t - c - h", "re GRUMBOLD!!"]))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot fool" if i % 2 else "a kind word") for i in range(20)] + [(20, None), (21, ""), (22, "x" * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()}
    assert got[1] > 0.5 > got[0] and max(got[20], got[21], got[22]) < 0.5
    assert toxicity.train(docs, labels.limit(0)) is toxicity.EMPTY
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [2.0, 1.0]), (1, [1.0, 9.0]), (1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, [1.0]), (None, [1.0, 1.0]), (4, [-1.0, 5.0])]
    got = permutation_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted((r.id, list(r.vec)) for r in got) == [(1, [1.0, 3.0]), (4, [-1.0, 5.0])]


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        out = stage(spark, out, SF).cache()
        assert out.columns == docs.columns and 0 < out.count() <= before, name
    ids = {r.doc_id for r in out.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids and all(r.whole for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(ids)
    got = brute_components([texts[i] for i in kept])
    assert all(i == c for i, _, c in got)  # no near duplicates are left


def test_pipeline_stages_on_odd_tables(spark):
    """Null keys and texts, repeated rows, extra columns with clashing names, and nothing at all."""
    import corpus_pipeline

    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, "en", "a"), (2, words + " more", "en", "a"), (2, words + " more", "en", "a"), (None, words, None, None), (None, None, None, None), (3, None, "en", "b"), (4, "", "en", "b"), (5, "x" * 200_000, "en", None)]
    docs = spark.createDataFrame([(*r, 9, "c", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, component_id string, score double")
    kept = {"toxicity": len(rows), "ngram_jaccard_join": 6, "decontamination": len(rows), "byte_bpe": len(rows)}  # both rows of the second document go
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == kept[name] and stage(spark, docs.limit(0), SF).count() == 0, name
        if name != "byte_bpe":
            assert out.columns == docs.columns


def test_shared_folder_is_asked_for():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_op3_digests(spark):
    row = next(r for r in queries.op3_chat_format(spark, SF).collect() if r.conv_id == -1)
    s = "<|im_end|><|im_start|>assistant ok"
    assert row.turns_sha256 == sha256(f"user\n{s}\nassistant\n{s}\n".encode()).hexdigest()
    assert row.loss_sha256 == sha256(s.encode()).hexdigest() and row.loss_chars == len(s)


@pytest.mark.parametrize(
    ("html", "linked"),
    [
        ('<!-- <link rel="canonical" href="https://b.net/fr/"> -->', False),
        ("<script>var s = '<link rel=\"canonical\" href=\"https://b.net/fr/\">'</script>", False),
        ('<style>/*<link rel=canonical href="https://b.net/fr/">*/', False),
        ('<link rel="not-canonical" href="https://b.net/fr/">', False),
        ('<link rel="canonical-x canonicals" href="https://b.net/fr/">', False),
        ('<link data-href="zz" rel="next CANONICAL" href="https://b.net/fr/">', True),
        ('<link rel=canonical data-href=zz HREF = https://b.net/fr/>', True),
        ('<link title="a > b" rel=\'canonical\' href=\'https://b.net/fr/\'>', True),
        ('<link title="rel=canonical href=https://b.net/fr/">', False),
        ('<link href="https://b.net/fr/" rel="canonical"/>', True),
        ('<linker rel="canonical" href="https://b.net/fr/">', False),
        ('<meta http-equiv="refresh" content="0;https://b.net/fr/">', True),
        ('<meta content="3; URL=\'https://b.net/fr/\'" http-equiv=Refresh>', True),
        ('<meta http-equiv=refresh content="0 https://b.net/fr/">', True),
        ('<meta http-equiv="refresh" content="5">', False),
        ('<meta name="x" content="0;url=https://b.net/fr/">', False),
        ('<!-- a --><p canonical><link rel="canonical" href="//b.net/fr/"><!-- b', True),
    ],
)
def test_link_extraction(spark, html, linked):
    pages = spark.createDataFrame([("https://a.org/", html), ("https://a.org/", None), (None, html)], "url string, html string")
    assert [tuple(r) for r in url_filter.link_edges(pages).collect()] == ([("https://a.org/", "https://b.net/fr/")] if linked else [])


def test_very_long_html(spark):
    html = "<p a='" + "x" * 300_000 + "'>" + "<link title='" + "y>" * 100_000 + "' rel=canonical href=/z><!--" + "-" * 200_000
    assert [tuple(r) for r in url_filter.link_edges(spark.createDataFrame([("https://a.org/", html)], "url string, html string")).collect()] == [("https://a.org/", "https://a.org/z")]

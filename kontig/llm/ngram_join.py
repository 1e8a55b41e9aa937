"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), with connected components.

A document's set is its distinct five-word shingles as 64-bit hashes; equal sets are one class. Two
classes link when 100 * |intersection| >= 75 * |union|, so each holds three quarters of the larger one.

1. Peeling. A class can only link if three quarters of its shingles occur in another class too. The
   shingles below a fixed hash bound are posted first: a class with ``rest`` shingles above it shares at most
   its lists' occurrences plus ``rest``. All shingles of the classes left over are posted next, and what
   becomes unique as classes go peels further ones off.
2. Nodes. What is left of a class are its *shared* shingles. Classes with equal shared shingles S meet in exactly S,
   so they link when 100 * |S| >= 75 * (n + m - |S|): a star around the smallest of them holds all their links
   among themselves, and whatever a larger one in the star links with, the smallest does too. One node stands for the star, and one
   for each size n that is too large for it (fewer than |S| / 3 sizes).
3. Bundles. Nodes order their shingles by frequency, rare ones first; linked nodes share one of the first
   k - ceil(0.75 n) + 1 (prefix filter). These inverted lists are gathered by their *lead*, the member with the fewest unshared
   shingles, so that a node goes to few bundles instead of many lists.
4. T-occurrence search. In a bundle all shingles of its nodes form inverted lists again. For a node the
   short lists are heap-merged, the T - 1 longest put aside and probed by binary search (DivideSkip); entries that
   reach the overlap their sizes ask for are links. Pairs that are connected already are passed over.
5. Large bundles are split into blocks: first each block against itself and the lead, then, where more than one component is
   left, the nodes outside the largest one against all blocks. Only links that join two components leave a task.

No link between components is lost and no list is capped. Blocks are bounded in bytes and in nodes; hot lists
meet only in aggregations with partial results and in joins that adaptive execution splits.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; fewer than five
words make one shingle of all words; repeated rows and keys are members of one class or of
several; rows with a null key are linked like others, but name no component (one of null keys alone has a null
component_id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import Scratch, give_back, released, small
from kontig.llm.components import connected_components

WORDS, PERCENT = 5, 75
#: Shingles up to this hash (0.3 of all; more than a quarter is needed) are posted in the first peeling.
BOUND = int(-(2**63) + 0.3 * 2**64)
#: A bundle of m nodes has about sqrt(m / BLOCK_NODES) blocks, and more where one would exceed BLOCK_BYTES of shingles.
BLOCK_NODES, BLOCK_BYTES = 64, 16_000_000
#: Nodes beyond which a shingle of a bundle is frequent.
FREQUENT = 64
#: Peeling ends when a round takes off less than this share of the classes.
STILL = 0.05
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z only, ASCII white space
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64).view(np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for i in range(WORDS):
        x = w[i : i + n] * _MULTIPLIERS[i]
        h = (h ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def class_id(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), len(h))).view(np.int64))


def least_overlap(n: int) -> int:
    """Shingles that any linked class shares with one of n."""
    return -(-PERCENT * n // 100)


def _sets(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, text) to (doc_id, n, c, posted): the shingles up to BOUND, or all."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ns, cs, flat, ends = [], [], [], [0]
            for value in batch.column(1):
                h = shingles(value.as_py())
                posted = h if whole else h[: int(np.searchsorted(h, BOUND, "right"))]
                ns.append(len(h))
                cs.append(class_id(h) if len(h) else None)
                flat.append(posted)
                ends.append(ends[-1] + len(posted))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), lists], ["doc_id", "n", "c", "posted"])

    return docs.select("doc_id", "text").mapInArrow(lambda batches: released(run(batches)), "doc_id long, n long, c long, posted array<long>")


def _shared(posted: DataFrame) -> DataFrame:
    """The rows of (c, h) whose shingle is in two classes at least."""
    often = posted.groupBy("h").agg(F.count("*").alias("f")).where("f > 1").select("h")
    return posted.join(often, "h").select("c", "h")


def _peeled(scratch: Scratch, docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step 1: the classes that may link (c, n), and their shared shingles (c, h)."""
    lone = F.col("doc_id").isNull()
    reps = table.where("c is not null").groupBy("c").agg(F.min(F.struct(lone.alias("lone"), "doc_id", "row")).alias("rep"))
    reps = scratch.write(reps.select("c", "rep.doc_id", "rep.row"), "reps")
    n_reps = reps.count()
    first = table.join(small(reps.select("row"), n_reps, 1_000_000), "row")
    posted = first.select("c", F.explode("posted").alias("h"))
    held = first.select("c", "n", "doc_id", (F.col("n") - F.size("posted")).alias("rest"))
    able = _shared(posted).groupBy("c").agg(F.count("*").alias("k")).join(held, "c", "right")
    able = able.where(f"coalesce(k, 0) + rest >= ceil({PERCENT} * n / 100)").select("c", "n", "doc_id")
    able = scratch.write(able, "able")
    n_able = able.count()

    keys = able.select(F.col("doc_id").alias("key")).distinct()
    texts = docs.join(small(keys, n_able, 1_000_000), F.col("doc_id").eqNullSafe(F.col("key")), "left_semi")
    whole = _sets(texts, True).join(small(able.select("c"), n_able, 1_000_000), "c", "left_semi").select("c", "posted")
    whole = scratch.write(whole, "whole")
    if whole.count() > n_able:  # keys that repeat
        before, whole = whole, scratch.write(whole.dropDuplicates(["c"]), "whole")
        scratch.drop(before)
    shared = scratch.write(_shared(whole.select("c", F.explode("posted").alias("h"))), "shared")
    scratch.drop(whole, reps)
    while True:
        counted = shared.groupBy("c").agg(F.count("*").alias("k"))
        left = scratch.write(counted.join(able, "c").where(f"k >= ceil({PERCENT} * n / 100)").select("c", "n"), "able")
        n_before, n_able = n_able, left.count()
        scratch.drop(able)
        able, kept = left, shared.join(small(left.select("c"), n_able, 1_000_000), "c", "left_semi")
        if n_able >= (1 - STILL) * n_before:
            return able, kept
        peeled = scratch.write(_shared(kept), "shared")
        scratch.drop(shared)
        shared = peeled


def divide_skip(lists: list[list[int]], least: int, wanted: Callable[[int], bool] = lambda entry: True) -> Iterator[tuple[int, int]]:
    """(entry, occurrences) of all entries in at least ``least`` of the sorted lists.

    The least - 1 longest lists are put aside: an entry must occur in one of the others. Those are
    heap-merged, and what is in enough of them, and ``wanted``, is probed in the long ones by binary search.
    """
    lists = sorted(lists, key=len)
    aside = max(0, min(least, len(lists)) - 1)
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    for entry, same in groupby(heapq.merge(*short)):
        count = sum(1 for _ in same)
        if count + aside >= least and wanted(entry):
            for at, other in enumerate(long):
                if count + aside - at < least:
                    break
                place = bisect_left(other, entry)
                count += place < len(other) and other[place] == entry
            if count >= least:
                yield entry, count


class _Union:
    """Connected labels."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def unite(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def links_of(node: list[int], n: list[int], sets: list[np.ndarray], label: list[int], asks: list[bool], lead: list[bool]) -> list[tuple[int, int]]:
    """Links that connect the labels of all nodes that link with one that ``asks``.

    The lead is searched for first; when it connects many, the other askers within its component are left to those outside.
    """
    order = sorted(range(len(node)), key=lambda i: (n[i], node[i]))
    place = np.empty(len(node), int)
    place[order] = np.arange(len(node))
    sizes = [n[i] for i in order]
    owner = np.repeat(place, [len(h) for h in sets])
    flat = np.concatenate(sets)
    by = np.lexsort((owner, flat))
    keys, begin = np.unique(flat[by], return_index=True)
    begin, entries = np.append(begin, len(flat)).tolist(), owner[by].tolist()
    union, found = _Union(), []

    def search(i: int, done: int = -1) -> None:
        """All links of the node i, with askers up to the place ``done`` left out.

        Sizes for which i's frequent shingles are too few to link are searched on their own: there all frequent lists are put
        aside, and candidates come from the rare ones.
        """
        places = [(begin[k], begin[k + 1]) for k in np.searchsorted(keys, sets[i]).tolist() if begin[k + 1] - begin[k] > 1]
        least, most = least_overlap(n[i]), 100 * n[i] // PERCENT
        frequent = sum(b - a > FREQUENT for a, b in places)
        edge = min(most, frequent * (100 + PERCENT) // PERCENT - n[i])  # the largest size that frequent shingles alone can link with

        def wanted(at: int) -> bool:
            j = order[at]
            return not (asks[j] and at <= done) and union.find(label[j]) != union.find(label[i])

        for smallest, largest in ((least, edge), (max(least, edge + 1), most)):
            needed = -(-PERCENT * (n[i] + smallest) // (100 + PERCENT))
            low, high = bisect_left(sizes, smallest), bisect_left(sizes, largest + 1)
            if low >= high or len(places) < needed:
                continue
            lists = []
            for a, b in places:
                a, b = bisect_left(entries, low, a, b), bisect_left(entries, high, a, b)
                if b > a:
                    lists.append(entries[a:b])
            if len(lists) < needed:
                continue
            for at, count in divide_skip(lists, needed, wanted):
                j = order[at]
                if 100 * count >= PERCENT * (n[i] + n[j] - count) and union.unite(label[i], label[j]):
                    found.append((node[i], node[j]))

    hub = None
    for i in range(len(node)):
        if lead[i]:
            search(i)
            hub = i
    for at, i in enumerate(order):
        # a pair with the hub's component is met from its other end, which asks too
        if asks[i] and (hub is None or not asks[hub] or union.find(label[i]) != union.find(label[hub])):
            search(i, at if hub is None else -1)
    return found


def _find(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Links (a, b) within each group of (*keys, node, n, hs, label, asks, lead)."""

    def run(table: pa.Table) -> pa.Table:
        n, label, asks, lead = (table[x].to_pylist() for x in ("n", "label", "asks", "lead"))
        sets = [np.asarray(x.values) for x in table["hs"]]
        node = table["node"].to_pylist()
        found = links_of(node, n, sets, label, asks, lead) if any(asks) and len(set(label)) > 1 else []
        if table.nbytes > 1 << 20:
            del sets
            give_back()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.select(*keys, "node", "n", "hs", "label", "asks", "lead").groupBy(*keys).applyInArrow(run, "a long, b long")


def _blocks(count: str, size: str) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.col(count) / BLOCK_NODES)), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _block(of: str) -> Column:
    return F.pmod(F.xxhash64("node", "bundle"), F.col(of)).cast("int")


def _bundle_links(scratch: Scratch, sets: DataFrame) -> DataFrame:
    """Steps 3 to 5: links (a, b) that connect all linked nodes (node, n, k, hs), hs by rising frequency."""
    prefix = sets.select("node", "n", "k", F.explode(F.slice("hs", F.lit(1), (F.col("k") - F.ceil(PERCENT * F.col("n") / 100) + 1).cast("int"))).alias("h"))
    lead = prefix.groupBy("h").agg(F.count("*").alias("f"), F.min(F.struct((F.col("n") - F.col("k")).alias("own"), "n", "node")).alias("lead")).where("f > 1")
    member = scratch.write(prefix.join(lead.select("h", F.col("lead.node").alias("bundle")), "h").select("bundle", "node").distinct(), "member")
    width = member.join(sets.select("node", "k"), "node").groupBy("bundle").agg(F.count("*").alias("m"), F.sum(8 * F.col("k")).alias("bytes"))
    width = scratch.write(width.select("bundle", _blocks("m", "bytes").alias("blocks")), "width")
    dealt = member.join(width, "bundle").withColumn("lead", F.col("bundle") == F.col("node"))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block("blocks")))))
    rows = dealt.join(sets, "node").select("*", F.col("node").alias("label"), F.lit(True).alias("asks"))
    links = scratch.write(_find(rows, ["bundle", "block"]), "links")
    large = width.where("blocks > 1").select("bundle")
    n_large = large.count()
    if not n_large:
        scratch.drop(member, width)
        return links

    component = scratch.write(connected_components(links, "a", "b", scratch), "component")
    open_ = member.join(small(large, n_large), "bundle", "left_semi").join(component, "node", "left").withColumn("label", F.coalesce("component", "node"))
    open_ = scratch.write(open_.join(sets.select("node", "k"), "node").select("bundle", "node", "label", "k"), "open")
    each = open_.groupBy("bundle", "label").agg(F.count("*").alias("m"), F.sum(8 * F.col("k")).alias("bytes"))
    most = each.groupBy("bundle").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    sides = each.join(most, "bundle").groupBy("bundle", "most").agg(*[F.sum(F.when((F.col("label") == F.col("most")) == inside, F.col(x))).alias(f"{x}_{side}") for side, inside in (("in", True), ("out", False)) for x in ("m", "bytes")])
    sides = scratch.write(sides.select("bundle", "most", _blocks("m_in", "bytes_in").alias("inner"), _blocks("m_out", "bytes_out").alias("outer")), "sides")
    told = open_.join(sides, "bundle").withColumn("asks", F.col("label") != F.col("most"))
    # an asker's block meets the blocks of the inner side (y from 0) and the askers' blocks not before it (y below 0)
    mine = _block("outer")
    each_of = lambda count, at: F.transform(F.sequence(F.lit(0), F.col(count) - 1), at)
    key = lambda x, y, asks: F.struct(x.alias("x"), y.alias("y"), asks.alias("asks"))
    pairs = each_of("outer", lambda j: key(F.least(mine, j), -1 - F.greatest(mine, j), mine <= j))
    inner = each_of("inner", lambda j: key(mine, j, F.lit(True)))
    outside = each_of("outer", lambda j: key(j, _block("inner"), F.lit(False)))
    told = told.withColumn("at", F.explode(F.when(F.col("asks"), F.concat(pairs, inner)).otherwise(outside)))
    rows = told.select("bundle", "node", "label", "at.*", F.lit(False).alias("lead")).join(sets, "node")
    more = scratch.write(_find(rows, ["bundle", "x", "y"]), "links")
    scratch.drop(member, width, component, open_, sides)
    return links.union(more)


def link_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key reachable by links."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    table = scratch.write(_sets(docs, False).withColumn("row", F.monotonically_increasing_id()), "classes")
    able, shared = _peeled(scratch, docs, table)
    members = scratch.write(table.select("doc_id", "n", "c"), "members")
    scratch.drop(table)

    # nodes: classes of equal shared shingles and size, and of these the smallest for all that are linked with it
    mark = shared.groupBy("c").agg(F.count("*").alias("k"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    marked = scratch.write(mark.join(able, "c"), "marked")
    sized = marked.groupBy("k", "x", "y", "n").agg(F.min("c").alias("node"))
    least = sized.groupBy("k", "x", "y").agg(F.min(F.struct("n", "node")).alias("least"))
    linked = lambda n, m: F.expr(f"100 * k >= {PERCENT} * ({n} + {m} - k)")
    entries = sized.withColumnRenamed("node", "c").join(least, ["k", "x", "y"]).withColumn("whole", linked("n", "least.n"))
    entries = scratch.write(entries.withColumn("node", F.when(F.col("whole"), F.col("least.node")).otherwise(F.col("c"))).drop("least"), "entries")

    nodes = entries.where("c = node").select("c", "n")
    posted = scratch.write(shared.join(nodes, "c").select(F.col("c").alias("node"), "n", "h"), "posted")
    often = posted.groupBy("h").agg(F.count("*").alias("f")).where("f > 1")
    sets = posted.join(often, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s"))
    sets = sets.select("node", "n", F.size("s").alias("k"), F.col("s.h").alias("hs")).where(f"k >= ceil({PERCENT} * n / 100)")
    sets = scratch.write(sets, "sets")
    scratch.drop(posted)
    component = connected_components(_bundle_links(scratch, sets), "a", "b", scratch)

    # a node's classes are linked through its links, or among themselves
    label = entries.drop("c").join(component, "node", "left").where("component is not null or whole").select("k", "x", "y", "n", F.coalesce("component", "node").alias("label"))
    labels = scratch.write(marked.join(label, ["k", "x", "y", "n"]).select("c", "label"), "labels")
    named = scratch.write(members.join(labels, "c", "left").select("doc_id", "n", F.coalesce("label", "c").alias("label")), "named")
    scratch.drop(members, marked, entries, sets, labels)
    lowest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = named.join(lowest, "label", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

"""Classification of a query by its aligned segments on each subject."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kontig.params import DISJUNCT_DISTANCE, END_IGNORE, END_VARIATION, IDENTITY, MIN_QUERY_LEN, MIN_SEGMENT_LEN, SHORT_IDENTITY_FACTOR, SHORT_QUERY_LEN

PERFECT, MATCHED, DISJUNCT, UNMATCHED = range(4)


def identity_threshold(query_len: Column) -> Column:
    return F.when(query_len <= SHORT_QUERY_LEN, IDENTITY * SHORT_IDENTITY_FACTOR).otherwise(IDENTITY)


def _apart(a: dict, b: dict, strand: int, subject_len: int | None) -> int:
    """How far ``b`` begins behind the end of ``a`` on the subject, read along ``strand``; on a circular one the shorter way round."""
    d = b["s_start"] - a["s_end"] if strand == 0 else a["s_end"] - b["s_start"]
    return d if subject_len is None else min((d, d - subject_len, d + subject_len), key=abs)


class _Ends:
    """Segments by the place of one of their ends; those left over are found outwards from a place, without meeting the used ones again."""

    def __init__(self, segs: list[dict], end: str) -> None:
        self.segs = sorted(segs, key=lambda s: s[end])
        self.places = [s[end] for s in self.segs]
        self.row = {s["hsp"]: i for i, s in enumerate(self.segs)}
        self.behind, self.before = list(range(len(segs) + 1)), list(range(len(segs) + 1))  # of row i - 1 in ``before``

    @staticmethod
    def _find(links: list[int], i: int) -> int:
        while links[i] != i:
            links[i] = links[links[i]]
            i = links[i]
        return i

    def remove(self, hsp: int) -> None:
        i = self.row[hsp]
        self.behind[i], self.before[i + 1] = i + 1, i

    def outwards(self, place: int, lo: int, hi: int) -> Iterator[tuple[int, list[dict]]]:
        """(distance, segments at it), nearest first, among the rows from ``lo`` to before ``hi``."""
        middle = min(max(bisect_left(self.places, place), lo), hi)
        right, left = self._find(self.behind, middle), self._find(self.before, middle) - 1
        while right < hi or left >= lo:
            d = min(abs(self.places[i] - place) for i in (left, right) if lo <= i < hi)
            level = []
            while right < hi and abs(self.places[right] - place) == d:
                level.append(self.segs[right])
                right = self._find(self.behind, right + 1)
            while left >= lo and abs(self.places[left] - place) == d:
                level.append(self.segs[left])
                left = self._find(self.before, left) - 1
            yield d, level


#: Segments of a pair up to which a step of its chain scans what is left, which is quicker for so few than an index.
FEW_SEGMENTS = 48


def _scanned(segs: list[dict], useful: list[dict], subject_len: int | None) -> list[dict]:
    """The greedy chain of ``_chain`` by a scan of the useful segments left for each step."""
    left = [(s["q_start"], s["q_end"], s["s_start"], s["s_end"], s["strand"], s["hsp"], s) for s in useful]
    first = segs[0]
    chain = deque([(first["q_start"], first["q_end"], first["s_start"], first["s_end"], first["strand"], first["hsp"], first)])

    def pick(edge: tuple, right: bool) -> tuple | None:
        q_start, q_end, s_start, s_end, strand = edge[:5]
        best = found = None
        for x in left:
            if right:
                if x[0] <= q_start:
                    continue
                dq, ds = abs(x[0] - q_end), abs(x[2] - s_end)
            else:
                if x[1] >= q_end:
                    continue
                dq, ds = abs(q_start - x[1]), abs(s_start - x[3])
            if subject_len is not None:
                ds = min(ds, abs(ds - subject_len))
            tier = 2 if x[4] != strand else 0 if dq <= END_VARIATION and ds <= END_VARIATION else 1
            rank = (tier, dq, ds, x[5])
            if best is None or rank < best:
                best, found = rank, x
        return found

    for right in (True, False):
        while left and (found := pick(chain[-1] if right else chain[0], right)) is not None:
            left.remove(found)
            (chain.append if right else chain.appendleft)(found)
    return [x[6] for x in chain]


def _chain(segs: list[dict], subject_len: int | None = None) -> list[dict]:
    """Greedy chain from the first segment: to the right, then to the left, the closest that fits; then left-over segments go into its holes.

    A neighbour on the same strand within 1000 on both sides comes first, then on the same strand by
    the query alone, then on any strand. With ``subject_len`` the subject is circular.
    """
    useful = [s for s in segs[1:] if s["total_len"] > MIN_SEGMENT_LEN]
    if len(useful) <= FEW_SEGMENTS:
        few = _scanned(segs, useful, subject_len)
        return _filled(few, {s["hsp"] for s in few}, segs)
    index = {(strand, end): _Ends([s for s in useful if s["strand"] == strand], end) for strand in {s["strand"] for s in segs} for end in ("q_start", "q_end")}
    chain = deque([segs[0]])

    def pick(edge: dict, right: bool) -> dict | None:
        own, far = ("q_start", "q_end") if right else ("q_end", "q_start")
        place = edge[far]
        off = lambda s: abs(_apart(edge, s, edge["strand"], subject_len) if right else _apart(s, edge, edge["strand"], subject_len))

        def levels(strand: int) -> Iterator[tuple[int, list[dict]]]:
            ends = index[strand, own]
            return ends.outwards(place, bisect_right(ends.places, edge[own]), len(ends.places)) if right else ends.outwards(place, 0, bisect_left(ends.places, edge[own]))

        nearest = None
        for d, level in levels(edge["strand"]):
            best = min(level, key=lambda s: (off(s), s["hsp"]))
            if d <= END_VARIATION and off(best) <= END_VARIATION:
                return best
            nearest = nearest or best
            if d > END_VARIATION:
                break
        if nearest is None:
            others = [next(levels(strand), None) for strand in {k for k, _ in index} - {edge["strand"]}]
            near = [(d, off(s), s["hsp"], s) for d, level in filter(None, others) for s in level]
            nearest = min(near, key=lambda x: x[:3])[3] if near else None
        return nearest

    used = {segs[0]["hsp"]}
    for right in (True, False):
        while (found := pick(chain[-1] if right else chain[0], right)) is not None:
            used.add(found["hsp"])
            for end in ("q_start", "q_end"):
                index[found["strand"], end].remove(found["hsp"])
            (chain.append if right else chain.appendleft)(found)
    return _filled(list(chain), used, segs)


def _filled(chain: list[dict], used: set[int], segs: list[dict]) -> list[dict]:
    return _fill(chain, sorted((s for s in segs if s["hsp"] not in used and s["match_len"] >= MIN_QUERY_LEN), key=lambda s: s["q_start"]))


def _fill(chain: list[dict], left: list[dict], slack: int = 100) -> list[dict]:
    """The chain with one left-over segment, the aligner's best, in each hole that it fits into up to ``slack`` bases."""
    starts, used, out = [s["q_start"] for s in left], set(), chain[:1]
    for a, b in zip(chain, chain[1:], strict=False):
        if a["q_end"] < b["q_start"]:
            fits = [s for s in left[bisect_right(starts, a["q_end"] - slack) : bisect_left(starts, b["q_start"] + slack)] if s["q_end"] < b["q_start"] + slack and s["hsp"] not in used]
            if fits:
                best = min(fits, key=lambda s: s["hsp"])
                used.add(best["hsp"])
                out.append(best)
        out.append(b)
    return out


def _perfect_tiling(chain: list[dict], query_len: int, subject_len: int | None) -> list[dict]:
    """The part of a chain that leads from its head to the query's end in steps of one base on query and subject; the whole chain if none does."""
    path = chain[:1]
    for s in chain[1:]:
        last = path[-1]
        step = last["s_end"] + (1 if last["strand"] == 0 else -1)
        follows = s["s_start"] == (step if subject_len is None else (step - 1) % subject_len + 1)
        if s["strand"] == last["strand"] and s["q_start"] == last["q_end"] + 1 and follows:
            path.append(s)
        if path[-1]["q_end"] == query_len:
            return path
    return chain


def _wraps(a: dict, b: dict, subject_len: int | None) -> bool:
    """Whether the step from ``a`` to ``b`` leads over the end of a circular subject."""
    if subject_len is None or a["strand"] != b["strand"]:
        return False
    high, low = subject_len - END_VARIATION, END_VARIATION
    return a["s_end"] >= high and b["s_start"] <= low if a["strand"] == 0 else a["s_end"] <= low and b["s_start"] >= high


def _disjunct(chain: list[dict], subject_len: int | None = None) -> bool:
    def far(a: dict, b: dict) -> bool:
        d = b["s_start"] - a["s_end"]
        return (subject_len - abs(d) if _wraps(a, b, subject_len) else abs(d)) > DISJUNCT_DISTANCE

    return any(b["total_len"] >= SHORT_QUERY_LEN and (a["strand"] != b["strand"] or far(a, b)) for a, b in zip(chain, chain[1:], strict=False))


def kept_segments(query_len: int, segs: list[dict], subject_len: int | None = None) -> list[dict]:
    """The segments, in order along the query, that stand for a query on one subject; ``segs`` in the aligner's order, best first."""
    if not segs:
        return []
    first = segs[0]
    t = IDENTITY * (SHORT_IDENTITY_FACTOR if query_len <= SHORT_QUERY_LEN else 1)
    if first["match_len"] == max(query_len, first["total_len"]) or first["match_len"] < first["total_len"] * t - 1e-9:
        return [first]
    return _perfect_tiling(_chain(segs, subject_len), query_len, subject_len)


def match_kind(query_len: int, segs: list[dict], subject_len: int | None = None, chain: list[dict] | None = None) -> int:
    """Kind of one query on one subject, circular if its length is given; ``segs`` in the aligner's order, best first, ``chain`` their ``kept_segments`` if known."""
    if not segs:
        return UNMATCHED
    first = segs[0]
    t = IDENTITY * (SHORT_IDENTITY_FACTOR if query_len <= SHORT_QUERY_LEN else 1)
    whole = max(query_len, first["total_len"])
    if first["match_len"] == whole:
        return PERFECT
    if first["match_len"] < first["total_len"] * t - 1e-9:
        return UNMATCHED
    chain = kept_segments(query_len, segs, subject_len) if chain is None else chain
    if len(chain) == 1:
        return MATCHED if chain[0]["match_len"] >= whole * t - 1e-9 else UNMATCHED
    steps = list(zip(chain, chain[1:], strict=False))
    exact = all(s["match_len"] == s["total_len"] for s in chain) and sum(s["match_len"] for s in chain) == query_len
    round_ = all(b["q_start"] == a["q_end"] + 1 for a, b in steps) and chain[0]["s_start"] == chain[-1]["s_end"] + 1
    if exact and (any(_wraps(a, b, subject_len) for a, b in steps) or subject_len is None and round_):
        return PERFECT  # a circular subject that the query goes around
    if sum(s["total_len"] for s in chain) < whole * t - 1e-9:
        return UNMATCHED
    return DISJUNCT if _disjunct(chain, subject_len) else MATCHED


def single_kind(query_len: Column, match_len: Column, total_len: Column) -> Column:
    """Kind of a query with one segment on a subject."""
    whole, t = F.greatest(query_len, total_len), identity_threshold(query_len)
    unlike = (match_len < total_len * t - 1e-9) | (match_len < whole * t - 1e-9)
    return F.when(match_len == whole, PERFECT).when(unlike, UNMATCHED).otherwise(MATCHED).cast("int")


def global_kind(pairs: DataFrame, query: str = "query_id", subject: str = "subject_id") -> DataFrame:
    """(query, kind): one kind for a query from its pairs (kind, weight) and the segments behind them.

    ``pairs`` also have ``total`` (length of the pair's segments), ``good`` (segments above the identity threshold), ``covered``
    (bases of the query under its segments, over all subjects) and ``query_len``. A query on its best subject alone has that
    kind. With others besides, perfect stays, matched and disjunct become disjunct, and unmatched becomes disjunct if some segment is
    good and the segments' lengths and the covered bases reach the identity share of the query.
    """
    order = F.struct(F.col("kind"), -F.col("weight"), F.col(subject))
    per = pairs.groupBy(query).agg(F.min_by("kind", order).alias("best"), F.count_distinct(subject).alias("subjects"), F.sum("good").alias("good"), F.sum("total").alias("total"), F.max("covered").alias("covered"), F.max("query_len").alias("len"))
    spread = (F.col("good") > 0) & (F.col("total") >= IDENTITY * F.col("len")) & (F.col("covered") >= IDENTITY * F.col("len"))
    kind = F.when((F.col("best") == PERFECT) | (F.col("subjects") == 1), F.col("best")).when(F.col("best") < UNMATCHED, DISJUNCT).when(spread, DISJUNCT).otherwise(UNMATCHED)
    return per.select(query, kind.cast("int").alias("kind"))


def classify_pairs(items: DataFrame) -> DataFrame:
    """(query_id, subject_id, kind, match_sum) from segments with query_len, hsp and coordinates.

    A pair with one segment, as most have, is judged by column expressions; the others, which the aligner
    limits to few segments, by the greedy chain.
    """
    number = F.count("*").over(W.partitionBy("query_id", "subject_id"))
    counted = items.withColumn("_n", number)
    single = counted.where("_n = 1").select("query_id", "subject_id", single_kind(F.col("query_len"), F.col("match_len"), F.col("total_len")).alias("kind"), F.col("match_len").cast("long").alias("match_sum"))
    return single.unionByName(_classify_chains(counted.where("_n > 1").drop("_n")))


def _subject_len(segs: list[dict]) -> int | None:
    n = segs[0].get("subject_len")
    return None if n is None else int(n)


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch; columns of whole numbers without nulls become lists at once."""
    plain = lambda c: pa.types.is_integer(c.type) and not c.null_count
    columns = [c.to_numpy().tolist() if plain(c) else c.to_pylist() for c in batch.columns]
    names = batch.schema.names
    return (dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in rows], f.type) for f in schema], schema=schema)


def _by_group(df: DataFrame, keys: list[str], order: list[str], each: Callable[[list[dict]], list[dict]], schema: str | T.StructType) -> DataFrame:
    """The rows that ``each`` makes of every group's rows, which it gets in ``order``.

    Groups stream by in a sorted partition, so that many small ones share a batch; a task holds one group at a time and as many rows as a batch has.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in _dicts(batch))
        made: list[dict] = []
        for _, group in groupby(rows, key=itemgetter(*keys)):
            made += each(list(group))
            if len(made) >= 10_000:
                yield _batch(made, arrow)
                made = []
        if made:
            yield _batch(made, arrow)

    # by a hash: a repartition by the keys themselves is left out where a union of joins has them already, and adaptive joins then spread a group over tasks
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _classify_chains(items: DataFrame) -> DataFrame:

    def one(segs: list[dict]) -> list[dict]:
        first = segs[0]
        return [{"query_id": first["query_id"], "subject_id": first["subject_id"], "kind": match_kind(int(first["query_len"]), segs, _subject_len(segs)), "match_sum": sum(s["match_len"] for s in segs)}]

    return _by_group(items, ["query_id", "subject_id"], ["hsp"], one, "query_id long, subject_id long, kind int, match_sum long")


def chained(items: DataFrame) -> DataFrame:
    """``items`` that stand for their query on their subject, with ``ord``, their place along the query from 1.

    With a column subject_len subjects are circular. A pair's segments, as many as the aligner reports, are chained in one call, in n log n steps.
    """

    def one(segs: list[dict]) -> list[dict]:
        return [s | {"ord": i} for i, s in enumerate(kept_segments(int(segs[0]["query_len"]), segs, _subject_len(segs)), 1)]

    return _by_group(items, ["query_id", "subject_id"], ["hsp"], one, T.StructType([*items.schema.fields, T.StructField("ord", T.LongType())]))


def judged_chains(items: DataFrame) -> DataFrame:
    """``chained`` items with the ``kind`` and ``match_sum`` of their pair (see ``classify_pairs``) in each row: both from one chain. Each pair has a row with ``ord`` 1."""

    def one(segs: list[dict]) -> list[dict]:
        size, subject = int(segs[0]["query_len"]), _subject_len(segs)
        chain = kept_segments(size, segs, subject)
        pair = {"kind": match_kind(size, segs, subject, chain), "match_sum": sum(s["match_len"] for s in segs)}
        return [s | pair | {"ord": i} for i, s in enumerate(chain, 1)]

    added = [T.StructField("ord", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("match_sum", T.LongType())]
    return _by_group(items, ["query_id", "subject_id"], ["hsp"], one, T.StructType([*items.schema.fields, *added]))


def best_subject(pairs: DataFrame, query: str, subject: str, kind: str, weight: str) -> DataFrame:
    """One subject for each query: best kind, then the larger weight, then the smaller subject."""
    best = F.min_by(F.struct(F.col(subject), F.col(kind), F.col(weight)), F.struct(F.col(kind), -F.col(weight), F.col(subject)))
    return pairs.groupBy(query).agg(best.alias("b")).select(query, "b.*")


def other_subjects(segments: DataFrame, best: DataFrame, query: str, subject: str) -> DataFrame:
    """Segments of all but the best subject."""
    return segments.join(best.select(query, subject), [query, subject], "left_anti")


def _fits(s: dict, lo: int, hi: int) -> bool:
    """Whether a segment may cover the hole [lo, hi] of a query: it lies in it up to END_VARIATION, or has 50 bases in it and crosses one end."""
    inside = s["q_start"] >= lo - END_VARIATION and s["q_end"] <= hi + END_VARIATION
    return inside or s["q_start"] < lo - END_VARIATION and s["q_end"] >= lo + 50 or s["q_start"] <= hi - 50 and s["q_end"] > hi + END_VARIATION


def _cover(pool: list[dict], used: set[int], lo: int, hi: int) -> list[dict]:
    """Unused segments of a pool, longest match first, that cover a hole, in order; they are used then.

    The first that fits begins. If it does not reach the hole's begin, it is continued to the right and then to the left, until the hole's end is near, by a
    segment within END_VARIATION on the query: first on the same subject and strand near there too, then on the same subject and strand, then anywhere; at last by
    the nearest one that leads on.
    """
    free = [i for i, s in enumerate(pool) if i not in used and _fits(s, lo, hi)]
    if not free:
        return []
    chain = deque([free.pop(0)])

    def rank(i: int, edge: dict, right: bool) -> tuple | None:
        s = pool[i]
        if s["total_len"] <= MIN_SEGMENT_LEN:
            return None
        a, b = (edge, s) if right else (s, edge)
        dq = abs(b["q_start"] - a["q_end"])
        alike = s["subject_id"] == edge["subject_id"] and s["strand"] == edge["strand"]
        ds = abs(_apart(a, b, edge["strand"], _subject_len([s]))) if alike else 0
        if dq <= END_VARIATION:
            close = alike and ds <= END_VARIATION and s["total_len"] > (hi - lo + 1) * (1 - IDENTITY)
            return (0, dq, ds, i) if close else (1 if alike else 2, 0, 0, i)
        leads = s["q_end"] > edge["q_end"] if right else s["q_start"] < edge["q_start"]
        return (3, dq, 0, i) if leads else None

    begin = pool[chain[0]]
    if not (begin["q_start"] <= lo + END_VARIATION and begin["q_end"] >= lo - END_VARIATION):
        for right in (True, False):
            while True:
                edge = pool[chain[-1] if right else chain[0]]
                if edge["q_end"] >= hi - 50 if right else edge["q_start"] < lo + 50:
                    break
                ranks = [r for i in free if (r := rank(i, edge, right)) is not None]
                if not ranks:
                    break
                free.remove(found := min(ranks)[-1])
                (chain.append if right else chain.appendleft)(found)
    used.update(chain)
    return [pool[i] for i in chain]


def fill_holes(best: DataFrame, pool: DataFrame) -> DataFrame:
    """Segments of each query on its best subject (with ``ord``) and, in its holes, those of other subjects, numbered anew as ``ord``.

    Both have query_id, subject_id, query_len, hsp, q_start, q_end, s_start, s_end, strand, match_len and total_len, and may have subject_len, which makes subjects circular. Holes are a head or tail of more than END_IGNORE bases
    and gaps of more than END_VARIATION. Each segment of the pool is used once, the holes from left to right. Only segments that fit into some hole reach a query's
    group; queries without such are numbered alone.
    """
    columns = [c for c in best.columns if c != "ord"]
    order = W.partitionBy("query_id").orderBy("ord")
    c = F.col
    ends = best.select("query_id", "query_len", "q_start", "q_end", "ord", F.lead("q_start").over(order).alias("next"), F.lag("q_end").over(order).alias("before"))
    long = lambda x: x.cast("long")
    head = ends.where(c("before").isNull() & (c("q_start") > END_IGNORE)).select("query_id", F.lit(0).cast("long").alias("after"), long(F.lit(1)).alias("lo"), long(c("q_start") - 1).alias("hi"))
    tail = ends.where(c("next").isNull() & (c("q_end") < c("query_len") - END_IGNORE)).select("query_id", long(c("ord")).alias("after"), long(c("q_end") + 1).alias("lo"), long(c("query_len")).alias("hi"))
    gap = ends.where(c("next") - c("q_end") > END_VARIATION).select("query_id", long(c("ord")).alias("after"), long(c("q_end") + 1).alias("lo"), long(c("next") - 1).alias("hi"))
    holes = head.unionByName(tail).unionByName(gap)
    found = (c("p.query_id") == c("h.query_id")) & (c("p.q_end") >= c("h.lo") - END_VARIATION) & (c("p.q_start") <= c("h.hi") + END_VARIATION)
    near = pool.select(*columns).alias("p").join(holes.alias("h"), found, "left_semi")

    def one(rows: list[dict]) -> list[dict]:
        pool = [*{tuple(r.values()): r for r in rows if r["after"] is None}.values()]  # repeated rows are one
        pool.sort(key=lambda r: (-r["match_len"], r["subject_id"], r["hsp"], r["q_start"], r["s_start"]))
        used: set[int] = set()
        holes = sorted((r for r in rows if r["after"] is not None), key=lambda r: r["lo"])
        return [s | {"after": hole["after"], "sub": k} for hole in holes for k, s in enumerate(_cover(pool, used, hole["lo"], hole["hi"]), 1)]

    both = near.unionByName(holes, allowMissingColumns=True)
    schema = T.StructType([*best.select(*columns).schema.fields, T.StructField("after", T.LongType()), T.StructField("sub", T.LongType())])
    filled = _by_group(both, ["query_id"], [], one, schema)
    every = best.select(*columns, long(c("ord")).alias("after"), F.lit(0).cast("long").alias("sub")).unionByName(filled)
    return every.select(*columns, F.row_number().over(W.partitionBy("query_id").orderBy("after", "sub")).cast("long").alias("ord"))


def disjunct_flags(segments: DataFrame, key: str, order: tuple[str, ...], pos: str, far: float) -> DataFrame:
    """(key, disjunct): whether neighbours in order lie farther than ``far`` apart."""
    w = W.partitionBy(key).orderBy(*order)
    step = segments.select(key, F.abs(F.col(pos) - F.lag(pos).over(w)).alias("_d"))
    return step.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("_d") > far, 1).otherwise(0)), F.lit(0)).alias("disjunct"))


def nearest_before(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_row: str) -> DataFrame:
    """As-of join: each left row with the last right row of its key at or before it, in one pass over a union."""
    both = left.select(key, F.col(left_at).alias("at"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema[right_row].dataType).alias("r"), F.lit(None).cast(right.schema[right_at].dataType).alias("r_at"), F.lit(1).alias("side"))
    both = both.unionByName(right.select(key, F.col(right_at).alias("at"), F.lit(None).alias("l"), F.col(right_row).alias("r"), F.col(right_at).alias("r_at"), F.lit(0).alias("side")))
    w = W.partitionBy(key).orderBy("at", "side", "r").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = both.withColumns({"near": F.last("r", True).over(w), "near_at": F.last("r_at", True).over(w)})
    return seen.where("side = 1").select("l.*", "near", "near_at")

"""Pairwise overlap alignment, gap normalisation and the scan for indels inside segments, as Arrow functions.

The dynamic programme goes row by row in numpy; each pair of sequences is a small helper's work, Spark deals the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontig.functions.sequences import reverse_complement
from kontig.params import ANCHOR, GAP, INDEL_SIZE, MATCH, MISMATCH

#: Windows of the inner scan: their size, the step, how far they widen, and how far an anchor is sought.
WINDOW, STEP, WIDEST, ANCHOR_REACH = 300, 200, 2_000, 4_000
_UNKNOWN = frozenset("-Nn.")


class Aligned(NamedTuple):
    """Two aligned rows, their score and mismatches (gaps count), and the bases of either sequence left over at both ends."""

    row1: str
    row2: str
    score: int
    mismatches: int
    left1: int
    left2: int
    right1: int
    right2: int


def align(a: str, b: str) -> Aligned:
    """Best overlap of two sequences with free end gaps.

    Ties prefer the end in the last row, then a step on both, then one on ``a``.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return Aligned("", "", 0, 0, 0, 0, n, m)
    if a == b:
        return Aligned(a, b, MATCH * n, 0, 0, 0, 0, 0)
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    slope = GAP * np.arange(m + 1, dtype=np.int32)
    score = np.zeros((n + 1, m + 1), np.int32)  # without the slope, so that steps along a row cost nothing
    score[0] = -slope
    step = {c: np.where(y == ord(c), MATCH - GAP, MISMATCH - GAP).astype(np.int32) for c in set(a)}
    down = np.empty(m, np.int32)
    for i in range(1, n + 1):
        last, row = score[i - 1], score[i]
        np.add(last[1:], GAP, out=down)
        np.add(last[:-1], step[a[i - 1]], out=row[1:])
        np.maximum(row[1:], down, out=row[1:])
        np.maximum.accumulate(row, out=row)
    score += slope
    i, j = n, int(np.argmax(score[n]))
    column = int(np.argmax(score[:, m]))
    if score[column, m] > score[n, j]:
        i, j = column, m
    top, right = int(score[i, j]), (n - i, m - j)
    rows: list[tuple[str, str]] = []
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            rows.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            rows.append((a[i - 1], "-"))
            i -= 1
        else:
            rows.append(("-", b[j - 1]))
            j -= 1
    rows.reverse()
    return Aligned("".join(r[0] for r in rows), "".join(r[1] for r in rows), top, sum(p != q for p, q in rows), i, j, *right)


def overlap(a: str, b: str) -> tuple[str, str, int, int]:
    """The aligned rows of ``align``, their score and mismatches."""
    return align(a, b)[:4]


def count_gaps(row1: str, row2: str) -> tuple[int, int, int]:
    """Gaps (N and dots too) of the first row, of the second where the first has none, and differing columns."""
    differ = [(p, q) for p, q in zip(row1, row2, strict=True) if p != q]
    first = sum(p in _UNKNOWN for p, _ in differ)
    return first, sum(p not in _UNKNOWN and q in _UNKNOWN for p, q in differ), len(differ)


def _slide(rows: list[list[str]], order: range, counts: tuple[int, int, int], barrier: int) -> None:
    """Move the first run of gaps that ``order`` meets onwards over equal bases, up to the column ``barrier``.

    A run that holds all gaps of its row and all differences has nothing to move towards.
    """
    moving = False
    for i in order:
        row = next((r for r in (0, 1) if rows[r][i] == "-"), None)
        if row is None:
            if moving:
                return
            continue
        own, other = rows[row], rows[1 - row]
        j = i
        while j in order and own[j] == "-":
            j += order.step
        alone = abs(j - i) >= max(counts[row], counts[2])
        if alone or j not in order or (barrier - j) * order.step <= 0 or not own[j] == other[j] == other[i]:
            return
        own[i], own[j], moving = own[j], "-", True


def settle_gaps(row1: str, row2: str) -> tuple[str, str]:
    """The rows with scattered gaps gathered: the leftmost run moves right over equal bases, and the rightmost one, if it is another, left.

    Score and sequences stay, and settling again changes nothing. Rows whose only difference is one run stay.
    """
    counts, columns = count_gaps(row1, row2), range(len(row1))
    done = None
    while (row1, row2) != done and "-" in row1 + row2:
        done, rows = (row1, row2), [list(row1), list(row2)]
        _slide(rows, columns, counts, len(row1))
        first = min(r.index("-") for r in rows if "-" in r)
        run = next(r for r in rows if r[first] == "-")
        end = next((i for i in range(first, len(run)) if run[i] != "-"), len(run)) - 1
        _slide(rows, columns[::-1], counts, end)
        row1, row2 = "".join(rows[0]), "".join(rows[1])
    return row1, row2


def anchored(row1: str, row2: str) -> tuple[bool, bool]:
    """Whether the rows begin and end with ANCHOR equal columns."""
    equal = np.frombuffer(row1.encode("utf-32-le"), np.uint32) == np.frombuffer(row2.encode("utf-32-le"), np.uint32)
    return len(equal) >= ANCHOR and bool(equal[:ANCHOR].all()), len(equal) >= ANCHOR and bool(equal[-ANCHOR:].all())


def find_anchor(query: str, subject: str, a: int, b: int) -> tuple[int, int] | None:
    """Behind the first window from (a, b) on that is equal, or whose alignment ends with an anchor; windows grow by STEP.

    None if the sequences end before, or within ANCHOR_REACH there is none.
    """
    for size in range(STEP, ANCHOR_REACH + 1, STEP):
        if size > STEP and size > len(query) - a:
            return None
        q, s = query[a : a + size], subject[b : b + size]
        if q == s:
            return a + len(q), b + len(s)
        found = align(q, s)
        if anchored(found.row1, found.row2)[1]:
            return a + len(q) - found.right1, b + len(s) - found.right2
    return None


class Indel(NamedTuple):
    """Places, from 0 within the two sequences, of the bases around an indel, and the bases that only one of them has."""

    q_left: int
    q_right: int
    s_left: int
    s_right: int
    q_more: int
    s_more: int


def _indel(found: Aligned, a: int, b: int, q: str, s: str) -> Indel | None:
    """The indel of a settled window that begins at (a, b), if it is long enough."""
    in_q, in_s, _ = count_gaps(found.row1, found.row2)
    if abs(in_q - in_s) < INDEL_SIZE:
        return None
    at = [i for i, (x, y) in enumerate(zip(found.row1, found.row2, strict=True)) if x in _UNKNOWN or y in _UNKNOWN]
    behind = len(found.row1) - 1 - at[-1]
    return Indel(
        a + found.left1 + at[0] - 1, a + len(q) - found.right1 - behind,
        b + found.left2 + at[0] - 1, b + len(s) - found.right2 - behind, in_s, in_q,
    )


def scan_indels(query: str, subject: str) -> Iterator[Indel]:
    """Indels inside two sequences that align end to end, in windows of both between anchors.

    A window that does not begin with an anchor goes back a step and widens, one that does not end with one widens; where the begin
    cannot be anchored, the scan starts anew behind what it has seen. Equal windows are passed without an alignment.
    """
    begin = find_anchor(query, subject, 0, 0)
    q_end, s_end = len(query) - STEP, len(subject) - STEP
    if begin is None:
        return
    (a, b), more, seen = begin, 0, begin
    while a < q_end:
        size, room = WINDOW + more, (q_end - a, s_end - b)
        if min(room) <= 0 or size > min(room) + WINDOW:
            return
        q, s = query[a : a + min(size, room[0])], subject[b : b + min(size, room[1])]
        if q == s:
            a, b = a + len(q), b + len(s)
        else:
            raw = align(q, s)
            found = raw._replace(**dict(zip(("row1", "row2"), settle_gaps(raw.row1, raw.row2), strict=True)))
            head, tail = anchored(found.row1, found.row2)
            head = head and not found.left1 and not found.left2
            back, again, wider = False, False, False
            if not head:
                back = a >= begin[0] and a >= STEP and b >= STEP
                again = seen[0] - (a - STEP * back) >= 3 * WINDOW
            if not tail and more + STEP * back <= WIDEST:
                wider = True
            if again:
                start = find_anchor(query, subject, *seen)
                if start is None:
                    return
                begin, (a, b), more, seen = start, start, 0, start
                continue
            if back or wider:
                a, b, more = a - STEP * back, b - STEP * back, more + STEP * back + STEP * wider
                continue
            if head and tail:
                indel = _indel(found, a, b, q, s)
                if indel is not None:
                    yield indel
                more = 0
            if len(q) == found.right1 or len(s) == found.right2:
                return
            a, b = a + len(q) - found.right1, b + len(s) - found.right2
        if a > seen[0]:
            seen = (a, max(b, seen[1]))


# margins of a misjoin

#: Columns of a window, and the mismatches above which it is dense; bases that are aligned at once, and those taken along beside an overlap.
DENSITY_WINDOW, DENSE, CHUNK, BESIDE = 100, 10, 1_000, 300


def align_chunks(a: str, b: str) -> tuple[str, str]:
    """Aligned rows of two long sequences that belong together from their begins on, CHUNK by CHUNK; bases between chunks stand against gaps."""
    rows, i, j = [[], []], 0, 0
    while i < len(a) and j < len(b):
        found = align(a[i : i + CHUNK], b[j : j + CHUNK])
        q, s = len(a[i : i + CHUNK]) - found.right1, len(b[j : j + CHUNK]) - found.right2
        if not found.row1 or not q or not s:
            break
        rows[0] += [a[i : i + found.left1], "-" * found.left2, found.row1]
        rows[1] += ["-" * found.left1, b[j : j + found.left2], found.row2]
        i, j = i + q, j + s
    return "".join(rows[0]), "".join(rows[1])


def density_margin(row1: str, row2: str) -> int | None:
    """The last matching column before rows that begin alike stop being alike; None if they do not, or from the begin on.

    They stop in the first window with over DENSE mismatches that another such window follows, or in the shorter last window if it has over a tenth.
    The column sought lies before the first mismatch of that window and the one before.
    """
    differ = np.frombuffer(row1.encode("utf-32-le"), np.uint32) != np.frombuffer(row2.encode("utf-32-le"), np.uint32)
    n, size = len(differ), DENSITY_WINDOW
    dense = np.flatnonzero(differ[: n // size * size].reshape(-1, size).sum(1) > DENSE)
    rest = differ[n // size * size :]
    if len(dense) > 1:
        block = int(dense[0])
        if block == 0:
            return None
    elif len(rest) and rest.sum() * size > DENSE * len(rest):
        block = n // size
    else:
        return None
    begin = (block - 1) * size
    for i in np.flatnonzero(differ[max(0, begin) : begin + 2 * size]) + max(0, begin):
        before = np.flatnonzero(~differ[:i])
        if len(before):
            return int(before[-1])
    return min(n, begin + 2 * size) - 1


def end_margin(query: str, subject: str) -> int | None:
    """How many bases of the query, from its begin, belong to the subject; None for all that the segment has."""
    row1, row2 = align_chunks(query, subject)
    at = density_margin(row1, row2)
    return None if at is None else at + 1 - row1.count("-", 0, at + 1)


def _stretch(seq: str, length: str, lo: Column, hi: Column, turned: Column) -> Column:
    """Bases lo to hi of a circular sequence, as the minus strand reads them where ``turned``."""
    whole, size = F.col(seq), F.col(length)
    inside = F.substr(whole, F.greatest(lo, F.lit(1)).cast("int"), (F.least(hi, size) - F.greatest(lo, F.lit(1)) + 1).cast("int"))
    before = F.when(lo < 1, F.substr(whole, F.greatest(size + lo, F.lit(1)).cast("int"), F.greatest(1 - lo, F.lit(0)).cast("int"))).otherwise("")
    behind = F.when(hi > size, F.substr(whole, F.lit(1), F.greatest(hi - size, F.lit(0)).cast("int"))).otherwise("")
    text = F.upper(F.concat(before, inside, behind))
    return F.when(turned, reverse_complement(text)).otherwise(text)


def refine_margins(points: DataFrame, queries: DataFrame, subjects: DataFrame) -> DataFrame:
    """``points`` with left and right where the two segments beside a misjoin really end.

    Points are neighbouring segments: key, p_q_end, p_s_end, p_strand and p_subject of the first, q_start, s_start, strand and subject of the second. Where they overlap by
    over 100 bases of the query, each is aligned again from the side on which it surely belongs, with BESIDE bases more, and ends where mismatches become dense;
    otherwise the margins are the segments' ends. Subjects are circular.
    """
    c = F.col
    points = points.drop("left", "right")
    deep = c("p_q_end") - c("q_start") > 100
    plain = points.where(~deep).select("*", F.least("p_q_end", "q_start").alias("left"), F.greatest("p_q_end", "q_start").alias("right"))
    seqs = lambda name: subjects.select(c("subject").alias(f"_{name}"), c("seq").alias(f"_{name}_seq"), F.length("seq").cast("long").alias(f"_{name}_len"))
    whole = points.where(deep).join(queries.select("key", c("seq").alias("_seq"), F.length("seq").cast("long").alias("_len")), "key")
    whole = whole.join(seqs("one"), c("p_subject") == c("_one")).join(seqs("two"), c("subject") == c("_two"))
    q_lo, q_hi = F.greatest(F.lit(1).cast("long"), c("q_start") - BESIDE), F.least(c("_len"), c("p_q_end") + BESIDE)
    m1, m2 = c("p_q_end") - q_lo, q_hi - c("q_start")
    minus1, minus2 = c("p_strand") != 0, c("strand") != 0
    cut = whole.withColumns({
        "_lo": q_lo, "_hi": q_hi,
        "_a": F.upper(F.substr("_seq", q_lo.cast("int"), (m1 + 1).cast("int"))), "_b": F.upper(F.substr("_seq", c("q_start").cast("int"), (m2 + 1).cast("int"))),
        "_sa": _stretch("_one_seq", "_one_len", F.when(minus1, c("p_s_end")).otherwise(c("p_s_end") - m1), F.when(minus1, c("p_s_end") + m1).otherwise(c("p_s_end")), minus1),
        "_sb": _stretch("_two_seq", "_two_len", F.when(minus2, c("s_start") - m2).otherwise(c("s_start")), F.when(minus2, c("s_start")).otherwise(c("s_start") + m2), minus2),
    }).drop("_seq", "_len", "_one", "_two", "_one_seq", "_two_seq", "_one_len", "_two_len")

    @F.pandas_udf("long")
    def kept(queries: pd.Series, subjects: pd.Series) -> pd.Series:
        return pd.Series(list(once_each(end_margin, zip(queries, subjects, strict=True))), dtype="Int64")

    ends = _spread(cut, "_a", "_sa", "_b", "_sb").withColumns({"_right": c("_lo") + kept("_a", "_sa") - 1, "_left": c("_hi") - kept(F.reverse("_b"), F.reverse("_sb")) + 1})
    right, left = F.coalesce("_right", "p_q_end"), F.coalesce("_left", "q_start")
    return plain.unionByName(ends.select(*points.columns, F.least(left, right).alias("left"), F.greatest(left, right).alias("right")))


def _spread(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` dealt by ``texts`` to more partitions than there are cores, since a row costs far more than its bytes tell; rows with equal texts follow each other."""
    spark = df.sparkSession
    number = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn("_h", F.xxhash64(*texts)).repartition(number, "_h").sortWithinPartitions("_h", *texts).drop("_h")


def once_each(each: Callable[..., Any], rows: Iterable[tuple]) -> Iterator[Any]:
    """What ``each`` makes of every row; rows that equal the one before get its result."""
    last = made = None
    for row in rows:
        if row != last:
            last, made = row, each(*row)
        yield made


def inner_indels(segments: DataFrame, queries: DataFrame, subjects: DataFrame, gaps: str = "gap_num") -> DataFrame:
    """(key, shape, kind, left, right, dq, ds, subject, s_left, s_right) of indels inside segments with INDEL_SIZE or more gaps.

    ``segments`` have key, subject, strand, q_start, q_end, s_start and s_end (s_start > s_end on the minus strand, 1); ``queries`` key and seq, ``subjects`` subject and
    seq. A segment's two stretches of sequence are cut out before they reach Python; a segment is one row there. Equal stretches hold no indel, and
    segments with the same two stretches are scanned once in a batch.
    """
    kept = segments.where(F.col(gaps) >= INDEL_SIZE).select("key", "subject", "strand", *[F.col(c).cast("long").alias(c) for c in ("q_start", "q_end", "s_start", "s_end")])
    cut = lambda seq, lo, hi: F.substr(F.upper(F.col(seq)), lo.cast("int"), (hi - lo + 1).cast("int"))
    q = kept.join(queries.select("key", F.col("seq").alias("_q")), "key").withColumn("_q", cut("_q", F.col("q_start"), F.col("q_end")))
    low = F.least("s_start", "s_end")
    both = q.join(subjects.select("subject", F.col("seq").alias("_s")), "subject").withColumn("_s", cut("_s", low, F.greatest("s_start", "s_end")))
    both = both.withColumn("_s", F.when(F.col("strand") == 0, F.col("_s")).otherwise(reverse_complement(F.col("_s"))))
    parts = [f"{n} long" for n in Indel._fields]

    def run(batches):
        for batch in batches:
            found = list(once_each(lambda q, s: [tuple(x) for x in scan_indels(q, s)], zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            rows = [i for i, each in enumerate(found) for _ in each]
            flat = np.array([x for each in found for x in each], np.int64).reshape(-1, len(parts)).T
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns[2:]), *map(pa.array, flat)], [*batch.schema.names[2:], *Indel._fields])

    named = _spread(both.where("_q != _s").select("_q", "_s", "key", "subject", "strand", "q_start", "s_start"), "_q", "_s")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[2:])
    each = named.mapInArrow(run, f"{kinds}, {', '.join(parts)}")
    c = F.col
    side = lambda x: F.when(c("strand") == 0, c("s_start") + c(x)).otherwise(c("s_start") - c(x))
    kind = F.when(c("q_more") > c("s_more"), "insertion").otherwise("deletion")
    placed = each.withColumns({"left": c("q_start") + c("q_left"), "right": c("q_start") + c("q_right"), "s1": side("s_left"), "s2": side("s_right")})
    return placed.select("key", F.lit("inner").alias("shape"), kind.alias("kind"), "left", "right", c("q_more").alias("dq"), c("s_more").alias("ds"), "subject", F.least("s1", "s2").alias("s_left"), F.greatest("s1", "s2").alias("s_right"))


def overlap_alignment(a: Column, b: Column) -> Column:
    """struct<row1, row2, score, mismatches>. Equal pairs should be told apart before, by a plain test."""

    @F.pandas_udf("row1 string, row2 string, score long, mismatches long")
    def overlaps(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([overlap(x or "", y or "") for x, y in zip(p, q, strict=True)], columns=["row1", "row2", "score", "mismatches"])

    return overlaps(a, b)


def gap_counts(row1: Column, row2: Column) -> Column:
    """struct<gaps1, gaps2, mismatches> of two aligned rows; N and dots count as gaps."""
    pairs = F.zip_with(F.split(row1, ""), F.split(row2, ""), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    differ = F.filter(pairs, lambda x: x["p"] != x["q"])
    gap = lambda c: c.isin("-", "N", "n", ".")
    return F.struct(F.size(F.filter(differ, lambda x: gap(x["p"]))).alias("gaps1"), F.size(F.filter(differ, lambda x: ~gap(x["p"]) & gap(x["q"]))).alias("gaps2"), F.size(differ).alias("mismatches"))

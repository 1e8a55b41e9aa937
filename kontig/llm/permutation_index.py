"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of vectors. A vector is represented by the ordered list of its nearest
pivots and posted in the inverted files of the first, with that list. A query visits the files of its own
nearest pivots, ranks what it finds by the footrule distance of the two lists (a missing pivot ranks
last), and the best of each file are reranked by Euclidean distance on the original vectors, in double precision.

Every vector is posted. Equal vectors are one entry with its smallest ids: as many as a query can
return and one more, so a vector that fills a third of the table is one posting and loses no answer.
Files are cut into blocks of bounded size; the queries of a file meet each block in its own task.

Edge cases: null or zero vectors and those with null or non-finite components take no part, nor do
vectors of another length than the most common one, or null ids; ties go to the smaller id; repeated
rows of one id count once; with fewer candidates than asked for all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontig.llm.common import small, written

#: Pivots (at most 256), vectors for each pivot at least, length of a list of pivots.
PIVOTS, PER_PIVOT, LIST = 256, 32, 128
#: Files a vector is posted in, files a query visits, vectors in a block of a file, kept of each by footrule.
POSTED, VISITED, BLOCK, KEPT = 8, 24, 8_192, 150


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>) of the vectors that take part; of an id that repeats, the least vector, component by component."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.size(v) > 0
    ok &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok &= F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))
    common = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    return rows.where(F.size("vec") == (common[0] if common else 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _nearest_pivots(pivots: np.ndarray, length: int):
    norms = (pivots**2).sum(1)

    @F.pandas_udf("binary")
    def lists(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()) if len(vec) else np.zeros((0, pivots.shape[1]))
        order = np.argsort(norms - 2 * (x @ pivots.T), 1, kind="stable")[:, :length]
        return pd.Series([row.tobytes() for row in order.astype(np.uint8)])

    return lists


def _ranks(column: pd.Series, pivots: int, length: int) -> np.ndarray:
    """Rank of every pivot in each list; ``length`` where it is missing."""
    lists = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), length).astype(np.int64)
    out = np.full((len(lists), pivots), length, np.int16)
    np.put_along_axis(out, lists, np.broadcast_to(np.arange(lists.shape[1], dtype=np.int16), lists.shape), 1)
    return out


def search(df: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row that ``queries`` (a condition on
    the column id) selects, among all other rows."""
    rows = written(usable(df, id_col, vec_col), "vectors")
    # equal vectors: one entry with its smallest ids
    ids = F.slice(F.sort_array(F.collect_set("id")), 1, k + 1)
    salted = rows.groupBy("vec", F.pmod("id", F.lit(64)).alias("salt")).agg(ids.alias("ids"))
    entries = salted.groupBy("vec").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = entries.select(F.element_at("ids", 1).alias("entry"), "vec", "ids")
    entries = written(entries, "entries")
    n_pivots = max(1, min(PIVOTS, entries.count() // PER_PIVOT))
    sample = [r[0] for r in entries.orderBy(F.xxhash64("entry"), "entry").select("vec").limit(n_pivots).collect()]
    if not sample:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))  # none
    pivots = np.array(sample, float)
    length = min(LIST, n_pivots)
    lists = _nearest_pivots(pivots, length)
    entries = written(entries.withColumn("list", lists(F.col("vec"))), "listed")
    asked = written(rows.where(queries).select(F.col("id").alias("query_id"), "vec", lists(F.col("vec")).alias("list")), "queries")

    def first(n: int):
        """The first pivots of a list, one row each."""
        byte = lambda i: F.conv(F.hex(F.substring("list", i, 1)), 16, 10).cast("int")
        return F.explode(F.array(*[byte(i + 1) for i in range(min(n, length))]))

    sizes = entries.select(first(POSTED).alias("pivot")).groupBy("pivot").count()
    blocks = sizes.select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))  # at most PIVOTS rows
    posted = entries.select("entry", "list", first(POSTED).alias("pivot")).join(F.broadcast(blocks), "pivot")
    posted = posted.withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    routed = asked.select("query_id", "list", first(VISITED).alias("pivot")).join(F.broadcast(blocks), "pivot")
    routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def visit(found: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if found.empty or asking.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "entry": pd.Series(dtype="int64"), "footrule": pd.Series(dtype="int64")})
        theirs, mine = (_ranks(x["list"], n_pivots, length) for x in (found, asking))
        entry, query, out = found["entry"].to_numpy(), asking["query_id"].to_numpy(), []
        for i in range(len(query)):  # a query against the block, all entries at once
            distance = np.abs(theirs - mine[i]).sum(1, dtype=np.int64)
            best = np.lexsort((entry, distance))[:KEPT]
            out.append(pd.DataFrame({"query_id": query[i], "entry": entry[best], "footrule": distance[best]}))
        return pd.concat(out)

    met = posted.select("pivot", "block", "entry", "list").groupBy("pivot", "block").cogroup(routed.select("pivot", "block", "query_id", "list").groupBy("pivot", "block"))
    found = met.applyInPandas(visit, "query_id long, entry long, footrule long")
    candidates = found.select("query_id", "entry").distinct()
    n_asked = asked.count()
    near = candidates.join(entries.select("entry", F.col("vec").alias("theirs"), "ids"), "entry").join(small(asked.select("query_id", "vec"), n_asked, 20_000), "query_id")
    squares = F.aggregate(F.zip_with("vec", "theirs", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = near.select("query_id", F.sqrt(squares).alias("score"), F.explode("ids").alias("id")).where("id != query_id")
    top = scored.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("t.id").alias("id"), F.col("t.score").alias("score"))

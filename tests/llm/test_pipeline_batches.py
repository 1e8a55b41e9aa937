"""What a Python worker of the pipeline holds at once."""

import sys

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from kontig.llm import byte_bpe

SF, ROWS = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(("own", "most"), [("10000", 40), ("30", 30), ("0", 40)])
def test_whole_texts_come_in_small_batches(spark, monkeypatch, own, most):
    """A user's smaller batches stay; larger or unbounded ones become BATCH_ROWS; no row is lost."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    monkeypatch.setattr(corpus_pipeline, "BATCH_ROWS", 40)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))])
    spark.conf.set(ROWS, own)
    try:
        found = [r.n for r in corpus_pipeline.run(spark, SF).collect()]
    finally:
        spark.conf.unset(ROWS)
    assert max(found) == most and sum(found) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_remembered_ids_are_bytes():
    """A remembered pre-token holds four bytes an id, not an object: workers of three cores share an executor with its JVM."""
    codec = byte_bpe.SegmentTreeBpe(byte_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")), public_tokenizers.PATTERN)
    texts = ["xqzvkw jjkqxw " * 40, "word", "z" * 700, *[f"qx{i}zk" for i in range(200)]]
    ids = codec.encode_batch(texts)
    assert [codec.decode(i) for i in ids] == [t.encode() for t in texts]
    assert len(codec.cache) > 200 and all(sys.getsizeof(held) <= sys.getsizeof(b"") + 4 * len(piece.encode()) for piece, held in codec.cache.items())

"""What goes to Python workers at once."""

import numpy as np
import pyarrow as pa
import pytest

from breezeline.llm import _memory, bpe


@pytest.fixture
def arrow_bytes(spark):
    """Spark's default, which other tests may have lowered, and what was set before after the test."""
    before = spark.conf.get(_memory.ARROW_BYTES)
    spark.conf.unset(_memory.ARROW_BYTES)
    yield
    spark.conf.set(_memory.ARROW_BYTES, before)


def largest_batch(df):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return df.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]


@pytest.mark.parametrize("stage", ["toxicity", "near_copies", "bpe"])
def test_stages_send_small_batches(spark, arrow_bytes, stage, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.range(20).selectExpr("id AS doc_id", "concat('some text of ', id) AS text", "'s' AS source", "20L AS n_chars")
    docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    large = spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('ab cd ', 2000) AS text")
    assert 0 < largest_batch(large) < 1.5 * _memory.BATCH_BYTES


@pytest.mark.parametrize("value", ["4096k", "3m", "1000", "2048"])
def test_a_lower_setting_is_kept(spark, arrow_bytes, value):
    spark.conf.set(_memory.ARROW_BYTES, value)
    _memory.small_batches(spark)
    assert spark.conf.get(_memory.ARROW_BYTES) == value


@pytest.mark.parametrize("value", ["1g", "5mb", "67108864b", "67108864"])
def test_a_higher_setting_is_lowered(spark, arrow_bytes, value):
    spark.conf.set(_memory.ARROW_BYTES, value)
    _memory.small_batches(spark)
    assert spark.conf.get(_memory.ARROW_BYTES) == str(_memory.BATCH_BYTES)


def test_places_of_words_among_others():
    words, among = pa.array([b"c", b"x", b"", b"a"]), pa.array([b"a", b"b", b"c", b""])
    assert bpe._found(words, among).tolist() == [2, -1, 3, 0]
    none = pa.array([], pa.binary())
    assert bpe._found(words, none).tolist() == [-1] * 4
    assert bpe._found(none, among).tolist() == []
    assert bpe._found(none, among).dtype == np.int32

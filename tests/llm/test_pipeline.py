"""The pipeline: what each stage decides takes effect, and the run equals its stages applied one by one."""

from __future__ import annotations

import collections

import corpus_pipeline
import public_tokenizers
from pyspark.sql import SparkSession
from tests.conftest import SF

from gleanworks.llm import jaccard, langid, packing, quality


def test_stages(spark: SparkSession) -> None:
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "mix_sources", "best_fit_packing"]
    good = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    kept = {r["doc_id"] for r in quality.judged(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == docs.columns
    sure = corpus_pipeline.language_id(spark, good, SF).cache()
    want = {r["doc_id"] for r in langid.identified(good).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}").collect()}
    assert {r["doc_id"] for r in sure.collect()} == want and sure.columns == docs.columns
    alone = corpus_pipeline.near_duplicates(spark, sure, SF).cache()
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted({r["component_id"] for r in jaccard.linked(sure).collect()})
    mix = corpus_pipeline.mix_sources(spark, alone, SF).cache()
    assert mix.columns == docs.columns and max(collections.Counter(r["doc_id"] for r in mix.collect()).values()) <= 2
    packed = corpus_pipeline.pack(spark, mix, SF)
    lengths = packing.pieces(mix, public_tokenizers.path("word_bpe_49k.json")).agg({"length": "sum"}).first()[0]
    assert packed.agg({"length": "sum"}).first()[0] == lengths
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_one_document_of_repeated_rows_stays(spark: SparkSession) -> None:
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (None, "a b c d e f", "en", "s", 11), (3, None, None, None, None), (4, "other words are in this text", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == [0, 1, 3, 4]


def test_stages_take_nulls_long_texts_and_empty_tables(spark: SparkSession) -> None:
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long"
    body = " ".join(f"word{i * 7 % 101} of{i % 13}" for i in range(90))
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, body, None, None, 5), (2, body, None, None, 5), (3, body.upper(), "en", "s", None), (None, body[::-1], "de", "s", 1), (4, "\n".join(f"{body} {i}" for i in range(300)), "en", "s", 1), (5, "x" * 300_000, "en", "t", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, "x", 7) for r in data], schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
            assert docs.count() <= 4 * len(data) + 400 and (name == "best_fit_packing" or docs.columns == list(corpus_pipeline.COLUMNS))
        assert (docs.count() > 0) == bool(data)


def test_batches_of_long_texts_are_small(spark: SparkSession) -> None:
    """A batch for a Python worker is bounded in bytes too, not in rows alone: 300 texts of 20,000 characters are several."""
    from gleanworks.llm.common import small_batches

    def sizes(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    small_batches(spark)
    found = spark.range(300, numPartitions=1).selectExpr("repeat(cast(id as string), 8000) as text").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 300 and max(r["bytes"] for r in found) < 2_000_000

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import common, mixing, pipeline, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF), name)
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        assert 0 < docs.count() <= n
        n = docs.count()
    assert n > 60


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_queries_are_all_there():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("names", [["n_words", "kept", "Words", "__m", "size", "copies", "h", "g", "row", "verdict", "text_hash", "cuts", "at"], ["N_Words", "KEPT", "words", "Size", "TAKEN", "target", "Source_Size", "H", "Rank", "own", "gone", "doc"]])
def test_columns_of_the_caller_pass_all_stages_unchanged(spark, names):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF), name)
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or name == "mix_sources")
        rows = docs.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names)
    made = common.fresh_names(spark.createDataFrame([], docs.schema).select(*columns), *mixing.MADE)
    assert docs.columns[len(columns) :] == made and all(r[made[3]] > 0 for r in rows)


def test_awkward_rows_pass_all_stages(spark):
    text = "plain words of an ordinary sentence that nobody would call bad, twelve of them at least"
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, text, "en", "a", 1), (None, text, "en", "a", 1), (3, text + " here", None, None, 2), (4, text, "de", "b", 3), (4, text, "de", "b", 3), (4, text.upper(), "de", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SF), name)
    assert {r["doc_id"] for r in docs.collect()} <= {None, 3, 4}


def test_written_run_leaves_no_tables_behind(spark, tmp_path):
    pipeline.write(spark, SF, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 60
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/settled/{spark.sparkContext.applicationId}")
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)

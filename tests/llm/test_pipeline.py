import importlib

from pyspark.sql import functions as F

import corpus_pipeline
from talus.llm.decontaminate import drop_contaminated

SF = "/root/testdata/sf0.001"


def test_stages_narrow_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == cols, name
        after = docs.count()
        assert after <= before
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_with_odd_rows(spark):
    odd = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (None, "a b c", "en", "s", 5, 1), (3, "word " * 30_000, "en", "s", 150_000, 1), (3, "word " * 30_000, "en", "s", 150_000, 1)],
        "doc_id long, text string, lang string, source string, n_chars long, score int",
    )
    for c in ("cut_spans", "cut_any", "cut_doc_id", "CUT_T", "t", "h", "begin", "item_id"):
        odd = odd.withColumn(c, F.lit(c))
    for docs in (odd, odd.limit(0)):
        kept = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns, name
            rows = docs.collect()
            if not kept:
                assert rows == []
            elif name == "near_duplicates":
                # of equal rows one stays; a null text equals an empty one
                assert sorted((r.doc_id or 0, len(r.text or "")) for r in rows) == [(0, 5), (1, 0), (3, 150_000)]
            elif name in ("substrings", "decontamination"):
                assert sorted((r.doc_id or 0, r.n_chars or 0) for r in rows) == [(0, 5), (1, 0), (3, 150_000)]
            if name == "quality" and kept:
                docs = odd  # whatever the classifier keeps, the other stages see all rows


def test_decontamination_judges_each_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    bad = f"before {item.text.upper()} after"
    rows = [(1, bad), (2, "clean text"), (3, bad), (3, "clean too"), (None, bad), (None, "clean as well"), (2, "clean text"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = drop_contaminated(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in rows if t != bad)


def test_entry_registers_every_operator():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in names if x.startswith("op")}
    assert "pipeline" in names

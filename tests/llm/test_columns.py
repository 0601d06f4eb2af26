"""Documents whose columns are called like the operators' own, and repeated rows."""

from pyspark.sql import functions as F

from pagecensus.llm import jaccard, quality
from pagecensus.llm.common import load

SF_DIR = "/root/testdata/sf0.001"


def test_quality_keeps_columns_of_any_name(spark):
    docs, labels = load(spark, SF_DIR, "documents"), load(spark, SF_DIR, "labels")
    plain = quality.keep_good(docs, labels)
    names = ("_good", "_evidence", "_host_share", "_path_share", "host_share", "path_share", "_host", "_path")
    odd = docs.withColumns({name: F.concat(F.lit(f"{name} of "), "doc_id") for name in names})
    rows = quality.keep_good(odd, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())
    assert all(r[name] == f"{name} of {r.doc_id}" for r in rows for name in names)


def test_one_of_each_keeps_columns_and_one_of_equal_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(9, text, "x"), (9, text, "x"), (12, text + " more", "y"), (20, other, "z"), (None, other, "n"), (None, other, "n"), (21, None, "e"), (21, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string").repartition(3)
    got = sorted(((r.doc_id, r.text, r._gone) for r in jaccard.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(9, text, "x"), (20, other, "z"), (None, other, "n"), (None, other, "n"), (21, None, "e"), (21, "", "e")], key=repr)

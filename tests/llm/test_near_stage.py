"""The near_dedup stage on null ids and on ids that stand on several texts."""

import corpus_pipeline


def test_rows_not_ids_are_dropped(spark):
    base = " ".join(f"word{i} and" for i in range(60))
    other, lone = " ".join(f"other{i} or" for i in range(60)), " ".join(f"lone{i} but" for i in range(60))
    rows = [(1, base), (2, base + " tail"), (2, lone), (None, base + " end"), (None, other), (None, other + " end"), (3, other + " tail"), (4, ""), (None, None)]
    d = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()}
    assert got == {(1, base), (2, lone), (3, other + " tail"), (4, ""), (None, None)}

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"river{i}" for i in range(200)] + ["and", "the", "of"]
    plain = lambda n=80: ". ".join(" ".join(rnd.choice(words) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."
    rows = []
    for i in range(300):
        kind = i % 6
        text = plain()
        if kind == 1:
            text = text.replace(" ", "### ")
        if kind == 2:
            text = "Site header line\n" + text
        if kind == 3 and i > 10:
            text = rows[i - 3][1] + " Extra end."
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 1), 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(1, 300, 12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert now.columns == docs.columns
        seen[name] = now
    assert seen["quality_classifier"].where("doc_id % 6 = 1 AND doc_id < 300").count() == 0
    assert seen["quality_rules"].where("doc_id % 6 = 0").count() >= 45 and seen["quality_rules"].where("doc_id >= 900").count() == 0
    assert seen["line_dedup"].where(F.col("text").contains("Site header")).count() == 0
    assert seen["line_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    left = {r.doc_id for r in seen["near_duplicates"].collect()}
    assert len(left) == seen["near_duplicates"].count() and not any(i in left for i in range(15, 300, 6)) and sum(i in left for i in range(0, 300, 6)) >= 44
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left and packed.count() == seen["packing"].count()


def test_rows_of_null_and_repeated_ids_keep_their_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(1)), (5, text(2)), (5, text(3)), (9, text(4)), (7, text(4)), (None, text(4)), (7, text(4)), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __row string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))
    assert got == sorted([(0, text(0)), (0, text(1)), (5, text(2)), (5, text(3)), (7, text(4)), (0, "")])

import random

import corpus_pipeline
from pyspark.sql import functions as F

from isofield.llm.common import table


def write(spark, path):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(260):
        lines = [" ".join(rng.choice(plain) for _ in range(12)) for _ in range(6)]
        if i % 4 == 1:
            lines.insert(2, "all of this line comes back in many documents again")
        if i % 5 == 0:
            lines[0] += " idiot scum trash"
            lines[1] += " moron idiot loser"
        docs.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000 + k, docs[k][1] + " tail", "en", "s1", 0) for k in (1, 2, 3)] + [(2000, None, "en", None, None), (2001, "", None, "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    write(spark, tmp_path)
    d = str(tmp_path)
    docs, seen = table(spark, d, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == docs.columns
        place = f"{d}/{name}"
        out.write.parquet(place)
        docs = seen[name] = spark.read.parquet(place)
    ids = {n: {r.doc_id for r in df.collect()} for n, df in seen.items()}
    assert not {i for i in ids["toxicity"] if i < 260 and i % 5 == 0} and {i for i in range(260) if i % 5} <= ids["toxicity"]
    repeated = [r.doc_id for r in seen["line_dedup"].collect() if r.text and "comes back in many documents" in r.text]
    assert repeated == [1]
    assert ids["ngram_join"] == ids["line_dedup"]
    assert sum(r["length"] for r in seen["packing"].collect()) > 0
    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(repr, whole.drop("sequence_id", "offset").collect())) == sorted(map(repr, seen["packing"].drop("sequence_id", "offset").collect()))


CLASHING = ["size__", "bucket__", "draw__", "part__", "source__", "target__", "id", "copy", "places", "row", "key", "gone", "n", "score", "score_", "old", "line_id"]


def test_stages_with_clashing_columns_repeated_rows_and_empty_tables(spark, tmp_path):
    write(spark, tmp_path)
    d = str(tmp_path)
    docs = table(spark, d, "documents")
    more = docs.unionByName(docs.where("doc_id < 20")).select("*", *[F.struct(F.col("doc_id").alias("a"), F.lit(c).alias("b")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, more, d)
        plain = stage(spark, docs.unionByName(docs.where("doc_id < 20")), d)
        rows = got.collect()
        assert got.columns == more.columns and rows, name
        assert all(r[c] == (r.doc_id, c) for r in rows for c in CLASHING), name
        assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(map(repr, map(tuple, plain.collect()))), name
        assert stage(spark, docs.limit(0), d).count() == 0, name
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), d).count() == 0

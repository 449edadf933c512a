"""The pipeline over planted documents: what must go goes, what is clean stays."""

import random

import corpus_pipeline
from clauseflow.llm import bpe, decontaminate
from test_line_dedup import brute


def planted():
    rng = random.Random(11)
    words = "river stone candle morning paper window garden market bridge winter letter harbour".split()

    def prose(n):
        out = []
        for i in range(n):
            word = rng.choice(words) + (rng.choice("aeiou") * rng.randrange(3))
            out.append(word.capitalize() + "" if i % 9 == 0 else word + ("." if i % 9 == 8 else ""))
        return " ".join(out)

    good = [prose(120) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["%%%", "$$$", "***", "###"]) for w in prose(120).split()) for _ in range(40)]
    item = prose(30)
    copies = [good[0] + " extra"] * 2 + [good[1]]
    leaks = [prose(60) + " " + item.upper() + " " + prose(60), prose(40) + " " + item[:50] + "x" + item[51:] + " " + prose(40)]
    return good, junk, copies, leaks, item


def test_pipeline_on_planted_documents(spark, tmp_path):
    good, junk, copies, leaks, item = planted()
    texts = good + junk + copies + leaks + [None]
    rows = [(i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(i, 0, 0) for i in range(60, 100)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts_now = dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_classifier":
            assert set(range(60)) <= set(after) and not set(range(60, 100)) & set(after)
        if name == "line_dedup":
            ids = sorted(before)
            assert [after[i] for i in ids] == brute([before[i] for i in ids], 20)
        if name == "benchmark_decontamination":
            assert len(texts) - 3 not in after and len(texts) - 2 not in after
            assert set(range(60)) <= set(after)
        texts_now = after
    done = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(done) == set(texts_now)
    path = bpe.vocabulary_path()
    expected = {r.doc_id: r for r in bpe.digests(bpe.decode(bpe.encode(docs, path), path)).collect()}
    assert done == expected
    assert all(decontaminate.normal(item) not in decontaminate.normal(t) for t in texts_now.values())


def test_pipeline_on_empty_tables(spark, tmp_path):
    sf = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0

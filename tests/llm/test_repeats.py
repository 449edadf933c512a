import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseflow.llm import repeats, substring_dedup, suffix_dedup, warc


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "dél", "eps", "éta"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))

    shared, line = prose(70), prose(20)
    texts = [None, "", " \n\t ", prose(5), prose(200), shared, shared]
    texts += [prose(30) + " " + shared + " " + prose(30) for _ in range(6)]
    texts += [prose(40) + "\n" + line + "\n" + prose(40) for _ in range(9)]
    texts += ["x y " * 120, "x y " * 90 + "z", prose(3) + " " + "ab " * 200, "a" * 3000, "b" + "a" * 2500]
    same = prose(150).split()
    for _ in range(6):  # near copies
        held = list(same)
        held[rng.randrange(len(held))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(held))
    texts.append(texts[4])
    return texts


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        cover = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~cover]) if r else b""
        out.append((len(r), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, window):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in enumerate(split):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, w in enumerate(split):
        cover = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                cover[k : k + window] = [True] * window
        kept = b" ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out.append((len(w), sum(cover), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(params=[None, 2])
def shard_rows(request, monkeypatch):
    """Shards as they are, and so small that triggers count as crowded."""
    if request.param:
        whole = repeats.repeated

        def small(*args, **options):
            return whole(*args, **options | {"rows": request.param})

        monkeypatch.setattr(substring_dedup, "repeated", small)
        monkeypatch.setattr(suffix_dedup, "repeated", small)


@pytest.mark.parametrize("length", [400, 64])
def test_bytes_equal_brute_force(docs, shard_rows, length):
    texts = corpus()
    table = docs(texts)
    found = suffix_dedup.without_spans(table, suffix_dedup.repeated_spans(table, length=length)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts, length)


@pytest.mark.parametrize("window", [50, 12])
def test_words_equal_brute_force(docs, shard_rows, window):
    texts = corpus(6)
    table = docs(texts)
    found = substring_dedup.without_words(table, substring_dedup.earlier_spans(table, window=window)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in found}
    assert [got[i] for i in range(len(texts))] == brute_words(texts, window)


def test_tiles_split_long_texts(docs, monkeypatch):
    monkeypatch.setattr(repeats, "TILE", 300)
    chunks = list(repeats._tiles([b"ab" * 500, b"c" * 40], suffix_dedup.byte_units, 50))
    starts = sorted(base + i for chunk in chunks for row, base, units in chunk if row == 0 for i in range(len(units) - 49))
    assert starts == list(range(1000 - 49))


def test_empty_table_and_null_keys(spark, docs):
    none = docs([])
    assert suffix_dedup.without_spans(none, suffix_dedup.repeated_spans(none)).count() == 0
    assert substring_dedup.without_words(none, substring_dedup.earlier_spans(none)).count() == 0
    long = "word " * 100
    table = spark.createDataFrame([(None, long), (1, long), (1, long)], "doc_id bigint, text string")
    rows = substring_dedup.without_words(table, substring_dedup.earlier_spans(table)).collect()
    assert sorted(r.n_words for r in rows) == [100, 100, 100] and all(r.n_removed == 0 for r in rows)


def test_suffix_ranks_order_suffixes():
    text = np.frombuffer(b"banana bandana", np.uint8)
    ranks = suffix_dedup.suffix_ranks(text, 16)
    order = sorted(range(len(text)), key=lambda i: bytes(text[i:]))
    assert np.argsort(ranks, kind="stable").tolist() == order


def test_automaton_streams_matching_statistics():
    machine = substring_dedup.Automaton()
    machine.add(list("abcabd"), 1)
    machine.add(list("zabd"), 2)
    assert [n for n, _ in machine.stream(list("xabdz"), 9)] == [0, 1, 2, 3, 1]
    assert [least for _, least in machine.stream(list("zabd"), 9)] == [2, 2, 2, 2]
    assert [least for _, least in machine.stream(list("zabd"), 2)] == [2, 2, 1, 1]


@pytest.mark.parametrize("shard_words", [60, 1 << 17])
def test_broadcast_automata_equal_brute_force(docs, shard_words):
    texts = corpus()[:22]
    table = docs(texts)
    spans = substring_dedup.reference_spans(table, table, window=12, shard_words=shard_words)
    rows = substring_dedup.without_words(table, spans).collect()
    got = [(r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == brute_words(texts, 12)


@pytest.fixture
def no_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_dealt_over_tasks(no_adaptive):
    rows = no_adaptive.range(30000).select(F.col("id").alias("key"), F.lit(0).alias("first"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("trigger"))
    counts = rows.groupBy("trigger").agg(F.count("*").alias("met")).where("trigger < 20000")
    wanted = counts.select("trigger", (F.col("trigger") * 2).alias("twice"))
    met = repeats._salted(rows.repartition(4), wanted, ["trigger"], counts=counts)
    expected = rows.where("trigger < 20000").count()
    assert met.count() == expected and met.where("twice <> trigger * 2").count() == 0
    assert met.columns == ["trigger", "key", "first", "twice"]
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < expected * 0.4
    semi = repeats._salted(rows, counts, ["trigger"], "left_semi")
    assert semi.count() == expected and sorted(semi.columns) == ["first", "key", "trigger"]


def test_hot_phrase_and_digest_without_adaptive_execution(no_adaptive, docs):
    shared = " ".join(f"shared{i}" for i in range(60))
    texts = [(shared if i % 3 == 0 else "") + "".join(f" own{i}x{j}" for j in range(30)) for i in range(60)]
    rows = substring_dedup.without_words(docs(texts), substring_dedup.earlier_spans(docs(texts), window=12)).collect()
    got = [(r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == brute_words(texts, 12)
    pages = no_adaptive.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") < 3000, F.concat(F.lit("p"), (F.col("id") / 4).cast("int"))).otherwise(F.concat(F.lit("q"), "id")).alias("html"))
    marks = warc.marked(pages.repartition(4))
    last: dict = {}
    plain = [(r.page_id, r.html) for r in pages.collect()]
    for i, html in plain:
        last[html] = max(i, last.get(html, i))
    assert {r.page_id: r.origin for r in marks.collect()} == {i: None if last[h] == i else last[h] for i, h in plain}
    assert max(r["count"] for r in marks.groupBy(F.spark_partition_id()).count().collect()) < 3000

"""What every operator and stage must stand: clashing columns, keys of any type, and a brute-force
version of the queries that SQL does not express."""

import hashlib
import random
import re
import zlib
from decimal import Decimal

import corpus_pipeline
import numpy as np
import pytest
from clauseflow.llm import bpe, decontaminate, gif, license_scan, line_dedup, near_copies, quality, simhash, substring_dedup, suffix_dedup, warc
from test_operators import brute_best, brute_fingerprint

CLASHES = (
    "key", "no", "line", "n_lines", "n_removed", "removed", "mark", "numbers", "score", "label", "x", "fp", "component", "node", "band", "gone", "media",
    "frames", "error", "samples", "origin", "content", "sha", "size", "last", "again", "kept", "spans", "n_bytes", "n_words", "ids", "decoded", "edits",
    "end", "item", "license", "phrases", "trigger", "times", "salt", "__maybe", "__slot", "a.b", "Quality", "least",
)
LINE = "these are the words of a line that repeats in several documents of the table"
TEXTS = [None, "", f"{LINE}\n{'word ' * 120}", f"{LINE}\nReleased under the MIT License.", f"{LINE}s\n{'word ' * 120}", "short"]


def wide(spark, keys, kind):
    rows = [(k, t, *(["kept"] * len(CLASHES))) for k, t in zip(keys, TEXTS, strict=True)]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, {', '.join(f'`{c}` string' for c in CLASHES)}")


KEYS = {
    "bigint": [1, 2, 3, 4, 5, None], "int": [1, 2, 3, 4, 5, None], "smallint": [1, 2, 3, 4, 5, None], "string": ["a b", "é\n", "c", "d", "e", None],
    "decimal(20,2)": [Decimal(f"{i}.25") for i in range(1, 6)] + [None],
}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("kind", list(KEYS))
def test_operators_with_any_key_and_clashing_columns(spark, kind):
    keys = KEYS[kind]
    docs = wide(spark, keys, kind)
    plain = docs.select("doc_id", "text")
    items = spark.createDataFrame([(keys[0], LINE), (keys[1], "short"), (None, "short")], f"item_id {kind}, text string").withColumnRenamed("item_id", "thing")

    media = gif.decode_gifs(gif.encode_gifs(docs.selectExpr("*", "cast(text as binary) AS payload"), "payload"))
    assert by_id(media)[keys[2]].error is None and by_id(media)[keys[2]]["a.b"] == "kept"
    cut = by_id(line_dedup.without_lines(docs, line_dedup.removed_lines(docs)))
    assert cut[keys[4]].n_removed == 2 and cut[keys[4]].label == "kept" and cut[None].text == "short"
    assert [r.doc_id for r in license_scan.license_places(docs).collect()] == [keys[3]]
    spans = by_id(substring_dedup.without_words(docs, substring_dedup.earlier_spans(docs)))
    assert spans[keys[4]].n_removed == 120 and spans[keys[2]].n_removed == 0
    spans = by_id(suffix_dedup.without_spans(docs, suffix_dedup.repeated_spans(docs)))
    assert spans[keys[4]].n_removed >= 600 and spans[None].n_removed == 0
    assert simhash.near_duplicates(docs).count() == near_copies.near_copies(docs).count() == 6
    path = bpe.vocabulary_path()
    assert [bytes(r.decoded).decode() for r in bpe.round_trip(docs, path).collect()] == [t or "" for t in TEXTS]
    labels = spark.createDataFrame([(keys[0], 1), (keys[2], 0)], f"doc_id {kind}, quality int")
    scored = quality.scored(docs, quality.train(docs, labels)).collect()
    assert all(0 <= r.score <= 1 and r.Quality == "kept" for r in scored)
    found = {(r.doc_id, r.thing) for r in decontaminate.matches(docs, items, item_key="thing").collect()}
    assert found == {(k, keys[0]) for k in keys[2:5]} | {(None, keys[1])}
    assert set(by_id(decontaminate.decontaminated(docs, items, item_key="thing"))) == {*keys[:2], None}
    assert plain.count() == 6


@pytest.mark.parametrize("kind", list(KEYS))
def test_bundles_with_any_key_and_clashing_columns(spark, tmp_path, kind):
    keys = KEYS[kind]
    html = [None, "", "<p>é</p>", "<p>é</p>", "other", "no key"]
    rows = [(k, f"http://x/{i}", h, *(["kept"] * len(CLASHES))) for i, (k, h) in enumerate(zip(keys, html, strict=True))]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string, {', '.join(f'`{c}` string' for c in CLASHES)}")
    origins = by_id(warc.marked(pages), "page_id")
    assert origins[keys[2]].origin == keys[3] and origins[keys[0]].origin == keys[1] and origins[keys[4]].origin is None and origins[keys[4]]["a.b"] == "kept"
    warc.write_bundles(pages, f"file://{tmp_path}/b")
    read = by_id(warc.read_bundles(spark, f"file://{tmp_path}/b"), "key")
    assert set(read) == set(keys[:5]) and read[keys[2]].refers_to == keys[3] and bytes(read[keys[3]].payload) == "<p>é</p>".encode()


def test_stages_with_clashing_columns(spark, tmp_path):
    docs = wide(spark, KEYS["bigint"], "bigint")
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no text has these words at all")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.schema == docs.schema, name
        assert all(r["a.b"] == "kept" for r in after.collect())
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


# --- queries against brute force -----------------------------------------------------------------


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma délta é漢 zeta 12 x|y.".split()) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(21)
    texts = [None, "", " ", "a" * 50_000, "tab\tand\nline"] + [words(rng, rng.randrange(1, 400)) for _ in range(30)]
    texts += [texts[7], "%$ #" * 90]
    sf = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf, dict(enumerate(texts)), {i: q for i, q, _ in labels}


def lzw_codes(stream, bits):
    """Samples of an LZW stream, code by code, by the format's rules."""
    at, width, table, last, out = 0, bits + 1, [], None, bytearray()
    value = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code = value >> at & (1 << width) - 1
        at += width
        if code == 1 << bits:
            table, width, last = [bytes([i]) for i in range(1 << bits)] + [b"", b""], bits + 1, None
            continue
        if code == (1 << bits) + 1:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


def test_op1_equals_brute_force(spark, tables):
    sf, texts, _ = tables
    rows = by_id(gif.op1_gif_media(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "cast(text as binary) AS payload")
    media = {k: bytes(r.media) for k, r in by_id(gif.encode_gifs(docs, "payload")).items()}
    for key, text in texts.items():
        raw = (text or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        r, image = rows[key], media[key]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        at, samples, frames = 13 + 768, b"", 0
        while image[at] != 0x3B:
            at += 8 + 10 + 1
            stream = b""
            while image[at]:
                stream += image[at + 1 : at + 1 + image[at]]
                at += 1 + image[at]
            at += 1
            samples += lzw_codes(stream, 8)
            frames += 1
        assert samples == payload and r.feature.startswith(f"frames={frames};ms={40 * frames};")
    assert rows[7].feature == rows[35].feature


def test_hostile_images_are_errors():
    for data in (b"GIF89a\xff\xff\xff\xff\0\0\0\x3b", b"GIF89a\1\0\1\0\0\0\0\x2c\0\0\0\0\xff\xff\xff\xff\0\x02\0\x3b"):
        with pytest.raises(ValueError):
            gif.decode_gif(data)


def test_op6_equals_the_library(spark, tables):
    from tokenizers import Tokenizer

    sf, texts, _ = tables
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in bpe.op6_bpe_round_trip(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def grown(x, y):
    """Boosted trees by the plain rules, one row and one threshold at a time."""
    trees, mean = [], np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = np.log(mean / (1 - mean))
    total = np.full(len(y), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in x.T]

    def grow(rows, depth, pull, weight):
        g, h = pull[rows].sum(), weight[rows].sum()
        best = (1e-9, None)
        if depth and len(rows) >= 2 * quality.LEAST_ROWS:
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    left = x[rows, f] <= cut
                    if min(left.sum(), (~left).sum()) < quality.LEAST_ROWS:
                        continue
                    a, b = pull[rows][left].sum(), weight[rows][left].sum()
                    gain = a * a / (b + quality.RIDGE) + (g - a) ** 2 / (h - b + quality.RIDGE) - g * g / (h + quality.RIDGE)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
        if best[1] is None:
            return quality.RATE * g / (h + quality.RIDGE)
        f, cut = best[1]
        left = x[rows, f] <= cut
        return f, cut, grow(rows[left], depth - 1, pull, weight), grow(rows[~left], depth - 1, pull, weight)

    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(quality.TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(grow(np.arange(len(y)), quality.DEPTH, y - p, p * (1 - p)))
        total = total + np.array([walk(trees[-1], row) for row in x])
    return lambda row: 1 / (1 + np.exp(-(base + sum(walk(t, row) for t in trees))))


def test_op8_equals_brute_force(spark, tables, monkeypatch):
    monkeypatch.setattr(quality, "TREES", 6)
    monkeypatch.setattr(quality, "LEAST_ROWS", 3)
    monkeypatch.setattr(quality.Trees.__init__, "__defaults__", (6, quality.DEPTH, quality.BINS, quality.RATE, 3, quality.RIDGE))
    sf, texts, labels = tables
    out = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k in texts}
    learn = [k for k in sorted(texts) if not out[k]]
    stats = {k: np.array(quality.statistics((t or "").encode())) for k, t in texts.items()}
    score = grown(np.array([stats[k] for k in learn]), np.array([labels[k] for k in learn], float))
    for r in quality.op8_quality_classifier(spark, sf).collect():
        assert r.held_out == out[r.doc_id] and r.predicted == (r.score >= 0.5)
        assert r.score == pytest.approx(score(stats[r.doc_id]), abs=1e-6)


def test_op5_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "One two", "one TWO", "a b c", "a b  C"]
    for _ in range(12):
        held = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        texts.append(" ".join(held))
        for _ in range(4):  # each differs from the one before in a word
            held[rng.randrange(len(held))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(held))
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [brute_fingerprint(t) for t in texts]
    close = [[j for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2] for a in prints]
    assert any(prints[j] != a for a, near in zip(prints, close, strict=True) for j in near)
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j in near) for near in close]
    rows = by_id(simhash.op5_simhash_near_dedup(spark, f"file://{tmp_path}"))
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, least, strict=True))}


def test_op10_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    items = [words(rng, rng.randint(3, 9)) for _ in range(6)] + ["Zeta 12", "no such thing", "", None]
    texts = [None, "", "zeta 123 zeta 12", "Zeta  12", "zeta 12x"]
    for item in items[:6]:
        for edits in (0, 1, 2, 4, 8):
            held = list(item)
            for _ in range(edits):
                held[rng.randrange(len(held))] = "#"
            texts.append(words(rng, 12) + "\n" + "".join(held) + "\t" + words(rng, 12) + " " + item[:9])
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = set()
    for i, text in enumerate(texts):
        text = " ".join((text or "").lower().split())
        for j, item in enumerate(items):
            item = " ".join((item or "").lower().split())
            if len(item) >= 24:
                edits, end = brute_best(item, text)
                if edits <= len(item) // 12:
                    expected.add((i, j, edits, end))
            elif item:
                whole = re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", text)
                expected |= {(i, j, 0, whole.end())} if whole else set()
    rows = decontaminate.op10_benchmark_decontamination(spark, f"file://{tmp_path}").collect()
    assert {tuple(r) for r in rows} == expected and len(rows) == len(expected)
    assert {e for _, _, e, _ in expected} >= {0, 1, 2} and {6} <= {j for _, j, _, _ in expected}

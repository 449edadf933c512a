import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from clauseflow.llm import bpe, components, decontaminate, gif, license_scan, quality, simhash, warc
from clauseflow.llm.common import sift

# --- GIF ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 60, 256])
def test_lzw_round_trip(letters):
    rng = random.Random(letters)
    for n in (1, 2, 300, 5000, 40000):
        data = bytes(rng.randrange(letters) for _ in range(n))
        assert gif.lzw_decode(8, gif.lzw_encode(data), n) == data


def test_gif_round_trip_and_frames():
    data = bytes(range(256)) * 3 * 192
    frames = gif.decode_gif(gif.encode_gif(data))
    assert b"".join(f["luma"] for f in frames) == data
    assert [f["start_ms"] for f in frames] == [40 * i for i in range(len(frames))]
    assert all(sum(f["histogram"]) == 192 * 64 for f in frames)


def small_gif(frames, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\xff\xff\xff"):
    """A 2 x 2 GIF of four colours; frames: (samples, disposal, transparent, left, top, w, h, flags)."""
    import struct

    out = [b"GIF89a", struct.pack("<HHBBB", 2, 2, 0x81, 0, 0), palette]
    for samples, disposal, transparent, left, top, w, h, flags in frames:
        shown = transparent is not None
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | shown, 7, transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x02")
        # with two-bit samples a clear code ahead of each sample keeps codes at three bits
        codes = [c for s in samples for c in (4, s)] + [5]
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        coded = bits.to_bytes(-(-3 * len(codes) // 8), "little")
        out += [bytes([len(coded)]), coded, b"\0"]
    return b"".join(out) + b"\x3b"


def test_disposal_and_transparency():
    full, dot = (1, 1, 1, 1), (3,)
    red, white = 76, 255
    frames = gif.decode_gif(small_gif([(full, 1, None, 0, 0, 2, 2, 0), (dot, 3, None, 0, 0, 1, 1, 0), ((2, 3), 2, 2, 0, 0, 2, 1, 0), ((2, 2), 0, 2, 0, 0, 2, 1, 0)]))
    assert list(frames[0]["luma"]) == [red] * 4
    assert list(frames[1]["luma"]) == [white]
    assert list(frames[2]["luma"]) == [red, white]  # the dot went back, the first sample is clear
    assert list(frames[3]["luma"]) == [0, 0]  # the row was cleared
    assert [f["delay_ms"] for f in frames] == [70] * 4


def test_gif_columns_and_broken_media(spark):
    table = spark.createDataFrame([(1, b"abc"), (2, None), (3, b""), (4, b"z" * 50000)], "id int, payload binary")
    rows = {r.id: r for r in gif.decode_gifs(gif.encode_gifs(table, "payload")).collect()}
    for key, raw in ((1, b"abc"), (2, b""), (4, b"z" * 50000)):
        luma = b"".join(bytes(f.luma) for f in rows[key].frames)
        assert luma.rstrip(b" ") == raw and len(luma) % 192 == 0 and rows[key].error is None
    bad = gif.decode_gifs(spark.createDataFrame([(b"no image",), (None,), (b"GIF89a\x01",)], "media binary")).collect()
    assert all(r.error and r.frames == [] for r in bad)


# --- SimHash --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    texts = [None, "", " \n", "One", "one TWO", "É one two three", "a b c " * 40, "a b c d"]
    rows = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("crowded", [1, 128])
def test_near_pairs_give_all_components(spark, bits, crowded):
    rng = random.Random(bits)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(8):
            values.add(value)
            value ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bits, crowded)
    found = {r.node: r.root for r in components.components(links).collect()}
    parent = {s: s for s in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= bits:
                x, y = root(signed[i]), root(signed[j])
                parent[max(x, y)] = min(x, y)
    assert [found.get(s, s) for s in signed] == [root(s) for s in signed]


def test_near_duplicates_edges(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    rows = simhash.near_duplicates(docs([None, "", "same words here", "same words here"])).collect()
    assert {r.doc_id: r.component for r in rows} == {0: 0, 1: 0, 2: 2, 3: 2}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)}


# --- BPE ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encode", [bpe.encode, bpe.encode_joined])
def test_bpe_equals_the_library(docs, encode):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    letters = "ab'st \n\t  é1½²!…́ñ漢😀"
    texts = [None, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "it's   we'll\n\n x  "]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(200)] + ["long word " * 5000]
    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in bpe.decode(encode(docs(texts), path), path).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == ids
        assert bytes(rows[i].decoded).decode() == library.decode(ids, skip_special_tokens=False) == (text or "")


def test_bpe_forgets_words_when_full(docs, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    path = bpe.vocabulary_path()
    texts = [f"word{i} again and again" for i in range(30)]
    rows = bpe.decode(bpe.encode(docs(texts), path), path).collect()
    assert [bytes(r.decoded).decode() for r in sorted(rows, key=lambda r: r.doc_id)] == texts
    assert bpe.encode(docs([]), path).count() == 0


# --- WARC -----------------------------------------------------------------------------------------


def test_seek_table_and_frames():
    frames = [b"one" * 100, b"", b"three"]
    bundle = warc.pack(frames)
    assert [warc.read_frame(bundle, p) for p in warc.seek_table(bundle)] == frames
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(frames)


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 600)
    html = ["<p>a</p>", None, "", "é" * 900, "<p>a</p>", "other\r\n\r\nWARC/1.1", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\n" if i else None, h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/bundles"
    warc.write_bundles(pages.coalesce(1), path)
    rows = {r.key: r for r in warc.read_bundles(spark, path).collect()}
    payloads = [(h or "").encode() for h in html]
    for i, payload in enumerate(payloads):
        last = max(j for j, p in enumerate(payloads) if p == payload)
        assert rows[i].payload_size == len(payload) and rows[i].payload_digest == warc.digest(payload)
        assert rows[i].record_type == ("response" if i == last else "revisit") and rows[i].refers_to == (None if i == last else last)
        assert bytes(rows[i].payload) == (payload if i == last else b"")
    asked = spark.createDataFrame([(warc.record_id(3),), ("<urn:uuid:none>",)], "record_id string")
    assert [r.key for r in warc.read_bundles(spark, path, asked).collect()] == [3]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "yy"), (4, "u", "yy")], "page_id bigint, url string, html string")
    assert {r.page_id: r.origin for r in warc.marked(pages, least=2).collect()} == {1: None, 2: None, 3: 4, 4: None}


# --- quality --------------------------------------------------------------------------------------


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.Trees(trees=40).fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95

    def walk(tree, row):
        node = 0
        while model.feature[tree, node] >= 0:
            node = 2 * node + (1 if row[model.feature[tree, node]] <= model.threshold[tree, node] else 2)
        return model.value[tree, node]

    by_hand = [model.base + sum(walk(t, row) for t in range(model.count)) for row in x[:20]]
    assert np.allclose(model.score(x[:20]), 1 / (1 + np.exp(-np.array(by_hand))))


def test_quality_edges(spark, docs):
    assert len(quality.statistics(b"")) == len(quality.statistics(b"A word, and\xc3\xa9 1 | 2.\n")) == len(quality.FEATURES)
    table = docs([None, "", "plain words in a row. " * 30, "%%% $$$ " * 50])
    model = quality.train(table, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert [r["score"] for r in quality.scored(table, model).collect()] == [0.5] * 4
    assert quality.scored(docs([]), model).count() == 0
    keys = spark.range(50).withColumnRenamed("id", "doc_id")
    marked = keys.select("doc_id", quality.held_out("doc_id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in marked)


def test_quality_held_out_accuracy(spark):
    from pathlib import Path

    if not Path("/root/testdata/sf0.01").exists():
        pytest.skip("no tables here")
    rows = quality.op8_quality_classifier(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    quality_rows = rows.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in quality_rows]) > 0.95


# --- licenses -------------------------------------------------------------------------------------


def test_license_scan(docs):
    mit = license_scan.TEMPLATES["MIT-text"].strip()
    near = mit.replace("free of charge", "at no charge").replace("\n", " ")
    texts = [None, "", "no such words", "Some prose. " * 200 + "Released under the MIT License. " + "More prose. " * 200, "x " * 900 + mit.upper() + " y" * 900, near, "The license plate was gone."]
    rows = license_scan.license_places(docs(texts)).collect()
    got = {(r.doc_id, r.license): (r.likeness, " ".join(r.missing), " ".join(r.extra)) for r in rows}
    assert got[3, "MIT"][0] == 1 and got[4, "MIT-text"][0] == 1
    likeness, missing, extra = got[5, "MIT-text"]
    assert 0.9 < likeness < 1 and missing == "free of" and extra == "at no"
    assert {i for i, _ in got} == {3, 4, 5}


def test_every_license_is_its_own_best():
    scanner = license_scan.Scanner()
    for template in scanner.templates:
        assert scanner.ranked(template.words)[0][1] is template


def plain_words(text):
    return re.sub("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text.lower()).split()


def in_common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_no_notice_is_lost_whatever_stands_around_it():
    """Notices in random surroundings, some less a word; nothing of the scanner is used to judge."""
    rng = random.Random(12)
    scanner = license_scan.Scanner()
    short = {k: plain_words(v) for k, v in license_scan.TEMPLATES.items() if len(plain_words(v)) <= 12}
    prose = "river stone candle the software of any party section under morning license paper is free rights terms public all".split()
    for n in range(1500):
        name = rng.choice(sorted(short))
        words = list(short[name])
        if n % 3 == 0 and len(words) >= 5:
            del words[rng.randrange(len(words))]
        ahead, behind = ([rng.choice(prose) for _ in range(rng.randrange(0, 130))] for _ in range(2))
        text = " ".join([*ahead, *words, *behind])
        found = scanner.scan(text.encode())
        lo, hi = len(ahead), len(ahead) + len(words)
        over = [p for p in found if p["first_word"] < hi and lo < p["first_word"] + p["words"]]
        assert over, text
        if words == short[name]:
            assert any(p["license"] == name and p["likeness"] == 1 for p in over) or any(p["saved"] > 6 for p in over), text
        every = plain_words(text)
        for p in found:
            stretch, template = every[p["first_word"] : p["first_word"] + p["words"]], plain_words(license_scan.TEMPLATES[p["license"]])
            same = in_common(template, stretch)
            assert same / (len(template) + len(stretch) - same) >= license_scan.LIKENESS - 1e-9


def test_runs_that_every_place_has():
    """By trying all ways to lose and add words."""
    for size in range(1, 12):
        least = size
        for added in range(size):
            for missing in range(size + 1):
                if (size - missing) / (size + added) >= 0.8 - 1e-9:
                    least = min(least, -(-(size - missing) // (missing + added + 1)))
        assert license_scan.shortest_run(size) == max(1, least)


def test_ranking_decides_between_overlapping_licenses():
    own = {"first": "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "second": "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"}
    text = "word " * 20 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho" + " word" * 20
    scanner = license_scan.Scanner(own)
    assert [p["license"] for p in scanner.scan(text.encode())] == ["second"]
    ranked = scanner.ranked
    scanner.ranked = lambda block: [(-saved, t) for saved, t in ranked(block)]
    assert [p["license"] for p in scanner.scan(text.encode())] == ["first"]


def test_long_licenses_with_changes_are_found():
    rng = random.Random(12)
    own = {"long": " ".join(f"{rng.choice(['clause', 'grant', 'party', 'section'])}{rng.randrange(400)} of" for _ in range(750))}
    scanner = license_scan.Scanner(license_scan.TEMPLATES | own)
    prose = "river stone candle the software of any party section under morning license paper is free".split()
    for n in range(12):
        name = rng.choice([k for k, v in (license_scan.TEMPLATES | own).items() if len(v.split()) > 60])
        words = (license_scan.TEMPLATES | own)[name].split()
        for _ in range(len(words) // 20 if n % 2 else 0):
            words[rng.randrange(len(words))] = rng.choice(["", "changed", "two words"])
        sides = [" ".join(rng.choice(prose) for _ in range(rng.randrange(5, 300))) for _ in range(2)]
        found = scanner.scan(f"{sides[0]}\n# {' '.join(words)}\n{sides[1]}".encode())
        assert name in {p["license"] for p in found if p["words"] > 0.8 * len(words)}


def test_long_template_and_long_text(docs):
    rng = random.Random(2)
    own = {"own": " ".join(f"w{rng.randrange(5000)}" for _ in range(1500))}
    text = "x " * 40_000 + own["own"] + " y" * 40_000 + (" " + own["own"]) * 3
    rows = license_scan.license_places(docs([text, own["own"][:2000]]), templates=own).collect()
    assert [(r.doc_id, r.first_word, r.words, r.likeness) for r in rows] == [(0, at, 1500, 1.0) for at in (40_000, 81_500, 83_000, 84_500)]


def test_license_twice_and_empty(docs):
    line = "Licensed under CC BY-NC 4.0."
    rows = license_scan.license_places(docs([f"{line} {'word ' * 300}{line}"])).collect()
    assert [r.license for r in rows] == ["CC-BY-NC-4.0"] * 2 and rows[0].first_word != rows[1].first_word
    assert license_scan.license_places(docs([])).count() == 0


def test_license_places_before_a_longer_run():
    scanner = license_scan.Scanner()
    exact, reworded = "Released under the MIT License.", "Released under the MIT Licence."
    texts = [f"{reworded} {'word ' * 8}{exact}", f"{exact} {'word ' * 8}{reworded}", f"{reworded} {'word ' * 8}{exact} {'word ' * 8}{reworded}"]
    got = [[round(p["likeness"], 3) for p in scanner.scan(text.encode()) if p["license"] == "MIT"] for text in texts]
    assert got == [[0.8, 1.0], [1.0, 0.8], [0.8, 1.0, 0.8]]


def test_rights_reserved_and_templates_of_ones_own(docs):
    rows = license_scan.license_places(docs(["Some prose. " * 60 + "\nAll rights reserved.", "He reserved a table."])).collect()
    assert [(r.doc_id, r.license, r.likeness) for r in rows] == [(0, "All-rights-reserved", 1.0)]
    own = {"own": "Anyone may share these pages freely with others."}
    assert [r.license for r in license_scan.license_places(docs(["x " * 50 + own["own"]]), templates=own).collect()] == ["own"]


# --- decontamination ------------------------------------------------------------------------------


def brute_best(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row), row.index(min(row))


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abé") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abé") for _ in range(rng.randint(0, 120)))
        assert decontaminate.Pattern(item).best(text) == brute_best(item, text)


def test_matches_equal_brute_force(spark, docs):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(6, 20))) for _ in range(8)] + ["short", "", None]
    texts = [None, "", "nothing of it"]
    for item in items[:8]:
        for edits in (0, 1, 3, 5, 9, 14):
            held = list(item.upper() if edits == 1 else item)
            for _ in range(edits):
                i = rng.randrange(len(held))
                held[i : i + 1] = rng.choice([[], ["#"], [held[i], "#"]])
            texts.append(" ".join(rng.choice(words) for _ in range(30)) + "\n " + "".join(held) + "  " + " ".join(rng.choice(words) for _ in range(30)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.matches(docs(texts), table).collect()}
    expected = {}
    for i, text in enumerate(texts):
        for j, item in enumerate(items):
            item, clean = decontaminate.normal(item), decontaminate.normal(text)
            if len(item) >= decontaminate.LEAST:
                best, _ = brute_best(item, clean)
                if best <= decontaminate.budget(item):
                    expected[i, j] = best
    assert got == expected
    left = decontaminate.decontaminated(docs(texts), table)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in expected}


def test_items_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    items = spark.createDataFrame([(i, f"the passage with number {i} of this set of items") for i in range(12)], "item_id bigint, text string")
    texts = [f"before the passage with number {i} of this set of items after" for i in range(12)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(texts), items).where("edits = 0").collect()}
    assert got == {(i, i) for i in range(12)}
    assert decontaminate.matches(docs(texts), items.limit(0)).count() == 0


# --- shared ---------------------------------------------------------------------------------------


def test_sift_keeps_all_that_is_wanted(spark):
    rows = spark.range(20000).withColumnRenamed("id", "k")
    wanted = spark.range(0, 20000, 250).withColumnRenamed("id", "key")
    kept = sift(rows, "k", wanted, "key")
    assert kept.columns == ["k"] and kept.count() < 400
    assert kept.join(wanted, kept.k == wanted.key).count() == wanted.count()

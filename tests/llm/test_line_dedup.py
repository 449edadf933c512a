import random

import pytest

from clauseflow.llm import line_dedup


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:]


def brute(texts, least):
    seen, out = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            solid = line.strip(" \t\n\x0b\x0c\r")
            near = len(line) >= least and any(len(s) >= least and within_one(line, s) for s in seen)
            if not solid or not near and line not in seen:
                kept.append(line)
            if solid:
                seen.append(line)
        out.append("\n".join(kept) if text is not None else None)
    return out


def edited(rng, line):
    i, c = rng.randrange(len(line) + 1), rng.choice("xyzé😀")
    return rng.choice([line[:i] + c + line[i:], line[:i] + line[i + 1 :], line[:i] + c + line[i + 1 :]])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab cdé") for _ in range(rng.choice([5, 20, 21, 40, 127, 128, 129, 300, 700]))) for _ in range(25)]
    texts = [None, "", "\n\n", "short", "short", " " * 30, " " * 30, "x", "x\ny\n x"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edited(rng, line)
            lines.append(line)
        texts.append("\n".join(lines))
    texts += ["a" * 30, "a" * 31, "a" * 33, "a" * 29 + "b", "a" * 30 + "\n" + "a" * 30]
    table = docs(texts)
    rows = line_dedup.without_lines(table, line_dedup.removed_lines(table)).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == brute(texts, line_dedup.LEAST)


def test_hot_variant_and_long_lines(docs):
    stem = "the same words stand in each of these lines"
    hot = [stem[:10] + chr(97 + i % 26) * (1 + i // 26) + stem[10:] for i in range(60)]
    long = "word " * 3000
    texts = [*hot, long, long + "x", long[:7000] + "#" + long[7001:]]
    table = docs(texts)
    rows = line_dedup.without_lines(table, line_dedup.removed_lines(table)).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == brute(texts, line_dedup.LEAST)


def test_edges(spark, docs):
    none = docs([])
    assert line_dedup.without_lines(none, line_dedup.removed_lines(none)).count() == 0
    line = "a line that is long enough to count"
    table = spark.createDataFrame([(None, line, 1), (3, line, 2), (3, line, 2), (4, line, 3)], "doc_id bigint, text string, n_lines bigint")
    rows = line_dedup.without_lines(table, line_dedup.removed_lines(table)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, line), (3, line), (3, line), (4, "")]
    assert {r.n_lines for r in rows} == {1}  # the operator's own column takes the place of that name


def test_very_long_lines(docs):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh é😀") for _ in range(300_000))
    texts = [long, long[:123_456] + "#" + long[123_456:], long[:-1], long[1:-1] + "##", long[:200_000] + "##" + long[200_002:]]
    table = docs(texts)
    rows = line_dedup.without_lines(table, line_dedup.removed_lines(table)).collect()
    assert [r.n_removed for r in sorted(rows, key=lambda r: r.doc_id)] == [0, 1, 1, 0, 0]


def test_short_copies_go_in_the_pipeline(spark, docs):
    import corpus_pipeline

    long = "a line that is long enough to count"
    texts = [f"Ietzte.\n\n{long}", f" \n\nIetzte.\nIetzt\n{long}x", "Ietzt\nIetzte.\n \nIetzte!", None, "Ietzte."]
    rows = corpus_pipeline.dedup_lines(spark, docs(texts), "").collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.doc_id)] == [texts[0], " \n\nIetzt", " \nIetzte!", None, ""]

import random

import corpus_pipeline
import pytest
import xxhash
from clauseflow.llm import near_copies


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(texts):
    """The least id of each component of pairs with a Jaccard similarity of 0.8 at least."""
    sets, root = [five(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("crowded", [1024, 3])
def test_stage_equals_brute_force(docs, monkeypatch, crowded):
    rng = random.Random(crowded)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for size, times in [(8, 6), (40, 8), (150, 14), (150, 14), (2500, 4)]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(times):
            words = list(base)
            for _ in range(rng.randrange(max(2, size // 30) + 1)):
                words[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
            base = words if rng.random() < 0.3 else base
    hot = " ".join(f"h{i}" for i in range(30))
    texts += [hot + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 4, 8, 30]))) for _ in range(12)]
    rng.shuffle(texts)
    monkeypatch.setattr(near_copies, "FEW", 2)  # so that larger bands occur
    monkeypatch.setattr(near_copies.near_copies, "__defaults__", ("doc_id", "text", crowded))
    got = {r.doc_id for r in corpus_pipeline.dedup_near(None, docs(texts), "").collect()}
    assert got == kept(texts) and len(got) < len(texts)


def test_empty_table(docs):
    assert near_copies.near_copies(docs([])).count() == 0


def test_simhash_links_without_bands(docs, monkeypatch):
    """What the SimHash grid finds, which is held against fingerprints made bit by bit."""
    rng = random.Random(5)
    texts = [None, " ", "one two three"]
    for at in range(20):
        base = [f"t{at}w{rng.randrange(10**6)}" for _ in range(900)]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            words = list(base)
            words[rng.randrange(900)] = "changed"
            texts.append(" ".join(words))
        texts.append(" ".join(base[:450] + [f"n{rng.randrange(10**6)}" for _ in range(450)]))

    def bit_by_bit(text):
        hashes = [xxhash.xxh64_intdigest(" ".join(s), seed=42) for s in five(text)]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    fps = [bit_by_bit(t) for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert len({j for _, j in near}) > 10
    least = list(range(len(texts)))
    for i, j in near * len(near):
        least[i] = least[j] = min(least[i], least[j])
    monkeypatch.setattr(near_copies, "BANDS", 0)
    assert {r.doc_id: r.component for r in near_copies.near_copies(docs(texts)).collect()} == dict(enumerate(least))

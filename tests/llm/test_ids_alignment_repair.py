"""Id files, token alignment and conversation repair, each against a version that shares no code with it."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from clauseflow.llm import alignment, conversation_repair, id_files
from clauseflow.llm.queries import QUERIES
from clauseflow.sources.scratch import fresh_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "it's they'RE 'sam ''s '' 's", "<|endoftext|>x's", "a<|startoftext|>", "İΣς ſ é ́é", "½²3٣4_-!", "日本ᄀ각　", "a\x1cb\x85c\t d", "  lead", "trail  ", "a\n\n b\nc.\nd", "▁a", "<0x0A> <s>", " x", "😀 a😀"]


def fuzzed(n, seed=1):
    random.seed(seed)
    letters = "aAb ß'tREsé\n\t\x1c ́²3-!.'日ᄀ각　<|>▁😀ÀǅΣ"
    return ["".join(random.choices(letters, k=random.randint(0, 12))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoder_equals_the_library(words):
    encoder = id_files.WordEncoder(id_files.vocabulary_path())
    encoder.known.most = 64  # all is forgotten again and again
    texts = fuzzed(400)
    for at in range(0, len(texts), 7):
        ids, sizes = encoder.encode(texts[at : at + 7])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [words(t) for t in texts[at : at + 7]]
    assert encoder.encode([])[0].size == 0


def test_coding_has_every_length():
    values = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], np.uint64)
    for n in range(len(values) + 1):
        ranks, sizes = id_files.unpack(id_files.pack(values[:n], np.array([n], np.uint32)))
        assert ranks.tolist() == values[:n].tolist() and sizes.tolist() == [n]
    coded = id_files.pack(np.arange(300), np.array([100, 200]))
    assert len(coded) == 24 + 8 + 75 + 256 + 2 * 44
    with pytest.raises(ValueError):
        id_files.unpack(coded[:-1])
    with pytest.raises(ValueError):
        id_files.unpack(b"xxxx" + coded[4:])


def by_hand(rows, words):
    """rows(key, text) in order -> (key, start, n, crc)."""
    out, at = [], 0
    for key, text in rows:
        ids = words(text or "") + [1]
        out.append((key, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def test_id_files_query(spark, words):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, QUERIES["op11_id_files"](spark, SMALL).collect())) == by_hand(rows, words)


def read_back(spark, docs, **options):
    folder = fresh_path(spark, "ids")
    id_files.write_ids(docs, folder, **options)
    return folder, id_files.read_ids(spark, folder)


def test_id_files_defined_cases(spark, words):
    rows = [(None, "null key"), (5, None), (1, "a b"), (1, "a b"), (1, "other"), (7, ""), (3, "word " * 30_000)]
    docs = spark.createDataFrame([(k, t, "x", "x") for k, t in rows], "doc_id int, text string, part string, `a.b` string")
    folder, read = read_back(spark, docs)
    found = sorted(((r.start, r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in read.collect()), key=lambda r: r[0])
    assert [k for _, k, _ in found] == [None, 1, 1, 1, 3, 5, 7]
    assert Counter((k, tuple(ids)) for _, k, ids in found) == Counter((k, (*words(t or ""), 1)) for k, t in rows)
    assert [s for s, _, _ in found] == np.cumsum([0, *(len(i) for _, _, i in found)])[:-1].tolist()
    # the most frequent id has rank 0, and nearly all of this text takes one byte an id
    counts = Counter(i for _, _, ids in found for i in ids)
    ranks = {r.id: r["rank"] for r in spark.read.parquet(f"{folder}/ranks").collect()}
    assert sorted(counts, key=lambda i: (-counts[i], i)) == sorted(ranks, key=ranks.get)
    empty = docs.where("doc_id = 99")
    assert read_back(spark, empty)[1].count() == 0
    folder, read = read_back(spark, docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    assert [r.key for r in read.orderBy("start").collect()] == [None, "1", "1", "1", "3", "5", "7"]


A, B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def groups():
    """A function from a text to its groups, by walking both token lists; None without tokens."""
    a = Tokenizer.from_file(A)
    a.no_padding()
    a.no_truncation()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(shown)))}
    of_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]

    def found(text):
        if not text:
            return None
        ids, others = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        if b"".join(of_a[i] for i in ids) != f" {text}".encode() or b"".join(of_b[i] for i in others) != f" {text}".encode():
            return None
        out, x, y = [([], [])], 0, 0
        ids, others = ids[::-1], others[::-1]
        while ids or others:
            if x <= y and ids:
                out[-1][0].append(ids.pop())
                x += len(of_a[out[-1][0][-1]])
            else:
                out[-1][1].append(others.pop())
                y += len(of_b[out[-1][1][-1]])
            if x == y and out[-1][0] and out[-1][1]:
                out.append(([], []))
        return out[:-1]

    return found


def spelt(found):
    return hashlib.sha256(";".join("|".join(",".join(map(str, side)) for side in group) for group in found).encode()).hexdigest()


def aligned_by_hand(rows, groups):
    cut = [(k, groups(t)) for k, t in rows]
    counts = Counter((a[-1], b[-1]) for _, found in cut for a, b in found or [])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for k, found in cut:
        if not found:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        ns = [(counts[a[-1], b[-1]], top[b[-1]]) for a, b in found]
        out.append((k, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(ns), sum(n == t for n, t in ns), sum(n for n, _ in ns), spelt(found)))
    return out, counts


def test_chunks_lay_out_whole_texts(groups):
    work = alignment.Aligner(*alignment.vocabulary_paths())
    work.known.most = 64
    texts = fuzzed(400, 2)
    for at in range(0, len(texts), 9):
        part = texts[at : at + 9]
        for text, *got in zip(part, *(c.to_pylist() for c in work.laid(part)[:4]), strict=True):
            found = groups(text)
            want = [sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), spelt(found)] if found else [0, 0, 0, ""]
            assert got == want, text


def test_both_sources_of_ids_agree():
    slow, fast = (alignment.byte_level(A, r) for r in (None, alignment.vocabulary_paths()[2]))
    assert all(slow.ids_of(t) == fast.ids_of(t) for t in fuzzed(500, 3))


def test_alignment_query(spark, groups):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_alignment"](spark, SMALL).collect())) == sorted(aligned_by_hand(rows, groups)[0])


def test_alignment_defined_cases(spark, groups):
    texts = [None, "", "▁lost", *ODD, "the same", "the same", "long " * 20_000, "x" * 5_000]
    rows = [(None if i % 5 == 0 else i // 3, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(k, t, "x", "x") for k, t in rows], "doc_id int, text string, row string, `a.b` string").repartition(3)
    per_document, links = alignment.alignment(docs, *alignment.vocabulary_paths())
    want, counts = aligned_by_hand(rows, groups)
    assert Counter(map(tuple, per_document.collect())) == Counter(want)
    assert {(r.a_id, r.b_id): r.n for r in links.collect()} == counts
    none, links = alignment.alignment(docs.where("doc_id = 999"), *alignment.vocabulary_paths())
    assert none.count() == links.count() == 0


SPACE = "\x20\t\n\x0b\x0c\r"


def all_edits(rows):
    """(cost, initials, lines) of the cheapest sound edits, by trying all; (role, text) rows."""
    faults, seen, best = [], set(), None
    for role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)

    def go(i, cost, audit, lines, put_in):
        nonlocal best
        if cost > (best[0] if best else 2 * len(rows)):
            return
        if put_in < 2:
            for role in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*lines, (role, "")], put_in + 1)
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines)) and all(r for r, _ in lines):
                best = min([(cost, audit, lines), *([best] if best else [])], key=lambda b: b[:2])
            return
        (role, text), fault = rows[i], faults[i]
        go(i + 1, cost + 2, audit + "D", lines, 0)
        if fault not in ("blank", "duplicate"):
            stays = cost + 5 * (fault == "truncated")
            go(i + 1, stays, audit + "K", [*lines, (role, text)], 0)
            for other in ("user", "assistant"):
                go(i + 1, stays + 1, audit + "R", [*lines, (other, text)], 0)

    go(0, 0, "", [], 0)
    return best, faults


def mended(rows):
    """rows(turn, role, text) of one conversation in order -> the result's columns."""
    spoken = [(r, t) for _, r, t in rows]
    (cost, audit, lines), faults = all_edits(spoken)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(spoken, spoken[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


@pytest.mark.parametrize("bits", [conversation_repair.BLOCK_BITS, 1, 0])
def test_repairs_equal_trying_all_edits(spark, bits):
    """With blocks of two rows and of one, every conversation is a long one."""
    random.seed(5)
    texts = ["a.", "b!", "c?", "", " \t", "x", "y. ", "z\n", " ", None]
    rows = [(conv if conv else None, random.choice([None, *range(9)]), random.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), random.choice(texts)) for conv in range(60) for _ in range(random.randint(1, 5))]
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id int, turn bigint, role string, text string, at string, `a.b` string").repartition(5)
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn, role or " ", text if text is not None else " "))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    found = {r[0]: tuple(r)[1:] for r in conversation_repair.repairs(table, bits=bits).collect()}
    assert found == {conv: mended(sorted(some, key=order)) for conv, some in want.items()}


def test_one_long_conversation(spark):
    """Half of all rows in one conversation, many of them the same row; blocks and one piece agree."""
    rows = spark.range(20_000).selectExpr("IF(id % 2 = 0, 1, id) AS conv_id", "id AS turn", "IF(hash(id) % 3 = 0, 'user', 'assistant') AS role", "IF(id % 5 < 3, 'again and again.', concat('t', id, IF(id % 4 = 0, '', '!'))) AS text")
    found = {r.conv_id: r for r in conversation_repair.repairs(rows, bits=6).collect()}
    whole = {r.conv_id: r for r in conversation_repair.repairs(rows, bits=30).collect()}
    assert len(found) == 10_000 and found == whole and len(found[1].audit) >= 10_000


def test_repair_of_nothing(spark):
    assert conversation_repair.repairs(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).count() == 0


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    spoilt = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", said[3]) if kind == 2 else said[3]
        spoilt[conv] += [(turn, "user" if kind == 4 else said[2], text)] * {0: 0, 3: 2}.get(kind, 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {conv: mended(sorted(some)) if some else nothing for conv, some in spoilt.items()}
    found = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, SMALL).collect()}
    few = {conv for conv, some in spoilt.items() if len(some) <= 9}
    assert found.keys() == want.keys() and {c: found[c] for c in few} == {c: want[c] for c in few}
    assert len(few) > 5

"""License scans by conditional compression.

Texts are words of ASCII letters, digits and any other characters beyond ASCII, lower-cased; what is
between them does not count. A template stands at a place if the words that both have in common, in
order, are ``LIKENESS`` of the template's words and of those added in between.

Such a place lacks a share of the template's words at the most, so of any words that make up more
than that share it has one. For each template the longest words are taken, until they do: the
triggers. Words around triggers are the candidate blocks; long stretches are cut into blocks of
``BLOCK`` words. Each block is compressed by itself and with each template that has a trigger in it as a
raw zstandard dictionary (no other template can stand there), and templates are ranked by how many bytes
they save. The exact differences in wording confirm the winners: the template's words are aligned with
the words of the block and of its surroundings as far as the template can reach, along every run that
both have in common and that is as long as a place must have; missing and extra words are listed.

Where confirmed places share words, the template that saves most has them; among those within
``MARGIN`` bytes of it, which is what short blocks vary by, the exact wording decides.

A narrow map over the documents that have a trigger, by a built-in regular expression; nothing is
shuffled, and the templates, a fixed list, go to every task. A text's cost is in proportion to its
length times that of the templates.

Defined cases: null and empty texts give no rows; repeated rows give rows of their own; a license
named twice in one document gives a row for each place; an empty table gives an empty result; case, punctuation and line breaks do not count as
differences; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, column, kind_of, table, utf8
from .license_texts import TEMPLATES

AROUND, BLOCK, MARGIN, LIKENESS = 4, 96, 6, 0.8

_LETTERS = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def triggers(words: list[bytes], likeness: float = LIKENESS) -> set[bytes]:
    """Words of a template one of which every place has that is like it."""
    missing = len(words) - math.ceil(likeness * len(words) - 1e-9)
    out: set[bytes] = set()
    counts = Counter(words)
    for word in sorted(counts, key=lambda w: (-len(w), w)):
        if missing < 0:
            break
        out.add(word)
        missing -= counts[word]
    return out


def blocks(places: list[int], size: int, around: int = AROUND, most: int = BLOCK) -> list[tuple[int, int]]:
    """Word ranges around the triggers' places; what touches is one stretch, cut at ``most`` words."""
    stretches: list[list[int]] = []
    for at in places:
        lo, hi = max(0, at - around), min(size, at + around + 1)
        if stretches and lo <= stretches[-1][1]:
            stretches[-1][1] = hi
        else:
            stretches.append([lo, hi])
    return [(at, min(at + most, hi)) for lo, hi in stretches for at in range(lo, hi, most)]


def shortest_run(size: int, likeness: float = LIKENESS) -> int:
    """A place like a template of that many words has as many of them in one run at least: whatever is
    missing or added parts the others into so many runs at the most."""
    out = size
    for added in range(math.floor(size * (1 / likeness - 1) + 1e-9) + 1):
        missing = size - math.ceil(likeness * (size + added) - 1e-9)
        out = min(out, -(-(size - missing) // (missing + added + 1)))
    return max(1, out)


class Template:
    """A template's words and the compressor that has them as its dictionary."""

    def __init__(self, name: str, text: str, likeness: float) -> None:
        self.name, self.words = name, words_of(text.encode())
        self.reach = math.ceil(len(self.words) / likeness)
        content = b" ".join(self.words)
        held = zstandard.ZstdCompressionDict(content.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_dict_id=False)
        self.triggers = triggers(self.words, likeness)
        self.run = shortest_run(len(self.words), likeness)
        self.places: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(len(self.words) - self.run + 1):
            self.places.setdefault(tuple(self.words[i : i + self.run]), []).append(i)


_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False)


class Scanner:
    """All templates, ready to compress with."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, likeness: float = LIKENESS, margin: int = MARGIN) -> None:
        self.templates = [Template(name, text, likeness) for name, text in templates.items() if words_of(text.encode())]
        self.likeness, self.margin = likeness, margin
        self.triggers = set().union(*(t.triggers for t in self.templates))

    def ranked(self, block: list[bytes]) -> list[tuple[int, Template]]:
        """Templates that have a trigger in the block, by the bytes that each saves."""
        held, text = set(block), b" ".join(block)
        alone = len(_PLAIN.compress(text))
        saved = [(alone - len(t.coder.compress(text)), t) for t in self.templates if not t.triggers.isdisjoint(held)]
        return sorted(saved, key=lambda x: (-x[0], x[1].name))

    def places(self, template: Template, words: list[bytes], lo: int, hi: int) -> list[dict]:
        """Where the template stands in the words so as to reach into lo..hi, with the differences in
        wording: tried along every run of words in common, the longest first."""
        start, stop = max(0, lo - template.reach), min(len(words), hi + template.reach)
        size, open_, runs = template.run, {}, {}
        for at in range(start, stop - size + 1):
            for i in template.places.get(tuple(words[at : at + size]), ()):
                first, end = open_.get(at - i, (at, 0))
                first, end = open_[at - i] = first if end == at + size - 1 else at, at + size
                longest = runs.get(at - i, (0, 0))
                if end - first > longest[1] - longest[0]:
                    runs[at - i] = first, end
        out, slack = [], template.reach - len(template.words) + 2
        for shift, (first, end) in sorted(runs.items(), key=lambda r: (r[1][0] - r[1][1], r[0])):
            if any(p["first_word"] <= first and end <= p["first_word"] + p["words"] for p in out):
                continue
            a = max(start, shift - slack)
            place = self._aligned(template, words[a : min(stop, shift + len(template.words) + slack)], a)
            if place["likeness"] >= self.likeness and place["first_word"] < hi and place["first_word"] + place["words"] > lo:
                out.append(place)
        return out

    def _aligned(self, template: Template, near: list[bytes], at: int) -> dict:
        runs = [m for m in SequenceMatcher(None, template.words, near, autojunk=False).get_matching_blocks() if m.size]
        runs = _inner(runs, len(template.words))
        first, end = runs[0].b, runs[-1].b + runs[-1].size
        held = {i for m in runs for i in range(m.a, m.a + m.size)}
        kept = {i for m in runs for i in range(m.b, m.b + m.size)}
        missing = [w.decode() for i, w in enumerate(template.words) if i not in held]
        extra = [near[i].decode() for i in range(first, end) if i not in kept]
        likeness = len(held) / (len(template.words) + len(extra))
        return {"license": template.name, "first_word": at + first, "words": end - first, "likeness": likeness, "missing": missing, "extra": extra}

    def scan(self, text: bytes) -> list[dict]:
        words = words_of(text)
        found: dict[tuple[int, int, str], dict] = {}
        for lo, hi in blocks([i for i, w in enumerate(words) if w in self.triggers], len(words)):
            for saved, template in self.ranked(words[lo:hi]):
                for place in self.places(template, words, lo, hi):
                    place |= {"saved": saved, "likeness": round(place["likeness"], 6)}
                    held = found.setdefault((place["first_word"], place["words"], template.name), place)
                    held["saved"] = max(held["saved"], saved)
        return chosen(list(found.values()), self.margin)


def _inner(runs: list, size: int) -> list:
    """The common runs less those at either end that cost more extra words than they have in common."""
    while len(runs) > 1 and runs[0].size < runs[1].b - runs[0].b - runs[0].size:
        runs = runs[1:]
    while len(runs) > 1 and runs[-1].size < runs[-1].b - runs[-2].b - runs[-2].size:
        runs = runs[:-1]
    return runs


def chosen(places: list[dict], margin: int = MARGIN) -> list[dict]:
    """Of places that share words, the one whose template saves most; of those that save within
    ``margin`` bytes as much, the one with more words in common. In order of place."""
    wording = lambda p: (len(p["extra"]) - p["words"], -p["likeness"], p["license"], p["first_word"])
    meet = lambda p, q: p["first_word"] < q["first_word"] + q["words"] and q["first_word"] < p["first_word"] + p["words"]
    out, left = [], sorted(places, key=lambda p: p["first_word"])
    while left:
        # places that touch, one to the next, are settled by themselves
        end, some = left[0]["first_word"] + left[0]["words"], 0
        while some < len(left) and left[some]["first_word"] < end:
            end = max(end, left[some]["first_word"] + left[some]["words"])
            some += 1
        group, left = left[:some], left[some:]
        while group:
            best = min(group, key=lambda p: (-p["saved"], wording(p)))
            near = [p for p in group if meet(p, best) and p["saved"] >= best["saved"] - margin]
            winner = min(near, key=wording)
            out.append(winner)
            group = [p for p in group if not meet(p, winner)]
    return sorted(out, key=lambda p: p["first_word"])


def pattern(templates: dict[str, str], likeness: float = LIKENESS) -> str:
    """A Java pattern for texts that have a trigger."""
    scanner = Scanner(templates, likeness=likeness)
    words = "|".join(sorted(re.escape(w.decode()) for w in scanner.triggers))
    letter = r"[a-zA-Z0-9\x{80}-\x{10ffff}]"
    return f"(?i)(?<!{letter})(?:{words})(?!{letter})" if words else "(?!)"


_SCHEMA = pa.schema([("license", pa.string()), ("first_word", pa.int32()), ("words", pa.int32()), ("saved", pa.int32()), ("likeness", pa.float64()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])


def license_places(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, license, first_word, words, saved, likeness, missing, extra): a row for each place."""
    kind = kind_of(docs, key)
    plain = docs.select(column(key).alias("key"), column(text).alias("text"))
    rows = plain.where(F.col("text").rlike(pattern(templates))).select("key", utf8("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            row, found = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                places = scanner.scan(raw)
                found += places
                row += [i] * len(places)
            made = pa.RecordBatch.from_pylist(found, _SCHEMA)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *made.columns], names=["key", *_SCHEMA.names])

    batches_of(docs.sparkSession)
    out = rows.mapInArrow(run, f"key {kind}, license string, first_word int, words int, saved int, likeness double, missing array<string>, extra array<string>")
    return out.withColumnRenamed("key", key)


def op3_license_scan(spark, sf_dir):
    found = license_places(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "first_word", "words", "saved", "likeness", F.array_join("missing", " ").alias("missing"), F.array_join("extra", " ").alias("extra"))

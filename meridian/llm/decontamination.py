"""Benchmark decontamination: BM25 over test items, searched with block-max WAND.

Index: every test item (long ones in parts of ``PART`` tokens) is a document of
an inverted index; a posting's impact is its BM25 weight over the item's own
total, so 1 means that all of an item's terms were met.  Postings are sorted by
item and cut into blocks with their largest impact.

Search: every training text is read whole, as passages of ``2 * PART`` tokens that
overlap by half, so that any part lies in one.  Passages are screened a batch at a
time by an upper bound: for each item, the impacts of its rarer terms that occur,
plus all of its frequent ones (which are never looked up, as MaxScore does).  A
passage that is left is a query of its distinct terms: WAND moves to the first item whose terms' largest impacts can reach
``THRESHOLD``, block maxima skip it if they can't, and only then it is scored.
All items above the threshold are verified: at least ``OVERLAP`` of the five-word
shingles of its question and of its answer must stand in the text.  (A question
ends at the first question mark with five words on either side, else at the
middle; items of under ten words are verified whole.)

The index is broadcast in parts of at most ``INDEX_BYTES`` of item text, one pass
over the texts for each part; term statistics are those of all items.

Defined results: null texts and texts without tokens match nothing, neither do
items without tokens; a text is reported once for each item; repeated rows of
documents give repeated rows, repeated items (same id and text) count once, items with the
same id and different texts are items of their own; items without an id count as
others, reported with a null id; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plainly_named, table
from .tokens import slices, texts_of, words_of

K1, B = 1.2, 0.75
PART = 64
BLOCK = 8
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.75
INDEX_BYTES = 16 << 20
#: Terms of more than this share of the items are frequent.
FREQUENT = 0.04
#: A token is a run of word characters (``\w``: letters and digits of any script, and _) of the case-folded text.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c == 95 else 32 for c in range(128)) + bytes(range(128, 256))
#: Characters folded at a time.
PIECE = 1 << 20


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Of all code points, whether they are word characters."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


def folded(text: str | None) -> bytes:
    """The text case-folded, in UTF-8, with a space for every character outside words."""
    if not text:
        return b""
    if text.isascii():
        return text.encode().translate(_TABLE)
    out = []
    for at in range(0, len(text), PIECE):
        chars = np.frombuffer(text[at : at + PIECE].casefold().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out.append(np.where(word_characters()[chars], chars, np.uint32(32)).tobytes().decode("utf-32-le").encode())
    return b"".join(out)


def tokens(text: str | None) -> list[bytes]:
    return folded(text).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Runs of five words; a shorter text is one run."""
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def split_item(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item; an item of under ten words is all question."""
    words = tokens(text)
    if len(words) < 2 * SHINGLE:
        return words, []
    cut = next((n for m in re.finditer(r"\?", text) if SHINGLE <= (n := len(tokens(text[: m.end()]))) <= len(words) - SHINGLE), len(words) // 2)
    return words[:cut], words[cut:]


def pieces_of(words: list[bytes]) -> list[list[bytes]]:
    """An item's parts."""
    return [words[at : at + PART] if at == 0 or len(words) - at >= PART // 2 else words[-PART:] for at in range(0, len(words), PART)]


class Statistics:
    """Document frequencies, number and total length of the parts of all items."""

    def __init__(self) -> None:
        self.df: Counter = Counter()
        self.n = self.length = 0

    def add(self, items: list[tuple[int | None, str]]) -> Statistics:
        for _, text in set(items):
            for piece in pieces_of(tokens(text)):
                self.df.update(set(piece))
                self.n += 1
                self.length += len(piece)
        return self


class Index:
    """Postings with block maxima, and what verification needs; weights are by ``stats``, of these items if not given."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics | None = None):
        stats = stats or Statistics().add(items)
        self.items = sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.sides = [tuple(shingles(s) for s in split_item(text)) for _, text in self.items]
        self.of: list[int] = []
        parts: list[list[bytes]] = []
        for i, (_, text) in enumerate(self.items):
            for piece in pieces_of(tokens(text)):
                parts.append(piece)
                self.of.append(i)
        mean = stats.length / max(stats.n, 1)
        df = stats.df
        raw: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for e, p in enumerate(parts):
            norm = K1 * (1 - B + B * len(p) / mean)
            weights = {t: math.log(1 + (stats.n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(p).items()}
            total = sum(weights.values())
            for t, w in weights.items():
                raw[t].append((e, w / total))
        self.entries = {t: [e for e, _ in ps] for t, ps in raw.items()}
        self.impacts = {t: [w for _, w in ps] for t, ps in raw.items()}
        self.most = {t: max(ws) for t, ws in self.impacts.items()}
        self.blocks = {t: [max(ws[k : k + BLOCK]) for k in range(0, len(ws), BLOCK)] for t, ws in self.impacts.items()}
        self._screen()

    def _screen(self) -> None:
        """Rarer terms by hash with their postings, and what each entry needs of them."""
        n = len(self.of)
        need = np.full(n, THRESHOLD)
        rare = []
        for t, es in self.entries.items():
            if len(es) > max(4, FREQUENT * n):
                np.subtract.at(need, es, self.impacts[t])
            else:
                rare.append(t)
        self.need = need - 1e-9
        codes = words_of(*texts_of(pa.array(rare, pa.binary())))[0] if rare else np.zeros(0, np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        rare = [rare[i] for i in order]
        self.sizes = np.array([len(self.entries[t]) for t in rare], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.posted = np.array([e for t in rare for e in self.entries[t]], dtype=np.int64)
        self.weight = np.array([w for t in rare for w in self.impacts[t]])
        #: An entry of frequent terms only can't be ruled out this way.
        self.always = bool((self.need <= 0).any())

    def screened(self, texts: pa.Array) -> dict[int, list[int]]:
        """For each text that may match, its passages that may (by number)."""
        hashes, _, _, words = words_of(*texts_of(pa.array([folded(t) for t in texts.to_pylist()], pa.large_binary())))
        if not len(hashes) or not len(self.of):
            return {}
        count = np.maximum(0, -(-np.diff(words) // PART))
        base = np.cumsum(count) - count
        if self.always:
            return {d: list(range(count[d])) for d in np.flatnonzero(count)}
        at = np.minimum(np.searchsorted(self.codes, hashes), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == hashes)
        doc = np.searchsorted(words, known, "right") - 1
        segment = base[doc] + (known - words[doc]) // PART
        pairs = np.unique(segment * len(self.codes) + at[known])
        segment, term = np.divmod(pairs, len(self.codes))
        reps = self.sizes[term]
        spot = np.repeat(self.first[term] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        keys, where = np.unique(np.repeat(segment, reps) * len(self.of) + self.posted[spot], return_inverse=True)
        sums = np.bincount(where, self.weight[spot], len(keys))
        after = np.minimum(np.searchsorted(keys, keys + len(self.of)), max(len(keys) - 1, 0))
        both = sums + np.where(keys[after] == keys + len(self.of), sums[after], 0) if len(keys) else sums
        hit = np.unique(keys[both >= self.need[keys % len(self.of)]] // len(self.of))
        found: dict[int, list[int]] = defaultdict(list)
        for g, d in zip(hit, np.searchsorted(base + count, hit, "right"), strict=True):
            found[int(d)].append(int(g - base[d]))
        return found

    def search(self, terms: list[bytes], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (entry, score) with a score of at least ``threshold``: block-max WAND."""
        cursors = [[self.entries[t][0], 0, t] for t in terms]
        out = []
        slack = threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            if cursors[0][0] == target:
                bound = sum(self.blocks[t][at // BLOCK] for _, at, t in cursors[: pivot + 1])
                if bound >= slack:
                    score = sum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                    if score >= slack:
                        out.append((target, score))
                    beyond = target + 1
                else:
                    # No item before the end of the shortest block can reach it either.
                    ends = [self.entries[t][min((at // BLOCK + 1) * BLOCK, len(self.entries[t])) - 1] for _, at, t in cursors[: pivot + 1]]
                    beyond = min(min(ends) + 1, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else min(ends) + 1)
                    beyond = max(beyond, target + 1)
                moved = cursors[: pivot + 1]
            else:
                beyond, moved = target, [c for c in cursors[:pivot] if c[0] < target]
            for c in moved:
                es = self.entries[c[2]]
                c[1] = bisect_left(es, beyond, c[1])
                c[0] = es[c[1]] if c[1] < len(es) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def matches(self, text: str | None, passages: list[int] | None = None) -> list[tuple[int, float, float, float]]:
        """(item_id, bm25, question overlap, answer overlap) of the verified items of a text."""
        words = tokens(text)
        most = self.most
        best: dict[int, float] = {}
        for p in range(-(-len(words) // PART)) if passages is None else passages:
            terms = {w for w in words[p * PART : (p + 2) * PART] if w in most}
            if sum(most[w] for w in terms) < THRESHOLD:
                continue
            for e, s in self.search(sorted(terms)):
                i = self.of[e]
                best[i] = max(best.get(i, 0.0), s)
        if not best:
            return []
        wanted = frozenset().union(*(side for i in best for side in self.sides[i]))
        have = {x for j in range(len(words) - SHINGLE + 1) if (x := tuple(words[j : j + SHINGLE])) in wanted}
        out = []
        for i, s in sorted(best.items()):
            q, a = self.sides[i]
            short = next(iter(q)) if len(q) == 1 and len(next(iter(q))) < SHINGLE else None
            if short:
                q_share = float(any(tuple(words[j : j + len(short)]) == short for j in range(len(words))))
            else:
                q_share = len(q & have) / len(q)
            a_share = len(a & have) / len(a) if a else q_share
            if q_share >= OVERLAP and a_share >= OVERLAP:
                out.append((self.items[i][0], s, q_share, a_share))
        return out


    def batch(self, texts: pa.Array) -> list[list[tuple[int, float, float, float]]]:
        """``matches`` of every text."""
        out: list[list[tuple[int, float, float, float]]] = []
        for at in range(0, len(texts), 256):
            part = texts.slice(at, 256)
            own: list[list[tuple[int, float, float, float]]] = [[] for _ in range(len(part))]
            for d, passages in self.screened(part).items():
                own[d] = self.matches(part[d].as_py(), passages)
            out += own
        return out


SCHEMA = "item_id long, bm25 double, question_overlap double, answer_overlap double"


def index_parts(items: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of all items, each of about ``limit`` bytes of text at most, weighed by all items."""
    items = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // limit))

    def part(p: int) -> list[tuple[int | None, str]]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else items
        return [(r["item_id"], r["text"]) for r in rows.collect()]

    if parts == 1:
        yield Index(part(0))
        return
    stats = Statistics()
    for p in range(parts):
        stats.add(part(p))
    for p in range(parts):
        yield Index(part(p), stats)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap of all verified matches."""
    found = None
    for index in index_parts(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in slices(batches):
                hits = sent.value.batch(b["text"])
                at = [k for k, h in enumerate(hits) for _ in h]
                rows = [x for h in hits for x in h]
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(at, pa.int64())), *[pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), *[pa.float64()] * 3))]], names=["doc_id", "item_id", "bm25", "question_overlap", "answer_overlap"])

        kind = dict(docs.dtypes)["doc_id"]
        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
        found = part if found is None else found.unionByName(part)
    return found


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_only(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item, judged row by row where they are read."""
    names = docs.columns
    plain, text = plainly_named(docs), names.index("text")
    for index in index_parts(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            for b in slices(batches):
                yield b.filter(pa.array([not h for h in sent.value.batch(b.column(text))], pa.bool_()))

        plain = plain.mapInArrow(run, plain.schema)
    return plain.toDF(*names)

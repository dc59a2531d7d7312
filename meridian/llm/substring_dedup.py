"""Substring dedup: words of long passages that an earlier document, or a reference, holds as well.

Both ways use suffix automata of reference shards through which documents are
streamed for their matching statistics: the longest match that ends at each
word.  Spans of matches of at least ``length`` words go.

Against a given reference (``remove_known_passages``): the reference is cut into
shards of bounded size, an automaton of each is broadcast, and every document is
streamed through each.  Consecutive shards overlap by ``length - 1`` words within a
text, so no match is cut.

Against the corpus itself (``duplicate_words``) that would cost documents times
shards, the square of the input.  So passages are first grouped by content
(``repeats``): runs of windows that share their sampled suffix meet, all copies of a run
are one class, and classes that may share windows form a shard.  A shard's
automaton takes them in the order of documents: every passage is streamed through
it for its matching statistics, then the words of its new windows are appended.  So
matches are with earlier documents only, on the words themselves.  (Only the
windows of a shard too large for one task are compared by hashes.)

Defined results: a null text has no words; texts shorter than a window are kept;
rows with a null doc_id are kept whole and remove nothing; rows that repeat a
doc_id remove nothing from each other, whether their texts are the same or not; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, table
from .repeats import Rule, covered, found_rows, groups_of, merged, placed, start_of, version_of, without_repeats
from .tokens import texts_of, words_of

LENGTH = 50
#: Words of the grams that choose the sampled suffixes.
GRAM = 12
#: Reference words in one automaton.
SHARD_WORDS = 200_000
_TABLE = bytes(32 if i in SEPARATORS else i for i in range(256))


def split(text: str | bytes | None) -> list[bytes]:
    """Words of a text as bytes."""
    data = text.encode() if isinstance(text, str) else text or b""
    return [w for w in data.translate(_TABLE).split(b" ") if w]


class SuffixAutomaton:
    """All substrings of several word sequences, in linear space."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = array("q", [-1])
        self.long = array("q", [0])
        self.last = 0

    def _state(self, long: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.long.append(long)
        self.link.append(link)
        return len(self.long) - 1

    def add(self, words: list[int]) -> None:
        """Append one sequence; matches never run from one sequence into the next."""
        self.last = 0
        for w in words:
            p = self.last
            q = self.next[p].get(w)
            if q is not None and self.long[q] == self.long[p] + 1:
                self.last = q
                continue
            cur = self._state(self.long[p] + 1, {}, 0) if q is None else -1
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p < 0:
                self.last = cur
                continue
            q = self.next[p][w]
            if self.long[q] != self.long[p] + 1:
                copy = self._state(self.long[p] + 1, dict(self.next[q]), self.link[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = copy
                    p = self.link[p]
                self.link[q] = copy
                q = copy
            if cur < 0:
                self.last = q
            else:
                self.link[cur] = q
                self.last = cur

    def matching(self, words: list[int]) -> Iterator[int]:
        """For each word, the length of the longest known sequence that ends there."""
        state = long = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                long = self.long[state]
            if w in self.next[state]:
                state = self.next[state][w]
                long += 1
            else:
                state = long = 0
            yield long


def shards(texts: Iterator[list[int]], length: int, size: int = SHARD_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata of at most about ``size`` words each."""
    held, auto = 0, SuffixAutomaton()
    for words in texts:
        for at in range(0, max(1, len(words) - length + 1), size):
            piece = words[at : at + size + length - 1]
            if held and held + len(piece) > size:
                yield auto
                held, auto = 0, SuffixAutomaton()
            auto.add(piece)
            held += len(piece)
    if held:
        yield auto


def word_codes(column: pa.Array) -> list[list[int]]:
    hashes, _, _, offsets = words_of(*texts_of(column))
    return [hashes[offsets[d] : offsets[d + 1]].tolist() for d in range(len(offsets) - 1)]


def remove_known_passages(docs: DataFrame, reference: DataFrame, length: int = LENGTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept: ``docs`` without passages of ``reference`` (text).

    One pass over ``docs`` for each shard; the reference comes to the driver one
    partition at a time.
    """
    spark = docs.sparkSession
    state = docs.select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone"))

    def parts() -> Iterator[list[int]]:
        for row in reference.where("text is not null").select("text").toLocalIterator():
            yield from word_codes(pa.array([row["text"]]))

    for auto in shards(parts(), length, shard_words):
        sent = spark.sparkContext.broadcast(auto)

        def run(batches, sent=sent):
            for b in batches:
                out = []
                for words, gone in zip(word_codes(b["text"]), b["gone"].to_pylist(), strict=True):
                    ends = [i + 1 for i, m in enumerate(sent.value.matching(words)) if m >= length]
                    out.append((gone or []) + ends)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text", "gone"])

        state = state.mapInArrow(run, state.schema)

    def finish(batches):
        for b in batches:
            n, removed, kept = [], [], []
            for text, ends in zip(b["text"].to_pylist(), b["gone"].to_pylist(), strict=True):
                words = split(text)
                at = np.array(ends or [], dtype=np.int64) - length
                gone = covered(len(words), placed(0, at, np.ones_like(at)), length)
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return state.mapInArrow(finish, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept string")


def earlier_windows(t: pa.Table, length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(doc, place, numbers) of the windows of a shard's passages, sorted by doc, that an earlier doc holds as well."""
    auto, codes = SuffixAutomaton(), {}
    docs, places, regions = (t[c].to_pylist() for c in ("doc", "place", "region"))
    fresh: list[list[int]] = []
    for k, (doc, place, region) in enumerate(zip(docs, places, regions, strict=True)):
        if k and docs[k - 1] != doc:
            for words in fresh:
                auto.add(words)
            fresh = []
        words = [codes.setdefault(w, len(codes)) for w in split(region)]
        hits = [i + 1 - length for i, m in enumerate(auto.matching(words)) if m >= length] if len(auto.long) > 1 else []
        if hits:
            yield doc, place, hits
        # What lies between known windows is new to the automaton.
        after = 0
        for hit in [*hits, len(words) - length + 1]:
            if hit > after:
                fresh.append(words[after : hit + length - 1])
            after = hit + 1


def compare_passages(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of word regions: one suffix automaton for each group."""
    for t in groups_of(batches):
        if t.num_rows < 2:
            continue
        doc, place = [], []
        for d, p, hits in earlier_windows(t, rule.length):
            p = np.int64(p)
            place.append(placed(version_of(p), start_of(p) + np.array(hits, dtype=np.int64), np.ones(len(hits), dtype=np.int64)))
            doc.append(np.full(len(hits), d, dtype=np.int64))
        if doc:
            yield found_rows(*merged(np.concatenate(doc), np.concatenate(place)))


def duplicate_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked, kept (the remaining words) of every row."""
    rule = Rule("words", length, max(min(gram, max(1, length // 2)), length - 1000), False, compare_passages)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")

    def finish(text: bytes, gone) -> tuple:
        words = split(text)
        mark = None if gone is None else gone(len(words))
        kept = b" ".join(words if mark is None else [w for w, g in zip(words, mark.tolist(), strict=True) if not g])
        return len(words), 0 if mark is None else int(mark.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep else [])

    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep else "")
    return without_repeats(rows, rule, finish, schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that start in an earlier document."""
    return duplicate_words(table(spark, sf_dir, "documents"), keep=False)


OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) AS s
      FROM d, LATERAL (SELECT unnest(range(1, CAST(len(ws) - 48 AS BIGINT))) AS i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM w) WHERE m < doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM f),
k AS (SELECT d.doc_id, u.j, d.ws[u.j] AS word
      FROM d, LATERAL (SELECT unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS j) u ANTI JOIN g ON g.doc_id = d.doc_id AND g.j = u.j),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(t.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

"""Finding equal windows of tokens over a whole corpus: a sparse suffix array.

Used for bytes (suffix-array dedup) and for words (substring dedup).  Comparing
every suffix would move a hundred times the corpus, so suffixes are sampled so
that nothing can be missed: a window of ``length`` tokens is represented by the
suffix that starts at its smallest ``gram``-token hash (leftmost on ties).  Equal
windows choose the same place, so they meet in the order of the sampled suffixes.
Neighbouring windows mostly share their suffix; such a run is one record:

    lead          leading tokens of the suffix (24 bits), then the hash of its first tokens (40 bits)
    context       hash of all tokens of the run's windows
    doc, place    where the run starts, how many windows it has, and which text of the doc it is

1.  Records are range-partitioned by sampled splitters on all four.  Each bucket sorts
    its records with a multikey quicksort and compares neighbours: records of one
    context are equal window by window, so all but the first are repeats.  A
    context is 62 bits of two polynomials modulo a prime (see ``tokens``).
2.  A lead with several contexts leaves the first record of each as candidates.  These
    come together by lead again, now with their tokens, and are compared token by
    token (``Rule.compare``): suffixes sorted to the window's length, or suffix automata.
3.  A lead with more than ``GROUP`` windows would make too large a group: its windows
    are range-partitioned by their hashes (62 and 64 bits), sorted and compared in
    the same way, also across bucket boundaries.  Doc and place belong to the
    order, so a group as large as a third of all rows spreads over many buckets.

Rows of one doc with different texts are told apart by 22 bits of a hash of the
text.  Only smaller docs, and (if the rule says so) the same row, count as earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IdFilter, dropped, shuffle_parts, trim, written
from .tokens import BYTES, CHUNK, Sums, U, byte_streams, chunks, gram_hashes, mix, packed, slices, texts_of, unpack, unpacked, word_bounds, word_streams, words_of

#: Buckets for each input partition: one is sorted in memory.
BUCKETS = 3
#: Windows of one lead that are compared in one task; windows of a larger one are dealt anew.
GROUP = 50_000
#: Windows sorted at a time in a bucket of small groups.
SORTED = 500_000
#: Documents sampled for each bucket's splitter, and the part of their records that is used.
SAMPLED_DOCS, SAMPLED_PART = 64, 1 / 32
#: A place holds, from the highest bits: the text's version, the start of a run, its windows less one.
_BITS, _START = 10, 31
_PLACE = U((1 << 20) - 1)


def start_of(place: np.ndarray) -> np.ndarray:
    return (place >> _BITS) & ((1 << _START) - 1)


def windows_of(place: np.ndarray) -> np.ndarray:
    return (place & ((1 << _BITS) - 1)) + 1


def version_of(place: np.ndarray) -> np.ndarray:
    return place >> (_BITS + _START)


def placed(version: np.ndarray | int, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (version << (_BITS + _START)) | (start << _BITS) | (windows - 1)


def text_version(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 22) - 1))


@dataclass(frozen=True)
class Rule:
    """Which tokens, how long a window and its sampling gram are, which repeats count, and how groups are compared."""

    unit: str  # "bytes" or "words"
    length: int
    gram: int
    within_doc: bool  # a window repeated in its own document counts as well
    compare: Callable  # (rule, batches of (lead, doc, place, region) sorted by the first three) to (doc, place) of repeats

    def __post_init__(self) -> None:
        if not self.gram <= self.length < self.gram + (1 << _BITS):
            raise ValueError(f"windows of {self.length} tokens cannot be sampled by grams of {self.gram}")

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Raw tokens and bounds by document: bytes, or word hashes."""
        data, bounds = texts_of(column)
        if self.unit == "bytes":
            return data, bounds
        hashes, _, _, offsets = words_of(data, bounds)
        return hashes, offsets

    def sampling(self, raw: np.ndarray) -> np.ndarray:
        return BYTES[raw] if self.unit == "bytes" else raw

    def streams(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return byte_streams(raw) if self.unit == "bytes" else word_streams(raw)

    def lead(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leading tokens in their order: three bytes, or 24 bits of the first word's hash."""
        if self.unit == "words":
            return raw[at] >> U(40)
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(3):
            out = (out << U(8)) | raw[at + j].astype(np.uint64)
        return out


def sampled_runs(rule: Rule, raw: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lead, context, text number, start, windows) of the runs of one piece."""
    length, k = rule.length, rule.gram
    n, span = len(raw), length - k + 1
    long = np.flatnonzero(np.diff(within) >= length)
    if not len(long):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    grams = gram_hashes(rule.sampling(raw), k)
    low, have = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    mark = np.zeros(n + 1, dtype=np.int8)
    mark[within[long]] += 1
    mark[within[long + 1] - length + 1] -= 1
    windows = np.flatnonzero(np.cumsum(mark[:n], dtype=np.int8))
    anchors = (low[windows] & _PLACE).astype(np.int64)
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (np.diff(windows) != 1) | (np.diff(anchors) != 0)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(windows)))
    start, anchor = windows[first], anchors[first]
    context = Sums(rule.streams(raw)).of(start, start + counts - 1 + length)
    lead = (rule.lead(raw, anchor) << U(40)) | (grams[anchor] >> U(24))
    return (lead ^ U(1 << 63)).view(np.int64), context.view(np.int64), np.searchsorted(within, start, "right") - 1, start, counts


RUNS = "lead long, context long, doc long, place long"
_NAMES = ["lead", "context", "doc", "place"]


def run_arrays(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """lead, context, doc and place of the runs of (doc, version, text)."""
    for b in slices(batches):
        raw, bounds = rule.tokens(b["text"])
        ids, versions = np.asarray(b["doc"]), np.asarray(b["version"])
        for at, end, numbers, within, base in chunks(bounds, rule.length):
            lead, context, number, start, count = sampled_runs(rule, raw[at:end], within)
            if len(lead):
                yield [lead, context, ids[numbers[number]], placed(versions[numbers[number]], start - within[number] + base[number], count)]


def rank_among(splits: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted splitters (key by key) are not above each row."""
    low, high = np.searchsorted(splits[0], rows[0], "left"), np.searchsorted(splits[0], rows[0], "right")
    if len(splits) == 1:
        return high
    tied, out = np.flatnonzero(high > low), low.copy()
    for at in np.unique(low[tied]).tolist():
        own = tied[low[tied] == at]
        out[own] += rank_among([s[at : high[own[0]]] for s in splits[1:]], [r[own] for r in rows[1:]])
    return out


def splitters(rule: Rule, docs: DataFrame, n: int) -> list[np.ndarray]:
    """At most n - 1 splitters of the records, from those of sampled documents.

    They decide how even the buckets are, never the result.
    """
    total = max(docs.count(), 1)
    share = SAMPLED_DOCS * n / total
    some = docs.where(F.pmod(F.xxhash64("doc", "version"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    part = U(int(min(1.0, SAMPLED_PART * max(1.0, share)) * (1 << 32)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in run_arrays(rule, batches):
            keep = mix(cols[2].view(np.uint64) * U(0x9E3779B97F4A7C15) + cols[3].view(np.uint64)) >> U(32) < part
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=_NAMES)

    t = some.mapInArrow(emit, RUNS).toArrow()
    order, _ = multikey_order(t.num_rows, [lambda at, c=np.asarray(t[c]): c[at] for c in _NAMES])
    cut = order[np.arange(1, n) * t.num_rows // n] if t.num_rows else order
    return [np.asarray(t[c])[cut] for c in _NAMES]


def runs(docs: DataFrame, rule: Rule, n: int) -> DataFrame:
    """One record for each run of windows of ``docs`` (doc, version, text), in n buckets."""
    sent = docs.sparkSession.sparkContext.broadcast(splitters(rule, docs, n))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in run_arrays(rule, batches):
            bucket = rank_among(sent.value, cols) if len(sent.value[0]) else np.zeros(len(cols[0]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *[pa.array(c) for c in cols]], names=["bucket", *_NAMES])

    return docs.mapInArrow(emit, "bucket int, " + RUNS).repartitionById(n, F.col("bucket")).select(*_NAMES)


def multikey_order(n: int, keys: list[Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The order of n rows by several keys (of the rows asked for), and where a new value begins in it.

    Rows are sorted by a key only as long as they are tied in all keys before.
    """
    order, new = np.arange(n), np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        group, values = np.cumsum(new)[tied], key(order[tied])
        o = np.lexsort((values, group)) if group[0] != group[-1] else np.argsort(values, kind="stable")
        order[tied], values = order[tied][o], values[o]
        differ = np.ones(len(tied), dtype=bool)
        differ[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
        new[tied] |= differ
    return order, new


def repeats_among(rule: Rule, doc: np.ndarray, place: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of sorted rows also occur earlier, given where a new content begins; and the first row of each content."""
    at = np.arange(len(doc))
    first = np.maximum.accumulate(np.where(equal, at, 0))
    repeat = doc != doc[first]
    if rule.within_doc:
        version = version_of(place)
        own = equal.copy()
        own[1:] |= (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
        repeat |= place != place[np.maximum.accumulate(np.where(own, at, 0))]
    return repeat, first


def gathered(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """The columns of a bucket as arrays."""
    held = list(batches)
    if not held:
        return []
    trim()
    return [np.concatenate([np.asarray(b.column(c)) for b in held]) for c in range(held[0].num_columns)]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new value of the keys begins in sorted rows."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


PIECES = "doc long, place long, lead long, kind int"


def compare_runs(rule: Rule) -> Callable:
    """Per bucket: repeats (kind 1) and candidates (kind 2, with their lead)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = gathered(batches)
        if not cols or not len(cols[0]):
            return
        order, _ = multikey_order(len(cols[0]), [lambda at, c=c: c[at] for c in cols])
        lead, context, doc, place = (c[order] for c in cols)
        group, equal = starts_of(lead), starts_of(lead, context)
        repeat, _ = repeats_among(rule, doc, place, equal)
        number = np.cumsum(group) - 1
        several = np.bincount(number, weights=equal) > 1
        # A bucket's first and last groups may go on beyond its boundaries.
        several[[0, -1]] = True
        # Equal rows of documents leave equal records: one is enough.
        single = starts_of(lead, context, doc, place)
        keep = np.flatnonzero((repeat | several[number]) & single)
        kind = np.where(repeat[keep], 1, 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(place[keep]), pa.array(np.where(kind == 1, 0, lead[keep])), pa.array(kind)], names=["doc", "place", "lead", "kind"])

    return emit


def spans_of(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets by row and the flat values of a list column."""
    offsets = np.asarray(b[column].offsets)
    return offsets - offsets[0], b[column].flatten()


def regions(rule: Rule, leads: np.ndarray) -> Callable:
    """Per text with candidates: (bucket, lead, doc, place, region), the region being all tokens of a run as bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, ids = [unpack(x) or b"" for x in b["packed"].to_pylist()], np.asarray(b["doc"])
            offsets, flat = spans_of(b, "spans")
            places, found = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            for d, text in enumerate(texts):
                place, lead = places[offsets[d] : offsets[d + 1]], found[offsets[d] : offsets[d + 1]]
                first = start_of(place)
                last = first + windows_of(place) - 2 + rule.length
                if rule.unit == "words":
                    starts, ends, _ = word_bounds(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
                    ok = last < len(starts)
                    first, last = starts[first[ok]], ends[last[ok]]
                else:
                    ok = last < len(text)
                    first, last = first[ok], last[ok] + 1
                place, lead = place[ok], lead[ok]
                for at in range(0, len(place), 4096):
                    part = slice(at, at + 4096)
                    blobs = pa.array([text[a:z] for a, z in zip(first[part].tolist(), last[part].tolist(), strict=True)], pa.binary())
                    bucket = np.searchsorted(leads, lead[part], "right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(lead[part]), pa.array(np.full(len(blobs), ids[d])), pa.array(place[part]), blobs], names=["bucket", "lead", "doc", "place", "region"])

    return emit


REGIONS = "bucket int, lead long, doc long, place long, region binary"


def groups_of(batches: Iterator[pa.RecordBatch], column: str = "lead") -> Iterator[pa.Table]:
    """The rows of one value of the (sorted) column after the other."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        values = np.asarray(b[column])
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[at] != current:
                yield pa.Table.from_batches(held)
                held = []
            current = values[at]
            held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def found_rows(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int64))], names=["doc", "place"])


def merged(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows in any order, neighbours of one text as one place (of up to 1,024 windows)."""
    if not len(doc):
        return doc, place
    o = np.lexsort((place, doc))
    doc, place = doc[o], place[o] >> _BITS
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    # Longer runs are cut; repeated windows (of repeated rows) count once.
    since = place - np.repeat(place[first], np.diff(np.append(first, len(doc))))
    new[1:] |= since[1:] >> _BITS != since[:-1] >> _BITS
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], (place[first] << _BITS) | (place[last] - place[first])


def compare_suffixes(rule: Rule, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of byte regions: every window is a suffix, sorted by multikey quicksort on eight bytes at a time."""

    def settle(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables).combine_chunks()
        lead, doc, place = (np.asarray(t[c]) for c in ("lead", "doc", "place"))
        data, bounds = texts_of(t["region"])
        count = windows_of(place)
        row = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = bounds[row] + step
        words = np.lib.stride_tricks.sliding_window_view(data, 8)

        def eight(depth: int) -> Callable:
            return lambda rows: np.ascontiguousarray(words[at[rows] + depth]).view(">u8")[:, 0].astype(np.uint64)

        depths = [*range(0, rule.length - 7, 8), *([rule.length - 8] if rule.length % 8 else [])]
        group = np.cumsum(starts_of(lead))[row]
        order, new = multikey_order(len(row), [lambda rows: group[rows], *map(eight, depths)])
        whole = doc[row][order], placed(version_of(place), start_of(place), np.ones_like(place))[row][order] + (step[order] << _BITS)
        repeat, _ = repeats_among(rule, *whole, new)
        return found_rows(*merged(whole[0][repeat], whole[1][repeat]))

    held, n = [], 0
    for t in groups_of(batches):
        if t.num_rows > 1:
            held.append(t)
            n += int(windows_of(np.asarray(t["place"])).sum())
        if n >= SORTED:
            yield settle(held)
            held, n = [], 0
    if held:
        yield settle(held)


def window_hashes(rule: Rule) -> Callable:
    """Per text with candidates: (lead, rest, doc, place) of their windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw, bounds = rule.tokens(unpacked(b["packed"]))
            offsets, flat = spans_of(b, "spans")
            places, ids = np.asarray(flat.field(0)), np.asarray(b["doc"])
            for d in range(len(ids)):
                place = np.sort(places[offsets[d] : offsets[d + 1]])
                own = raw[bounds[d] : bounds[d + 1]]
                s, c = start_of(place), windows_of(place)
                place, s, c = (x[s + c - 1 + rule.length <= len(own)] for x in (place, s, c))
                at = 0
                while at < len(s):
                    stop = max(at + 1, int(np.searchsorted(s, s[at] + CHUNK // 2, "right")))
                    base, end = int(s[at]), int((s[at:stop] + c[at:stop]).max()) + rule.length - 1
                    reps = c[at:stop]
                    w = np.repeat(s[at:stop] - base - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
                    lead = Sums(rule.streams(own[base:end])).of(w, w + rule.length)
                    rest = gram_hashes(rule.sampling(own[base:end]), rule.length)[w]
                    where = placed(version_of(place[0]), w + base, np.ones_like(w))
                    yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(np.full(len(w), ids[d])), pa.array(where)], names=["lead", "rest", "doc", "place"])
                    at = stop

    return emit


FLAGS = "doc long, place long, kind int, bucket long, lead long, rest long"


def compare_windows(rule: Rule) -> Callable:
    """Per bucket: repeated windows (kind 1), those its boundary leaves open (kind 3), and the boundary itself (kind 4, 5)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = gathered(batches)
        if not cols or not len(cols[0]):
            return
        bucket = TaskContext.get().partitionId()
        order, _ = multikey_order(len(cols[0]), [lambda at, c=c: c[at] for c in cols])
        lead, rest, doc, place = (c[order] for c in cols)
        repeat, first = repeats_among(rule, doc, place, starts_of(lead, rest))
        out = []
        for mask, kind in ((repeat, 1), (~repeat & (first == 0), 3)):
            d, p = merged(doc[mask], place[mask])
            none = np.zeros(len(d), np.int64)
            out.append((d, p, np.full(len(d), kind, np.int32), np.full(len(d), bucket, np.int64), none, none))
        ends = [0, first[-1]]
        out.append((doc[ends], place[ends], np.array([4, 5], np.int32), np.full(2, bucket, np.int64), lead[ends], rest[ends]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc", "place", "kind", "bucket", "lead", "rest"])

    return emit


def repeated_in_large_groups(texts: DataFrame, rule: Rule, n: int, held: list[str]) -> DataFrame:
    """(doc, place) of the repeated windows of candidates (doc, packed, spans) whose groups are too large for one task."""
    spark = texts.sparkSession
    windows = texts.mapInArrow(window_hashes(rule), "lead long, rest long, doc long, place long")
    flags = written(windows.repartitionByRange(n, "lead", "rest", "doc", "place").mapInArrow(compare_windows(rule), FLAGS), "windows", held)
    found = flags.where("kind = 1").select("doc", "place")
    # Two boundary rows for each bucket: compare each bucket's first window with the one before.
    edges = sorted(flags.where("kind >= 4").collect(), key=lambda r: (r["bucket"], r["kind"]))
    goes_on, at = [], None  # at: key, doc and version of the first of the last group so far
    for head, tail in zip(edges[::2], edges[1::2], strict=True):
        key = (head["lead"], head["rest"])
        joined = at is not None and at[0] == key
        if joined:
            goes_on.append((head["bucket"], at[1], at[2]))
        if (tail["lead"], tail["rest"]) != key or not joined:
            at = ((tail["lead"], tail["rest"]), tail["doc"], tail["place"])
    if goes_on:
        open_ = spark.createDataFrame(goes_on, "bucket long, f_doc long, f_place long")
        later = F.col("doc") != F.col("f_doc")
        if rule.within_doc:
            version = lambda c: F.shiftright(c, _BITS + _START)
            later = later | ((version("place") == version("f_place")) & (F.shiftright("place", _BITS) != F.shiftright("f_place", _BITS)))
        found = found.unionByName(flags.where("kind = 3").join(F.broadcast(open_), "bucket").where(later).select("doc", "place"))
    return found


def packed_texts(docs: DataFrame, only: IdFilter | None = None) -> DataFrame:
    """(doc, version, packed): texts compressed for the shuffles that must carry them, of the ids that ``only`` holds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if only is not None:
                b = b.filter(pa.array(only.holds(np.asarray(b["doc"]))))
            blobs = [packed(t) for t in b["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc"], b["version"], pa.array(blobs, pa.binary())], names=["doc", "version", "packed"])

    return docs.select("doc", "version", "text").mapInArrow(emit, "doc long, version long, packed binary")


def with_texts(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, packed, spans) of the texts that have candidates (doc, place, lead)."""
    version = F.shiftright("place", _BITS + _START)
    spans = candidates.groupBy("doc", version.alias("version")).agg(F.collect_list(F.struct("place", "lead")).alias("spans"))
    return spans.join(packed_texts(docs, IdFilter(candidates, "doc")).dropDuplicates(["doc", "version"]), ["doc", "version"]).select("doc", "packed", "spans")


def repeated_windows(docs: DataFrame, rule: Rule, held: list[str]) -> DataFrame:
    """(doc, place): all windows of ``docs`` (doc, version, text) that also start earlier."""
    spark = docs.sparkSession
    n = max(shuffle_parts(spark), BUCKETS * docs.rdd.getNumPartitions())
    pieces = written(runs(docs, rule, n).mapInArrow(compare_runs(rule), PIECES), "runs", held)
    found = pieces.where("kind = 1").select("doc", "place")
    candidates = pieces.where("kind = 2").select("doc", "place", "lead")
    count = F.col("place").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    large = written(candidates.groupBy("lead").agg(F.sum(count).alias("n")).where(F.col("n") > GROUP).select("lead"), "large", held)
    if not large.isEmpty():
        found = found.unionByName(repeated_in_large_groups(with_texts(written(candidates.join(large, "lead", "left_semi"), "hot", held), docs), rule, n, held))
        candidates = written(candidates.join(large, "lead", "left_anti"), "cold", held)
    cuts = candidates.agg(F.percentile_approx("lead", [k / n for k in range(1, n)], 100 * n).alias("p")).first()["p"] if n > 1 else None
    leads = np.unique(np.array(cuts or [], dtype=np.int64))
    near = with_texts(candidates.select("doc", "place", "lead"), docs).mapInArrow(regions(rule, leads), REGIONS)
    near = near.repartitionById(n, F.col("bucket")).select("lead", "doc", "place", "region").sortWithinPartitions("lead", "doc", "place")
    compare = rule.compare
    return found.unionByName(near.mapInArrow(lambda batches: compare(rule, batches), "doc long, place long"))


def without_repeats(docs: DataFrame, rule: Rule, finish: Callable, schema: str) -> DataFrame:
    """``finish(bytes, gone)`` of every row of ``docs`` (doc, text), as rows (doc_id, *result).

    ``gone(n)`` marks which of a text's n tokens go, None where none do.  Only texts
    that may have some are shuffled.
    """
    held: list[str] = []
    docs = docs.withColumn("version", text_version(F.col("text")))
    found = repeated_windows(docs.where("doc is not null"), rule, held)
    version = F.shiftright("place", _BITS + _START)
    spans = written(found.groupBy("doc", version.alias("version")).agg(F.collect_list("place").alias("places")), "spans")
    dropped(docs.sparkSession, held)
    some = IdFilter(spans, "doc")
    names = [x.split()[0] for x in schema.split(",")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(x.split()[0], kinds[x.split()[1]]) for x in schema.split(",")]

    def rows(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)] if out else [pa.array([], f.type) for f in fields]
        return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *names])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b["doc"]
            none = pa.array(~some.holds(np.asarray(ids.fill_null(0).cast(pa.int64())).copy()) | np.asarray(ids.is_null()))
            b = b.filter(none)
            yield rows(b["doc"], [finish(t or b"", None) for t in b["text"].cast(pa.binary()).to_pylist()])

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, flat = spans_of(b, "places")
            flat, out = np.asarray(flat), []
            for d, text in enumerate(b["packed"].to_pylist()):
                own = flat[offsets[d] : offsets[d + 1]]
                out.append(finish(unpack(text) or b"", (lambda n, own=own: covered(n, own, rule.length)) if len(own) else None))
            yield rows(b["doc"], out)

    joined = packed_texts(docs.where("doc is not null"), some).join(spans, ["doc", "version"], "left").select("doc", "packed", "places")
    return docs.select("doc", "text").mapInArrow(untouched, f"doc_id long, {schema}").unionByName(joined.mapInArrow(touched, f"doc_id long, {schema}"))


def covered(n: int, places: np.ndarray, length: int) -> np.ndarray:
    """Which of n tokens lie in a window of the places."""
    mark = np.zeros(n + 1, dtype=np.int64)
    s = start_of(places)
    np.add.at(mark, np.minimum(s, n), 1)
    np.add.at(mark, np.minimum(s + windows_of(places) - 1 + length, n), -1)
    return np.cumsum(mark[:n]) > 0

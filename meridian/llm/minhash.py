"""Near-duplicate groups by MinHash, banding, verification and star contraction.

1.  Every text gives its set of five-word shingles (64-bit hashes), the set's
    identity, and ``BANDS * ROWS`` minima of universal hashes a x + b.
2.  Equal sets are one class from here on, whatever their number.
3.  A band is the hash of ``ROWS`` minima.  At a similarity of 0.75 two sets miss
    each other in all 40 bands of 4 with a probability of 3e-7.
4.  In each bucket every class meets the smallest id of its salted part, and those
    meet the bucket's smallest: as many pairs as rows, however large the bucket.
    Pairs are verified, first by their signatures, then on the full sets.
5.  Connected components by alternating large-star and small-star.
6.  Buckets that still hold several components are compared across components by
    their signatures, so that no link is lost: all rows outside a bucket's largest
    component with each other and with those inside, in blocks of bounded size.  Rows
    with such a pair come together with their texts, pairs are verified on the full
    sets until their components are joined, and components are contracted again.
7.  A bucket with more rows outside its largest component than a block holds (texts
    around one template, say) is not compared as it stands.  Its rows are dealt anew by
    the rarest quarter of their shingles: sets of a similarity of 0.75 or more
    share one of those, whatever else they share (prefix filtering), so no pair is lost
    here (the screen by signatures follows as ever), and a template's own shingles, which bring all of them together, are left out.

Links are confirmed on full sets only: 100 * intersection >= 75 * union.  A shingle
stands in them as 62 bits of two polynomials modulo a prime (see ``tokens``).

Defined results: texts that are null or have no word have an empty set and are
linked with nothing; rows with a null doc_id get no component and are kept;
repeated rows of one doc_id share its result; rows of one doc_id with different sets
are nodes of their own, each linked by its own text; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IdFilter, dropped, plainly_named, table, written
from .repeats import packed_texts
from .tokens import Sums, chunks, mix, slices, texts_of, unpack, unpacked, word_streams, words_of

SHINGLE = 5
BANDS, ROWS = 40, 4
SIMILAR = (75, 100)
#: A pair of similarity 0.75 has an estimate under this with a probability of 1e-5 or less.
LEAST_ESTIMATE = 0.6
SALTS = 16
#: Rows of a bucket compared with each other in one task.
BLOCK = 4096
_rng = np.random.RandomState(7)
_A = _rng.randint(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.randint(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and their bounds."""
    data, bounds = texts_of(column)
    hashes, _, _, words = words_of(_LOWER[data], bounds)
    n = len(words) - 1
    parts: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    for at, end, numbers, within, base in chunks(words, SHINGLE):
        sums = Sums(word_streams(hashes[at:end]))
        sizes = np.diff(within)
        count = end - at
        every = sums.of(slice(0, count - SHINGLE + 1), slice(SHINGLE, count + 1)) if count >= SHINGLE else np.zeros(0, np.uint64)
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        whole = sums.of(within[short], within[short + 1])
        for j, h in zip(short, whole, strict=True):
            if base[j] == 0:
                parts[numbers[j]] = h[None]
        for j in np.flatnonzero(sizes >= SHINGLE):
            got = np.unique(every[within[j] : within[j + 1] - SHINGLE + 1])
            d = numbers[j]
            parts[d] = np.union1d(parts[d], got) if len(parts[d]) else got
    out = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if n else np.zeros(0, np.uint64)), out


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of every hash over every set (rows of empty sets are meaningless)."""
    n = len(bounds) - 1
    out = np.full((BANDS * ROWS, n), np.uint32(0xFFFFFFFF))
    x = mix(sets.copy()).astype(np.uint32)
    d = 0
    while d < n:
        stop = max(d + 1, int(np.searchsorted(bounds, bounds[d] + 65536, "right")) - 1)
        for lo in range(int(bounds[d]), int(bounds[stop]), 1 << 17):
            hi = min(lo + (1 << 17), int(bounds[stop]))
            own = np.flatnonzero((bounds[d + 1 : stop + 1] > lo) & (bounds[d:stop] < hi) & (bounds[d + 1 : stop + 1] > bounds[d:stop])) + d
            at = np.maximum(bounds[own], lo) - lo
            part = x[lo:hi]
            for i in range(BANDS * ROWS):
                low = np.minimum.reduceat(part * _A[i] + _B[i], at)
                out[i, own] = np.minimum(out[i, own], low)
        d = stop
    # Sixteen mixed bits of a minimum do for comparing them.
    return ((out.T * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def identity(one: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = int(np.bitwise_xor.reduce(mix(one + np.uint64(1)))) if len(one) else 0
    b = int(mix(one * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) if len(one) else 0
    return a - (1 << 64) if a >= 1 << 63 else a, b - (1 << 64) if b >= 1 << 63 else b


FEATURES = "doc long, th long, n long, s1 long, s2 long, signature binary"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        if part.num_rows:
            sets, bounds = shingle_sets(part["text"])
            sizes = np.diff(bounds)
            sig = signatures(sets, bounds)
            ids = [identity(sets[bounds[d] : bounds[d + 1]]) for d in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [part["doc"], part["th"], pa.array(sizes), pa.array([i for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64()), pa.array([s.tobytes() if n else None for s, n in zip(sig, sizes, strict=True)], pa.binary())],
                names=["doc", "th", "n", "s1", "s2", "signature"],
            )


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, band, doc) for each band of each row."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b["signature"].to_pylist()), dtype=np.uint16).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
        key = np.full((b.num_rows, BANDS), np.uint64(0)) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        band = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(np.asarray(b["doc"]), BANDS))], names=["key", "band", "doc"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in ("x", "y"))
            keep = pa.array(estimate(x, y) >= LEAST_ESTIMATE)
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar on their full sets."""
    last: dict[int, np.ndarray] = {}

    def full(doc: int, blob: bytes) -> np.ndarray:
        if doc not in last:
            if len(last) > 64:
                last.clear()
            last[doc] = shingle_sets(pa.array([unpack(blob)], pa.binary()))[0]
        return last[doc]

    for b in batches:
        keep = []
        for i, j, x, y in zip(*(b[c].to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            s, t = full(i, x), full(j, y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(SIMILAR[1] * both >= SIMILAR[0] * (len(s) + len(t) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], names=["a", "b"])


def texts_for(docs: DataFrame, ids: DataFrame, held: list[str]) -> DataFrame:
    """(doc, packed) of the ids (doc), one row each."""
    return written(packed_texts(docs, IdFilter(ids, "doc")).select("doc", "packed").join(ids, "doc", "left_semi").dropDuplicates(["doc"]), "texts", held)


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, held: list[str]) -> DataFrame:
    """The pairs (a, b) that are links: by signature, then on the full sets."""
    sig = classes.select("doc", "signature")
    pairs = pairs.join(sig.select(F.col("doc").alias("a"), F.col("signature").alias("x")), "a").join(sig.select(F.col("doc").alias("b"), F.col("signature").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(likely, "a long, b long")
    pairs = written(pairs, "pairs", held)
    texts = texts_for(docs, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), held)
    whole = pairs.join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("y")), "b").join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("x")), "a")
    return written(whole.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links", held)


def star_pairs(keys: DataFrame) -> DataFrame:
    """In each bucket: every row with the least of its salted part, and those with the least of all."""
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    parts = salted.groupBy("key", "salt").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n"))
    heads = parts.withColumn("least", F.min("low").over(Window.partitionBy("key")))
    upper = heads.where("low <> least").select(F.col("least").alias("a"), F.col("low").alias("b"))
    lower = salted.join(parts.where("n > 1").select("key", "salt", "low"), ["key", "salt"]).where("doc <> low").select(F.col("low").alias("a"), F.col("doc").alias("b"))
    return upper.union(lower).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc, component) of every node with an edge; the component is its least node.

    Large-star and small-star alternate until nothing changes; every round is
    written, so the lineage stays short and survives lost executors.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def mark(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("doc")).agg(F.min("v").alias("component"))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (key, i, j) after the other; the batches are sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        keys = [np.asarray(b[c]) for c in ("key", "i", "j")]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if b.num_rows else []
        for at, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if end > at:
                name = tuple(int(k[at]) for k in keys)
                if name != current and held:
                    yield pa.Table.from_batches(held)
                    held = []
                current = name
                held.append(b.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def open_pairs(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For a bucket: each row with the rows of other components that it may be linked to.

    A pair counts in the first band that it shares, so that other buckets needn't look at it.
    """
    comp, side, band = np.asarray(t["component"]), np.asarray(t["side"]), t["band"][0].as_py()
    sig = np.frombuffer(b"".join(t["signature"].to_pylist()), dtype=np.uint16).reshape(t.num_rows, -1)
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        some = right[(comp[right] != comp[i]) & (((side[right] == 1) | (right > i)) if side[i] == 2 else True)]
        for step in (40, sig.shape[1]):
            some = some[estimate(sig[some, :step], sig[i, :step]) >= (LEAST_ESTIMATE if step > 40 else 0.35)]
        if band and len(some):
            before = (sig[some, : band * ROWS] == sig[i, : band * ROWS]).reshape(len(some), band, ROWS).all(2).any(1)
            some = some[~before]
        if len(some):
            yield int(i), some


def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket whose sets must be compared: (key, i, j, doc)."""
    for t in groups(batches):
        mark = np.zeros(t.num_rows, dtype=bool)
        for i, some in open_pairs(t):
            mark[i] = True
            mark[some] = True
        if mark.any():
            keep = t.filter(pa.array(mark)).combine_chunks().to_batches()
            yield from (x.select(["key", "band", "i", "j", "side", "doc", "component", "signature"]) for x in keep)


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between components of a bucket, verified on full sets; those that join nothing new are left out."""
    for t in groups(batches):
        comp = t["component"].to_pylist()
        root: dict[int, int] = {c: c for c in comp}

        def top(c: int, root=root) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        texts, full, out = t["packed"], {}, []

        def words(k: int, full=full, texts=texts) -> np.ndarray:
            if k not in full:
                full[k] = shingle_sets(pa.array([unpack(texts[k].as_py())], pa.binary()))[0]
            return full[k]

        doc = t["doc"].to_pylist()
        for i, some in open_pairs(t):
            for k in some.tolist():
                if top(comp[i]) == top(comp[k]):
                    continue
                s, u = words(i), words(k)
                if SIMILAR[1] * min(len(s), len(u)) < SIMILAR[0] * max(len(s), len(u)):
                    continue
                both = len(np.intersect1d(s, u, assume_unique=True))
                if SIMILAR[1] * both >= SIMILAR[0] * (len(s) + len(u) - both):
                    out.append((doc[i], doc[k]))
                    root[top(comp[i])] = top(comp[k])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def open_buckets(labelled: DataFrame) -> DataFrame:
    """key, main, blocks, pieces of the buckets with several components; ``main`` is the largest one of a bucket of several blocks."""
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).where("n > top.c")
    large, up = F.col("n") > BLOCK, lambda c: F.ceil(c / BLOCK).cast("int")
    return sizes.select("key", F.when(large, F.col("top.component")).alias("main"), F.when(large, up(F.col("n") - F.col("top.c"))).otherwise(1).alias("blocks"), F.when(large, up(F.col("top.c"))).otherwise(0).alias("pieces"))


def dealt(labelled: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The rows of buckets with several components, once for each block (key, i, j) in which they must be compared.

    A bucket of up to ``BLOCK`` rows is one block.  In others, rows outside the largest
    component meet each other in blocks (i, j), i <= j, and the pieces of those
    inside, numbered -1, -2, ..., in blocks (i, -piece).  Side 0 meets side 1; rows of
    side 2 meet each other.  ``more`` (doc, ...) adds columns.
    """
    open_ = open_buckets(labelled)
    rows = labelled.join(open_, "key")
    rows, names = (rows, []) if more is None else (rows.join(more, "doc"), [c for c in more.columns if c != "doc"])
    h = F.xxhash64("doc")
    rows = rows.withColumns({"mine": F.pmod(h, F.col("blocks")).cast("int"), "piece": (-1 - F.pmod(h, F.greatest(F.col("pieces"), F.lit(1)))).cast("int")})
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    blocks, mine = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("mine")
    pieces = F.when(F.col("pieces") > 0, F.sequence(F.lit(1), F.col("pieces"))).otherwise(F.array().cast("array<int>"))
    among = F.transform(blocks, lambda o: at(F.least(mine, o), F.greatest(mine, o), F.when(mine == o, 2).when(mine < o, 0).otherwise(1)))
    outside = F.concat(among, F.transform(pieces, lambda p: at(mine, -p, 0)))
    inside = F.transform(blocks, lambda o: at(o, F.col("piece"), 1))
    places = F.when(F.col("component") == F.col("main"), inside).otherwise(outside)
    return rows.withColumn("at", F.explode(places)).select("key", "band", "at.i", "at.j", "at.side", "doc", "component", *names)


#: Counters of shingles by hash: they only order the shingles of a set, so their number doesn't grow with the rows.
COUNTERS = 1 << 20


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many sets have a shingle of each counter."""
    seen = np.zeros(COUNTERS, dtype=np.int64)
    for b in slices(batches, 64, 1 << 20):
        sets, _ = shingle_sets(unpacked(b["packed"]))
        np.add.at(seen, counter_of(sets), 1)
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["counter", "n"])


def rarest(one: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order (count, shingle): two sets that are similar enough have one of these in common.

    Of n shingles at least ceil(0.75 n) are shared with any such set, so not all of the first n - ceil(0.75 n) + 1
    of the common order can be missing from it; the first shared one is in both prefixes.
    """
    n = len(one)
    return one[np.lexsort((one, seen[counter_of(one)]))[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1]]


def prefix_keys(texts: DataFrame) -> DataFrame:
    """(key, band, doc) of the rarest shingles of texts (doc, packed); keys of one row are left out."""
    counts = texts.mapInArrow(count_shingles, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(COUNTERS, dtype=np.int64)
    seen[np.asarray(counts["counter"])] = np.asarray(counts["n"])
    sent = texts.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64, 1 << 20):
            sets, bounds = shingle_sets(unpacked(b["packed"]))
            for doc, at, end in zip(b["doc"].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                keys = mix(rarest(sets[at:end], sent.value)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.zeros(len(keys), np.int32)), pa.array(np.full(len(keys), doc, np.int64))], names=["key", "band", "doc"])

    keys = texts.mapInArrow(run, "key long, band int, doc long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keys.join(shared, "key")


def compared(labelled: DataFrame, classes: DataFrame, docs: DataFrame, held: list[str]) -> DataFrame:
    """Verified links (a, b) between different components of a bucket, by blocks."""
    schema = "key long, band int, i int, j int, side int, doc long, component long, signature binary"
    order = ["key", "i", "j", "doc"]
    rows = dealt(labelled, classes.select("doc", "signature"))
    need = written(rows.repartition("key", "i", "j").sortWithinPartitions(*order).mapInArrow(wanted, schema), "wanted", held)
    texts = texts_for(docs, need.select("doc").distinct(), held)
    whole = need.join(texts, "doc").select(*need.columns, "packed").repartition("key", "i", "j").sortWithinPartitions(*order)
    return written(whole.mapInArrow(settled, "a long, b long"), "missed", held).distinct()


def missed_links(keys: DataFrame, classes: DataFrame, comps: DataFrame, docs: DataFrame, held: list[str]) -> DataFrame:
    """Verified links (a, b) between different components that share a bucket."""
    labels = lambda rows, by: rows.join(by, "doc", "left").select("key", "band", "doc", F.coalesce("component", "doc").alias("component"))
    labelled = written(labels(keys, comps), "labelled", held)
    wide = written(open_buckets(labelled).where("blocks > 1").select("key"), "wide", held)
    if wide.isEmpty():
        return compared(labelled, classes, docs, held)
    found = compared(labelled.join(wide, "key", "left_anti"), classes, docs, held)
    ids = written(labelled.join(wide, "key", "left_semi").select("doc").distinct(), "crowded", held)
    again = written(prefix_keys(texts_for(docs, ids, held)), "prefixes", held)
    stars = confirmed(star_pairs(again), classes, docs, held)
    known = comps.join(ids, "doc", "left_semi").select(F.col("doc").alias("a"), F.col("component").alias("b"))
    now = written(components(known.union(stars)), "now", held)
    return found.union(stars).union(compared(labels(again, now), classes, docs, held)).distinct()


#: Nodes of rows whose doc_id has several texts are numbered from here downwards.
_OWN = -(1 << 62)


def as_nodes(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """``rows`` (doc, th) with a node: the doc, or a number of its own where the doc has several texts."""
    if several is None:
        return rows.withColumn("node", F.col("doc"))
    own = F.lit(_OWN) - F.xxhash64("doc", "th").bitwiseAND(F.lit((1 << 61) - 1))
    marked = rows.join(several.select(F.col("doc").alias("m_doc")), F.col("doc") == F.col("m_doc"), "left")
    return marked.withColumn("node", F.when(F.col("m_doc").isNull(), F.col("doc")).otherwise(own)).drop("m_doc")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id, kept of every row of ``docs``."""
    held: list[str] = []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), "text")
    known = written(rows.mapInArrow(features, FEATURES), "features")
    sets = known.where("doc is not null and n > 0")
    each = F.struct("s1", "s2", "n")
    several = written(sets.groupBy("doc").agg(F.min(each).alias("lo"), F.max(each).alias("hi")).where("lo <> hi").select("doc"), "several")
    several = None if several.isEmpty() else several
    grouped = as_nodes(sets, several).groupBy("s1", "s2", "n").agg(F.min("node").alias("doc"), F.min("doc").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature"))
    classes = written(grouped, "classes")
    keys = classes.select("doc", "signature").mapInArrow(band_keys, "key long, band int, doc long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = written(keys.join(shared, "key"), "keys", held)
    texts = as_nodes(rows.where("doc is not null"), several).select(F.col("node").alias("doc"), F.lit(0).cast("long").alias("version"), "text")
    comps = written(components(confirmed(star_pairs(keys), classes, texts, held)), "components")
    more = missed_links(keys, classes, comps, texts, held)
    if not more.isEmpty():
        # Every node with its component is a star: contraction goes on from there.
        comps = written(components(comps.select(F.col("doc").alias("a"), F.col("component").alias("b")).union(more)), "components")
    dropped(docs.sparkSession, held)
    found = classes.select("s1", "s2", F.col("n").alias("size"), "doc", "low", "copies").join(comps, "doc", "left")
    if several is not None:  # a component's least node may not have its least doc
        found = found.withColumn("label", F.coalesce("component", "doc"))
        least = found.groupBy("label").agg(F.min("low").alias("label_low"))
        found = found.join(least, "label").withColumn("component", F.col("label_low"))
    # Equal sets take their class's component; a class joins in SALTS places, so that a huge one spreads.
    named = found.where("copies > 1 or component is not null")
    named = named.select("s1", "s2", "size", F.coalesce("component", "low").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = known.select("doc", "th", "n", "s1", "s2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = own.join(named, (own["s1"] == named["s1"]) & (own["s2"] == named["s2"]) & (own["n"] == named["size"]) & (own["salt"] == named["salt"]), "left")
    component = F.when((F.col("n") > 0), F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return joined.select(F.col("doc").alias("doc_id"), "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component; rows that repeat it stay with it.

    Only rows whose id may be one of those to go are shuffled to learn whether they are.
    """
    gone = written(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("id"), "th").distinct(), "gone")
    some, names = IdFilter(gone, "id"), docs.columns
    plain, at = plainly_named(docs), [names.index(c) for c in ("doc_id", "text")]

    def part(held: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids = b.column(at[0]).cast(pa.int64())
                may = some.holds(np.asarray(ids.fill_null(0)).copy()) & np.asarray(ids.is_valid())
                yield b.filter(pa.array(may == held))

        return plain.mapInArrow(run, plain.schema)

    may = part(True)
    same = (may[f"c{at[0]}"].cast("long") == gone["id"]) & (F.xxhash64(may[f"c{at[1]}"]) == gone["th"])
    return part(False).unionByName(may.join(gone, same, "left_anti")).toDF(*names)


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * both_ >= 75 * (i.n + j.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

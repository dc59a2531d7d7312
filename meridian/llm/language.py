"""Language identification with n-gram filters that hold a bitmask of languages.

One Bloom filter serves all languages: each of its ``slots`` holds a bitmask with
a bit for each language (the bit slices of one filter per language, side by
side).  Looking an n-gram up in ``hashes`` slots and taking the bitwise AND gives
at once every language whose filter contains it.  For a text, the hits of each
language are counted over all its n-grams, corrected for that filter's measured
false-positive rate, and the largest share decides.

A filter holds the n-grams (of 2, 3 and 4 characters) that are frequent in its
language: counted over all its learning documents, cut at ``min_share`` of the language's
n-grams of that length, so at most 1 / ``min_share`` of a length.  All documents are
learnt from and judged over their whole text; the levels of ``known_language`` are exact
medians over all learning documents.  A slot has a word of mask for every 64 languages,
so there may be any number of them.

Defined results: texts that are null or have no letter (Unicode categories L) get ``und`` and score 0;
ties go to the language that learnt more documents, then to the smaller code; with nothing to learn from, every text gets ``und``;
null languages are never learnt from; rows are judged one by one, so repeated
rows agree; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import dropped, plainly_named, table, written
from .tokens import slices

#: n-gram lengths in characters of a lower-cased text whose words are joined by one space.
SIZES = (2, 3, 4)
SLOTS = 1 << 19
HASHES = 3
#: An n-gram is kept for a language if it is at least this share of the language's n-grams of its length.
MIN_SHARE = 2e-4
#: Languages in one word of mask.
WORD_BITS = 64
#: n-grams that a task holds, as they come and as sums, before they are summed or go out; rows of a batch of sums.
WAITING, SUMS, OUT = 1 << 20, 1 << 20, 1 << 16
_WORD = re.compile(r"[^\W\d_]+")
_PRIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def letters(text: str) -> str:
    """The words of a text (runs of letters), lower-cased, each with a space before and after."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numbers that are no digits, such as fractions
        found = [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]
    return " " + " ".join(found) + " " if found else ""


#: Characters looked up at a time.
PIECE = 1 << 15


def pieces(text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """``codes`` of a text, a bounded part at a time; parts overlap so that every n-gram lies in one."""
    plain = letters(text)
    for at in range(0, len(plain), PIECE):
        got = codes(plain[at : at + PIECE + max(SIZES) - 1])
        if got:
            yield got


def codes(plain: str) -> list[tuple[int, np.ndarray]]:
    """For each n, the n-grams of a text as 64-bit codes."""
    chars = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out, acc = [], None
    for n in range(1, max(SIZES) + 1):
        if len(chars) < n + 1:
            break
        with np.errstate(over="ignore"):
            acc = chars.copy() if acc is None else acc[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :] + np.uint64(n)
        if n in SIZES:
            out.append((n, acc))
    return out


def slots_of(grams: np.ndarray, j: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (grams + np.uint64(j)) * np.uint64(_PRIMES[j])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(45)).astype(np.int64) % SLOTS


Sums = dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]


def added(sums: Sums, key: tuple[str, int], grams: np.ndarray, times: np.ndarray) -> None:
    """Add the times of distinct n-grams to those of a language and length."""
    if key in sums:
        grams, times = (np.concatenate(x) for x in zip(sums[key], (grams, times), strict=True))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        grams, times = grams[first], np.add.reduceat(times[order], first)
    sums[key] = grams, times


def rows_of(sums: Sums) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, times) of sums, in batches."""
    if not sums:
        return
    places = np.repeat(np.arange(len(sums)), [len(grams) for grams, _ in sums.values()])
    langs = pa.array([lang for lang, _ in sums], pa.string())
    grams, times = (np.concatenate(x) for x in zip(*sums.values(), strict=True))
    lengths = np.array([n for _, n in sums], dtype=np.int32)
    for k in range(0, len(places), OUT):
        own = places[k : k + OUT]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(own)), pa.array(lengths[own]), pa.array(grams[k : k + OUT].view(np.int64)), pa.array(times[k : k + OUT])], names=["lang", "n", "gram", "times"])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (lang, n, gram, times) of its documents, and their number as n-gram 0 of length 0.

    An n-gram may come several times: sums go out whenever they are many.
    """
    sums: Sums = {}
    raw: dict[tuple[str, int], list[np.ndarray]] = {}
    waiting = 0

    def summed() -> None:
        nonlocal waiting
        for key, parts in raw.items():
            added(sums, key, *np.unique(np.concatenate(parts), return_counts=True))
        raw.clear()
        waiting = 0

    for b in slices(batches):
        langs = b["lang"].to_pylist()
        for lang, text in zip(langs, b["text"].to_pylist(), strict=True):
            for part in pieces(text or ""):
                for n, grams in part:
                    raw.setdefault((lang, n), []).append(grams)
                    waiting += len(grams) + 16  # an array takes some room however short
                if waiting >= WAITING:
                    summed()
                    if sum(len(grams) for grams, _ in sums.values()) >= SUMS:
                        yield from rows_of(sums)
                        sums.clear()
        for lang, n in Counter(langs).items():
            added(sums, (lang, 0), np.zeros(1, np.uint64), np.array([n], np.int64))
    summed()
    yield from rows_of(sums)


class Filters:
    """The bit-sliced filter, the languages of its bits, and their false-positive rates."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]):
        self.langs = langs
        #: For every 64 languages, a mask for each hash, as narrow as they allow.
        self.words: list[list[np.ndarray]] = []
        false = []
        for at in range(0, len(langs), WORD_BITS):
            part = langs[at : at + WORD_BITS]
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(part) <= 8 * t().itemsize)
            masks = [np.zeros(SLOTS, dtype=kind) for _ in range(HASHES)]
            for bit, lang in enumerate(part):
                for j, mask in enumerate(masks):
                    mask[slots_of(grams[lang], j)] |= kind(1 << bit)
            self.words.append(masks)
            false += [np.prod([float((m & kind(1 << bit) != 0).mean()) for m in masks]) for bit in range(len(part))]
        self.false = np.array(false)

    def lookup(self, grams: np.ndarray) -> list[np.ndarray]:
        """The bitmasks of languages that contain each n-gram."""
        slots = [slots_of(grams, j) for j in range(HASHES)]
        out = []
        for masks in self.words:
            found = masks[0][slots[0]]
            for mask, slot in zip(masks[1:], slots[1:], strict=True):
                found = found & mask[slot]
            out.append(found)
        return out

    def counts(self, grams: np.ndarray) -> list[int]:
        """How many of the n-grams each language's filter contains."""
        return [int(np.count_nonzero(found & found.dtype.type(1 << bit))) for at, found in zip(range(0, len(self.langs), WORD_BITS), self.lookup(grams), strict=True) for bit in range(min(WORD_BITS, len(self.langs) - at))]

    def shares(self, text: str | None) -> tuple[int, np.ndarray]:
        """How many n-grams a text has, and each language's corrected share of hits."""
        total, counts = 0, np.zeros(len(self.langs))
        for part in pieces(text) if text and self.langs else ():
            grams = np.concatenate([g for _, g in part])
            total += len(grams)
            counts += self.counts(grams)
        hits = counts / max(total, 1)
        return total, np.clip((hits - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def decide(self, text: str | None) -> tuple[str, float]:
        total, share = self.shares(text)
        if not total:
            return "und", 0.0
        best = int(share.argmax())
        rest = float(np.delete(share, best).max()) if len(share) > 1 else 0.0
        top = float(share[best])
        return self.langs[best], (top / (top + rest) if top > 0 else 0.0)


def learn(docs: DataFrame, min_share: float = MIN_SHARE) -> Filters:
    """Filters from ``text`` and ``lang`` of all rows with a non-null language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = known.mapInArrow(count_grams, "lang string, n int, gram long, times long").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    held: list[str] = []
    counts = written(counts, "grams", held)
    totals = counts.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.where("n = 0").collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    grams = {lang: np.zeros(0, np.uint64) for lang in langs}
    # At most 1 / min_share n-grams of a length reach that share: the result is bounded.
    total = F.broadcast(totals.where("n > 0"))
    kept = counts.join(total, ["lang", "n"]).where(F.col("times") >= F.col("total") * min_share).select("lang", "gram").toArrow()
    dropped(docs.sparkSession, held)
    names = np.asarray(kept["lang"])
    for lang in langs:
        grams[lang] = np.asarray(kept["gram"])[names == lang].view(np.uint64)
    return Filters(langs, grams)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred and score (struct ``found``) for every row."""
    sent, names = docs.sparkSession.sparkContext.broadcast(filters), docs.columns
    plain, text = plainly_named(docs), names.index("text")
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [dict(zip(("lang_pred", "score"), sent.value.decide(t), strict=True)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "found"])

    return plain.mapInArrow(run, StructType(plain.schema.fields + [StructField("found", StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))])).toDF(*names, "found")


def remainder(column: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    filters = learn(docs.where(~held))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held.alias("held_out"), "found.lang_pred", "found.score")


#: A text of a known language has at least this part of the median share of hits of the language's learning documents.
KNOWN = 0.5
#: Steps in which shares are counted to find the one that holds the median.
STEPS = 1 << 12


def medians(shares: DataFrame) -> DataFrame:
    """(lang, level): the lower median of ``share``, 0 to 1, over all rows (lang, share) of a language.

    Counts in ``STEPS`` steps tell the step that holds it; only the distinct values of that step are then ordered.
    """
    step = F.floor(F.col("share") * STEPS).alias("step")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    every = F.sum("n").over(Window.partitionBy("lang"))
    steps = shares.groupBy("lang", step).agg(F.count(F.lit(1)).alias("n")).select("lang", "step", "n", upto.alias("upto"), every.alias("every"))
    middle = steps.withColumn("rank", F.expr("(every + 1) div 2")).where("upto >= rank and upto - n < rank")
    middle = F.broadcast(middle.select("lang", "step", F.expr("rank - (upto - n)").alias("rank")))
    values = shares.select("lang", "share", step).join(middle, ["lang", "step"]).groupBy("lang", "rank", "share").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("share"))
    return values.withColumn("upto", upto).where("upto >= rank and upto - n < rank").select("lang", F.col("share").alias("level"))


def judged(docs: DataFrame, filters: Filters) -> DataFrame:
    """The rows of ``docs`` that have n-grams, with columns c0, c1, ... and lang, own (the share of hits in it), best, share (in the best) and total."""
    sent, names = docs.sparkSession.sparkContext.broadcast(filters), docs.columns
    place = {lang: k for k, lang in enumerate(filters.langs)}
    plain, text = plainly_named(docs), names.index("text")
    plain = plain.withColumn("lang", F.col(f"c{names.index('lang')}").cast("string"))
    new = [StructField("own", DoubleType()), StructField("best", StringType()), StructField("share", DoubleType()), StructField("total", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [sent.value.shares(t) for t in b.column(text).to_pylist()]
            b = b.filter(pa.array([total > 0 for total, _ in found], pa.bool_()))
            found = [(total, share, int(share.argmax())) for total, share in found if total]
            own = [float(share[place[lang]]) if lang in place else None for (_, share, _), lang in zip(found, b["lang"].to_pylist(), strict=True)]
            best = [sent.value.langs[k] for _, _, k in found]
            most = [float(share[k]) for _, share, k in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.float64()), pa.array(best, pa.string()), pa.array(most, pa.float64()), pa.array([total for total, _, _ in found], pa.int64())], names=[*b.schema.names, *[f.name for f in new]])

    return plain.mapInArrow(run, StructType(plain.schema.fields + new))


def known_language(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents go that have no letter, or too few n-grams of any language learnt.

    A text stays if its share of hits in its best language is not far below that language's
    level, the median share of its learning documents; two standard errors of a share
    over so few n-grams are allowed for.  Texts are looked up once, for levels and judgement.
    """
    found = written(judged(docs, learn(docs)), "judged")
    levels = written(medians(found.where("own is not null").select("lang", F.col("own").alias("share"))), "levels")
    levels = F.broadcast(levels.select(F.col("lang").alias("l_lang"), "level"))
    near = F.col("share") + 1 / F.sqrt("total") >= KNOWN * F.coalesce("level", F.lit(0.0))
    kept = found.join(levels, F.col("best") == F.col("l_lang"), "left").where((F.col("share") > 0) & near)
    return kept.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)

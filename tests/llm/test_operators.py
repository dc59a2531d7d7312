"""Operators against brute force, on small tables with nulls, ties, repeats, and clashing columns."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meridian.llm import decontamination, language, minhash, mixing, pii, sharding, substring_dedup, suffix_dedup, topk, toxicity

from .conftest import SCHEMA, rows_of

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


# 1. sharding


def test_shards_hold_the_law(docs, texts):
    out = sharding.hilbert_shards(docs, 7).collect()
    assert len(out) == len(texts)
    for r in out:
        data = None if r.text is None else r.text.encode()
        assert r["size"] == len(data or b"") + 16
        assert r.text_crc32 == (None if data is None else zlib.crc32(data))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {"row", "key", "n"} <= set(out[0].asDict())


def test_equal_texts_stand_together(spark):
    rows = rows_of([(i, f"text {i % 10}", "en", f"s{i % 4}") for i in range(100)])
    out = sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA), 4).select("text", "shard", "slot").orderBy("shard", "slot").collect()
    order = [r.text for r in out]
    assert sum(a != b for a, b in zip(order, order[1:])) == 9


@pytest.mark.parametrize("sources", [(None, "b"), ("a",), (None,), ("a", "b", None)])
def test_groups_share_their_smallest_source(spark, sources):
    rows = rows_of([(i, f"text {i % 5}", "en", sources[i // 5 % len(sources)]) for i in range(60)] + [(60 + i, f"other {i}", f"l{i % 3}", f"s{i}") for i in range(40)])
    out = sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA), 4).orderBy("shard", "slot").collect()
    order = [r.text for r in out if r.text.startswith("text")]
    assert len(out) == 100 and sum(a != b for a, b in zip(order, order[1:])) == 4
    assert len({r.hilbert for r in out if r.text.startswith("text")}) == 1


def test_no_rows_no_shards(empty):
    assert sharding.hilbert_shards(empty).count() == 0


def test_curve_visits_neighbours(spark):
    grid = spark.range(512).select(*[(F.col("id") / 8**k % 8).cast("int").alias(f"d{k}") for k in range(3)])
    at = {r.h: (r.d0, r.d1, r.d2) for r in grid.withColumn("h", sharding.hilbert_index([F.col("d0"), F.col("d1"), F.col("d2")], 3)).collect()}
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))


# 2. near duplicates


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_components_of_edge_cases(docs, texts):
    want = brute_components([(i, t) for i, t, _, _ in texts if i is not None])
    out = minhash.near_duplicates(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


def test_components_of_chains_and_groups(spark):
    rng = random.Random(5)
    texts = []
    for g in range(3):
        now = [f"g{g}w{i}" for i in range(120)]
        for _ in range(40):  # each a few edits from the one before: chains beyond direct similarity
            now = list(now)
            now[rng.randrange(120)] = f"x{rng.random()}"
            texts.append(" ".join(now))
    shared = " ".join(f"s{i}" for i in range(60))  # a common passage that makes texts similar, but not enough
    texts += [shared + " " + " ".join(f"u{d}_{i}" for i in range(25)) for d in range(40)]
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute_components(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == want


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 40)]
    out = {r.doc: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(1, 61)) and out[101] == out[102] == 100


def test_no_documents_no_components(empty):
    assert minhash.near_duplicates(empty).count() == 0


# 3. and 9. repeated windows


def brute_bytes(pairs, length):
    seen, out = {}, {}
    data = {i: (t or "").encode() for i, t in pairs}
    for i in sorted(data):
        d, gone = data[i], bytearray(len(data[i]))
        for p in range(len(d) - length + 1):
            if seen.setdefault(d[p : p + length], (i, p)) != (i, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(pairs, length):
    seen, out = {}, {}
    split = {i: words(t) for i, t in pairs}
    for i in sorted(split):
        w, gone = split[i], [False] * len(split[i])
        for p in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[p : p + length]), i) != i:
                gone[p : p + length] = [True] * length
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def random_pairs(seed, alphabet, n, most):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]
    for _ in range(n):  # splice
        a, b = rng.choice(texts), rng.choice(texts)
        texts.append(a[: rng.randrange(len(a) + 1)] + b[rng.randrange(len(b) + 1) :])
    return list(enumerate(texts))


@pytest.mark.parametrize("alphabet", ["ab", "abc ", "aé "])
def test_bytes_against_brute_force(spark, alphabet):
    pairs = random_pairs(1, alphabet, 40, 300)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    out = {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.duplicate_bytes(df, 20).collect()}
    assert out == brute_bytes(pairs, 20)


@pytest.mark.parametrize("alphabet", ["ab ", "a \n", "abcd  "])
def test_words_against_brute_force(spark, alphabet):
    pairs = random_pairs(2, alphabet, 40, 300)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    out = {r.doc_id: tuple(r)[1:4] for r in substring_dedup.duplicate_words(df, 8).collect()}
    assert out == brute_words(pairs, 8)


def test_windows_of_edge_cases(docs, texts, empty):
    pairs = [(i, t) for i, t, _, _ in texts if i is not None]
    got = suffix_dedup.duplicate_bytes(docs).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: tuple(r)[1:5] for r in got if r.doc_id is not None} == brute_bytes(pairs, 100)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    got = substring_dedup.duplicate_words(docs).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in got if r.doc_id is not None} == brute_words(pairs, 50)
    assert suffix_dedup.duplicate_bytes(empty).count() == substring_dedup.duplicate_words(empty).count() == 0


def test_automaton_against_brute_force():
    rng = random.Random(9)
    for _ in range(100):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(30))] for _ in range(3)]
        auto = substring_dedup.SuffixAutomaton()
        for r in refs:
            auto.add(r)
        doc = [rng.randrange(3) for _ in range(40)]
        known = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max((n for n in range(1, i + 2) if tuple(doc[i + 1 - n : i + 1]) in known), default=0) for i in range(40)]
        assert list(auto.matching(doc)) == want


def test_known_passages_go(spark):
    ref = " ".join(f"r{i}" for i in range(500))
    docs = spark.createDataFrame([(1, "head " + " ".join(ref.split()[100:180]) + " tail"), (2, " ".join(ref.split()[:20])), (3, None)], "doc_id long, text string")
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_known_passages(docs, spark.createDataFrame([(ref,), (None,)], "text string"), 50, shard_words=130).collect()}
    assert out[1] == (82, 80, "head tail") and out[2][1] == 0 and out[3] == (0, 0, "")


# 4. mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, budget, out = set(names), share * sum(sizes.values()), {}
    while left:
        part = {s: budget * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if part[s] > most * sizes[s]]
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            left.remove(s)
    return out


def test_mix_meets_targets(docs, texts, empty):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(texts)
    sizes = {}
    for i, t, _, s in texts:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    assert mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("sizes", [[120] * 6, [500, 200], [500, 200, 100], [500, 200, 100, 500], [50, 20, 10, 500]])
def test_targets_of_tied_sources(spark, sizes):
    named = {f"s{k}": n for k, n in enumerate(sizes)}
    out = mixing.source_targets(spark.createDataFrame(list(named.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in out} == pytest.approx(brute_targets(named))


def test_mixed_rows_keep_columns(docs):
    assert mixing.mixed_rows(docs).columns == docs.columns


# 5. toxicity


def toxic_corpus():
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    out = []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vileness", "horrid"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "nasty horrid")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(i, y) for i, _, y in rows if i % 4 == 0] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if i % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in held]) > 0.97
    assert got[900] == got[901] and 0 <= got[900] < 0.5 and got[None] > 0.7


def test_all_maximal_segments_are_found():
    rng = random.Random(8)
    model = toxicity.Model(odds={"p": (1.0, 1.0), "q": (1.0, 0.4)})
    for _ in range(200):
        text = " ".join(rng.choice("pqzzz") for _ in range(rng.randrange(1, 40)))
        scores = [model.token_score(w) for w in text.split()]
        found, n = model.segments(text)
        assert n == len(scores)
        best = max((sum(scores[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((s for s, _, _ in found), default=0) == pytest.approx(max(best, 0))
        assert all(s == pytest.approx(sum(scores[a:b])) for s, a, b in found)
        assert all(b <= c for (_, _, b), (_, c, _) in zip(found, found[1:]))


def test_no_labels_no_toxicity(docs, spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.Model()).count() == 0


# 6. pseudonyms


KEY = b"0123456789abcdef"


def test_permutation_is_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permuted(v, size, b"t", KEY) for v in range(size)) == list(range(size))


def test_formats_are_kept():
    text = "mail jo.doe7@mail.example.com card 4111-1111-1111-1111 or 4111111111111111 ip 10.2.3.4 on 2024-02-29, +1 (386) 555-3733; DE89 3704 0044 0532 0130 00"
    new, spans = pii.pseudonymised(text, KEY)
    assert [k for k, _, _ in spans] == ["email", "card", "card", "ip", "date", "phone", "iban"]
    cards = re.findall(r"\d(?:-?\d){15}", new)
    assert len(cards) == 2 and cards[0].replace("-", "") == cards[1] and pii.luhn(cards[1]) and cards[1] != "4111111111111111"
    assert all(0 <= int(o) <= 255 for o in re.search(r"ip ([\d.]+)", new).group(1).split("."))
    assert datetime.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", new).group())
    assert "jo.doe7@" not in new and "@mail.example.com" in new and pii.mod97(new.split("; ")[1].replace(" ", "")) == 1
    assert pii.pseudonymised(text, KEY) == (new, spans)


def test_invalid_values_stay(docs, texts, empty):
    text = "card 4111111111111112 ip 300.1.1.1 date 2023-02-30 v 1.2.3"
    assert pii.pseudonymised(text, KEY) == (text, [])
    out = pii.pseudonymise(docs, KEY).collect()
    assert len(out) == len(texts) and pii.pseudonymise(empty, KEY).count() == 0
    assert {r.doc_id: r.text for r in out}[3] is None


def test_adjacent_values_are_all_found():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = {
        "4111111111111111 123": [("card", "4111111111111111")],
        card + " 12/25": [("card", card)],
        "12/25 " + card: [("card", card)],
        "123 " + card + " 123": [("card", card)],
        card + " 2024-01-02": [("card", card), ("date", "2024-01-02")],
        card + " 415-555-2671": [("card", card), ("phone", "415-555-2671")],
        "415-555-2671 415-555-2672": [("phone", "415-555-2671"), ("phone", "415-555-2672")],
        "415-555-2671 2024-01-02": [("phone", "415-555-2671"), ("date", "2024-01-02")],
        "415-555-2671 " + card: [("phone", "415-555-2671"), ("card", card)],
        iban + " 2024-01-02": [("iban", iban), ("date", "2024-01-02")],
        iban + " PLEASE": [("iban", iban)],
        "+1 415-555-2671 2024-01-02": [("phone", "+1 415-555-2671"), ("date", "2024-01-02")],
    }
    for text, want in cases.items():
        new, spans = pii.pseudonymised(text, KEY)
        assert [(k, text[a:b]) for k, a, b in spans] == want
        assert all(new[a:b] != text[a:b] for _, a, b in spans)


def test_long_values_are_permuted():
    for n in (38, 40, 60, 100, 217, 500, 5000):
        made = set()
        for local in ("a" * n, "b" + "a" * (n - 1), "ab1" * (n // 3) + "x" * (n % 3)):
            new, spans = pii.pseudonymised(f"to {local}@example.com now", KEY)
            assert [k for k, _, _ in spans] == ["email"]
            got = re.fullmatch("to (.*)@example.com now", new).group(1)
            assert [c.isdigit() for c in got] == [c.isdigit() for c in local] and got.isalnum() and got.islower() and got != local
            made.add(got)
        assert len(made) == 3
        value = "sk-" + "a1" * (n // 2)
        new, spans = pii.pseudonymised(f"key {value}.", KEY)
        assert [k for k, _, _ in spans] == ["key"] and len(new) == len(f"key {value}.") and value not in new


# 7. top k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=12) * (20 if i % 50 == 0 else 1)]) for i in range(300)]
    rows += [(301, None), (302, [None] * 12), (303, [float("nan")] * 12), (None, [1.0] * 12), (304, rows[3][1]), (304, rows[3][1]), (305, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where(F.col("vec_id") % 20 == 0), 5).collect()
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and not any(x is None or x != x for x in v)]
    good = [(i, np.pad(v, (0, 12 - len(v)))) for i, v in good]
    want = []
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        ranked = sorted(((-int(v @ c), i) for i, c in good if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_no_vectors_no_hits(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


# 8. decontamination


def test_search_finds_all_above_threshold():
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(3, 30)))) for i in range(60)]
    index = decontamination.Index(items)
    for _ in range(100):
        terms = sorted({w for w in (rng.choice(vocab).encode() for _ in range(25)) if w in index.most})
        scores = {}
        for t in terms:
            for e, w in zip(index.entries[t], index.impacts[t]):
                scores[e] = scores.get(e, 0) + w
        assert {e: pytest.approx(s) for e, s in index.search(terms)} == {e: s for e, s in scores.items() if s >= 0.5 - 1e-9}


def test_items_are_found_and_clean_texts_left(spark, docs, empty):
    rng = random.Random(6)
    vocab = [f"b{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 150)))) for i in range(30)] + [(90, None), (91, ""), (None, "x"), (92, "tiny item")]
    clean = [(i, " ".join(rng.choice(vocab) for _ in range(400))) for i in range(100)]
    leaked = [(200 + i, " ".join(rng.choice(vocab) for _ in range(77)) + " " + items[i][1].upper() + ", and more") for i in range(30)]
    df = spark.createDataFrame(clean + leaked + [(300, None), (301, ""), (302, "a tiny item")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert got == {(200 + i, i) for i in range(30)} | {(302, 92)}
    kept = decontamination.clean_only(df, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(100)) | {300, 301} and kept.columns == df.columns
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_screening_loses_nothing():
    rng = random.Random(7)
    vocab = [f"b{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(25)]
    index = decontamination.Index(items)
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(300))) + " " + (rng.choice(items)[1] if k % 2 else "") for k in range(60)] + ["", None]
    assert index.batch(pa.array(texts)) == [index.matches(t) for t in texts]


def test_parts_of_the_index_weigh_alike(spark):
    rng = random.Random(17)
    vocab = [f"b{min(int(rng.expovariate(0.05)), 200)}" for _ in range(300)]
    items = [(i if i % 5 else None, " ".join(rng.choice(vocab) for _ in range(rng.randrange(8, 120)))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = decontamination.Index(items)
    (one,) = decontamination.index_parts(bench)
    many = list(decontamination.index_parts(bench, 2000))
    order = lambda found: sorted(found, key=str)
    assert len(many) > 3 and sum(len(x.items) for x in many) == len(items)
    for _, text in items:
        want = order(whole.matches("before " + text + " after"))
        assert want and order(one.matches("before " + text + " after")) == want
        got = order(m for x in many for m in x.matches("before " + text + " after"))
        assert [m[0] for m in got] == [m[0] for m in want] and [m[1] for m in got] == pytest.approx([m[1] for m in want])
    df = spark.createDataFrame([(1, "before " + items[0][1] + " after"), (2, "clean text")], "doc_id long, text string")
    assert items[0][0] is None and [r.doc_id for r in decontamination.clean_only(df, bench).collect()] == [2]


def test_copies_in_other_case_and_typography_match():
    item = "¿Qué canción del corazón suena aquí, años después de la niñez? Das Straßenfest - \"laut und fröhlich\" - endet übermorgen früh, öffnet ähnlich"
    index = decontamination.Index([(1, item), (2, "nothing of this kind is in any of those texts here today")])
    loud = "Vorab " + item.upper() + " Ende"
    curly = item.replace(" - ", "\u2014").replace('"', "\u201d").replace(" ", "\u00a0")
    for text in (item, loud, curly):
        assert [(i, q, a) for i, _, q, a in index.batch(pa.array([text]))[0]] == [(1, 1.0, 1.0)]
    assert decontamination.tokens("CIÓN house—red snake_case «Ünder»\u00a0x ΟΔΟΣ") == [w.encode() for w in ("ción", "house", "red", "snake_case", "ünder", "x", "οδοσ")]
    long = "É—a " * 600_000
    assert decontamination.tokens(long) == ["é".encode(), b"a"] * 600_000


# 10. language


def test_languages_of_held_out_texts(spark, docs, texts, empty):
    rng = random.Random(1)
    stems = {"aa": ["zor", "mik", "tal"], "bb": ["quen", "vesh", "rul"], "cc": ["ñol", "peß", "dâm"]}
    rows = [(i, " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(30)), k) for i in range(150) for k in stems]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(df.where("doc_id < 100"))
    out = language.identify(df.where("doc_id >= 100"), filters).select("lang", "found.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99 and all(0 <= r.score <= 1 for r in out)
    edge = language.identify(docs.select("doc_id", "text"), filters).select("doc_id", "found.*").collect()
    assert len(edge) == len(texts)
    assert all(r.lang_pred == "und" and r.score == 0 for r in edge if r.doc_id in (3, 4, 5, ))
    none = language.learn(empty)
    assert none.langs == [] and none.decide("text") == ("und", 0.0)
    assert language.Filters([], {}).decide(None) == ("und", 0.0)
    assert set(language.known_language(docs).columns) == set(docs.columns)


def test_texts_of_unlearnt_languages_go(spark):
    rng = random.Random(21)
    stems = {"aa": ["zor", "mik", "tal", "ben"], "bb": ["quen", "vesh", "rul", "dop"], "cc": ["ñol", "peß", "dâm", "gex"]}
    text = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(n))
    known = [(i, text("ab"[i % 2] * 2, rng.randrange(1, 60)), "ab"[i % 2] * 2) for i in range(200)]
    mixed = [(200, text("aa", 20) + " " + text("bb", 20), None)]
    other = [(300 + i, text("cc", 30), None) for i in range(10)]
    noise = [(400 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40)), None) for i in range(10)]
    df = spark.createDataFrame(known + mixed + other + noise + [(500, "123 !", "aa"), (501, None, "aa")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.known_language(df).collect()} == set(range(201))


def test_texts_longer_than_a_piece():
    rng = random.Random(11)
    many = [f"w{rng.randrange(5000)}" for _ in range(600_000)]
    text = " ".join(many)
    sets, bounds = minhash.shingle_sets(pa.array([text, "a b c", None, "A b C"]))
    assert list(np.diff(bounds)) == [len({tuple(many[i : i + 5]) for i in range(len(many) - 4)}), 1, 0, 1]
    assert sets[-1] == sets[-2]
    assert sum(len(g) for part in language.pieces(text) for n, g in part if n == 2) >= len(text) * 0.3
    assert [b.num_rows for b in minhash.slices([pa.record_batch([pa.array(["x" * 6_000_000, "y" * 6_000_000, "z", "z"])], names=["text"])])] == [1, 3]


def test_long_repeated_bytes(spark):
    rng = random.Random(12)
    big = "".join(rng.choice("abcdefgh") for _ in range(600_000))
    df = spark.createDataFrame([(1, big), (2, "!" + big[1000:]), (3, big[:500_000] + "?" + big[500_000:])], "doc_id long, text string")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.duplicate_bytes(df, keep=False).collect()}
    assert out == {1: (600_000, 0, 0), 2: (599_001, 599_000, 1), 3: (600_001, 600_000, 2)}

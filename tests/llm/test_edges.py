"""Cases that once went wrong: repeated ids, structured texts, clashing and dotted columns, huge values."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridian.llm import decontamination, language, minhash, mixing, pii, repeats, sharding, substring_dedup, suffix_dedup, tokens, topk, toxicity

from .test_operators import brute_bytes, brute_components, brute_words, random_pairs


def thue_morse(bits, swap=False):
    word = [0]
    for _ in range(bits):
        word += [1 - x for x in word]
    return "".join("ba"[x] if swap else "ab"[x] for x in word)


def test_structured_words_are_told_apart(spark):
    one, two = thue_morse(11), thue_morse(11, True)
    head = " ".join(f"w{i}" for i in range(49))
    pairs = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}"), (4, " ".join([one] * 5)), (5, " ".join([two] * 5)), (6, one * 2), (7, two * 2)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.duplicate_words(df).collect()} == brute_words(pairs, 50)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.duplicate_bytes(df).collect()} == brute_bytes(pairs, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components(pairs)


def test_hashes_of_ranges_depend_on_content_only():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 3000).astype(np.uint8)
    sums = tokens.Sums(tokens.byte_streams(data))
    start = rng.integers(0, 2900, 4000)
    end = start + rng.integers(1, 12, 4000)
    seen = {}
    for s, e, h in zip(start, end, sums.of(start, end).tolist()):
        assert seen.setdefault(data[s:e].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("group", [1, 8_192])
def test_groups_too_large_for_a_task(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(31)
    common = "".join(rng.choice("abcd ") for _ in range(60))
    pairs = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(40))) + common + "".join(rng.choice("abcd ") for _ in range(rng.randrange(40)))) for i in range(60)]
    pairs += [(100 + i, t) for i, (_, t) in enumerate(random_pairs(7, "ab ", 20, 200))]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.duplicate_bytes(df, 24).collect()} == brute_bytes(pairs, 24)
    assert {r.doc_id: tuple(r)[1:4] for r in substring_dedup.duplicate_words(df, 6).collect()} == brute_words(pairs, 6)


def test_one_id_with_several_texts(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, long), (2, long), (2, "short text"), (2, long), (3, long[:150] + "!" + long[:150]), (3, long[100:300]), (3, "another " + long[100:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def expected(k):  # each row against smaller ids and itself
        i, t = rows[k]
        data, gone = t.encode(), np.zeros(len(t), bool)
        before = [x.encode() for j, x in rows if j < i]
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if any(w in b for b in before) or data.find(w) < p:
                gone[p : p + 100] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        return i, len(data), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    got = suffix_dedup.duplicate_bytes(df).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(map(expected, range(len(rows))))
    text = " ".join(f"w{i}" for i in range(80))
    words = [(1, text), (2, text), (2, "short text"), (2, "x " + text), (4, None), (4, text)]
    out = substring_dedup.duplicate_words(spark.createDataFrame(words, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(1, 80, 0), (2, 2, 0), (2, 80, 80), (2, 81, 80), (4, 0, 0), (4, 80, 80)]


def test_components_where_an_id_has_several_texts(spark):
    text = lambda a: " ".join(f"{a}{i}" for i in range(60))
    near = lambda a: text(a) + " and more"
    rows = [(1, text("a")), (5, near("a")), (5, text("b")), (7, near("b")), (8, text("b")), (9, text("c")), (9, text("c")), (10, near("c")), (11, text("d")), (5, text("e")), (12, near("e"))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    want = [(1, 56, 1, True), (5, 56, 5, True), (5, 56, 5, True), (5, 58, 1, False), (7, 58, 5, False), (8, 56, 5, False), (9, 56, 9, True), (9, 56, 9, True), (10, 58, 9, False), (11, 56, 11, True), (12, 58, 5, False)]
    assert found == want
    kept = minhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[0]) for r in kept) == [(1, "a"), (5, "b"), (5, "e"), (9, "c"), (9, "c"), (11, "d")]


def test_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(12)
    texts = []
    for g in range(2):
        now = [f"g{g}w{i}" for i in range(80)]
        for _ in range(25):
            now = list(now)
            now[rng.randrange(80)] = f"x{rng.random()}"
            texts.append(" ".join(now))
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{d}_{i}" for i in range(25)) for d in range(15)]
    pairs = list(enumerate(texts))
    out = minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(pairs)


def test_crowded_buckets_are_dealt_by_rare_shingles(spark, monkeypatch):
    """Texts around one template: all share buckets, few are linked, and no link is lost."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(150)]
    texts = []
    for g in range(14):
        own = [f"g{g}w{i}" for i in range(100)]
        texts.append(" ".join(template + own))
        for _ in range(rng.randrange(3)):
            near = [f"x{rng.random()}" if rng.random() < 0.02 else w for w in own]
            texts.append(" ".join(template + near))
    texts += [" ".join(template + [f"short{k}"]) for k in range(2)] + ["", "one two", "one two"]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    crowded, keys = [], minhash.prefix_keys

    def seen(given):
        crowded.append(given.count())
        return keys(given)

    monkeypatch.setattr(minhash, "prefix_keys", seen)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    out = minhash.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(pairs)
    assert crowded and crowded[0] >= 14


def test_prefixes_of_similar_sets_meet():
    rng = np.random.RandomState(6)
    seen = rng.randint(0, 50, minhash.COUNTERS)
    for n in [1, 2, 3, 4, 5, 7, 8, 100, 301]:
        for _ in range(40):
            a = np.unique(rng.randint(0, 1 << 62, n, dtype=np.int64).view(np.uint64))
            b = a[rng.rand(len(a)) < 0.9]
            b = np.unique(np.concatenate([b, rng.randint(0, 1 << 62, n // 15, dtype=np.int64).view(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(minhash.rarest(a, seen), minhash.rarest(b, seen)))
                assert len(minhash.rarest(a, seen)) == len(a) - -(-75 * len(a) // 100) + 1


def test_dealt_blocks_hold_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(k, 0, d, 0 if rng.random() < 0.6 else rng.randrange(1, 6)) for k in range(3) for d in range(40)]
    got = minhash.dealt(spark.createDataFrame(rows, "key long, band int, doc long, component long")).collect()
    blocks = {}
    for r in got:
        blocks.setdefault((r.key, r.i, r.j), []).append(r)
    met = []
    for (key, _, _), members in blocks.items():
        met += [(key, *sorted((a.doc, b.doc))) for a in members for b in members if a.side == 0 and b.side == 1 and a.component != b.component]
        two = [m for m in members if m.side == 2]
        met += [(key, *sorted((a.doc, b.doc))) for n, a in enumerate(two) for b in two[n + 1 :] if a.component != b.component]
    want = {(k, a[2], b[2]) for k in range(3) for a in rows for b in rows if a[0] == b[0] == k and a[2] < b[2] and a[3] != b[3]}
    assert set(met) == want and len(met) == len(want)


CLASHES = ["gone_id", "m_id", "m_copy", "m_times", "a.b", "row", "id", "th", "times", "own", "place", "any", "copy", "cut", "whole", "known"]


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit(f"v-{c}").alias(c) for c in CLASHES])


def test_stages_with_clashing_columns(spark):
    rows = [(i, f"text of some words number {i} and a few more of them here", "en", f"s{i % 2}") for i in range(20)] + [(20, None, None, None)]
    df = clashing(spark, rows)
    bench = spark.createDataFrame([(1, "an item that stands nowhere in these texts, of more than ten words in all")], "item_id long, text string")
    for out in (language.known_language(df), minhash.one_of_each(df), decontamination.clean_only(df, bench), mixing.mixed_rows(df), sharding.hilbert_shards(df).drop("size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")):
        got = out.collect()
        assert out.columns == df.columns and all(tuple(r)[4:] == tuple(f"v-{c}" for c in CLASHES) for r in got) and got


def test_mixed_rows_follow_the_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), "en", "abc"[min(2, i % 5)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    times = {r.doc_id: round(r.taken / r["size"] + 1e-9) for r in mixing.mix_sources(df).collect()}
    got = {}
    for r in mixing.mixed_rows(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in times.items() if n}


def test_rank_among_splitters():
    rng = random.Random(1)
    rows = [tuple(rng.randrange(3) for _ in range(3)) for _ in range(300)]
    cuts = sorted(rows[k] for k in range(0, 300, 9))
    columns = lambda t: [np.array(c) for c in zip(*t)]
    assert repeats.rank_among(columns(cuts), columns(rows)).tolist() == [sum(c <= r for c in cuts) for r in rows]


def test_merged_windows():
    doc = np.array([1] * 3000 + [2, 2, 2])
    place = repeats.placed(0, np.array([*range(3000), 5, 5, 7]), np.ones(3003, dtype=np.int64))
    d, p = repeats.merged(doc, place)
    assert list(zip(d.tolist(), repeats.start_of(p).tolist(), repeats.windows_of(p).tolist())) == [(1, 0, 1024), (1, 1024, 1024), (1, 2048, 952), (2, 5, 1), (2, 7, 1)]


def test_words_of_slices():
    data, bounds = tokens.texts_of(pa.array(["a b", None, "b  a", ""]))
    hashes, _, _, offsets = tokens.words_of(data, bounds)
    assert offsets.tolist() == [0, 2, 2, 4, 4] and hashes[0] == hashes[3] and hashes[1] == hashes[2] != hashes[0]


def plain_top(rows, asked, k):
    """(query, rank, id, score) of all pairs of different ids, for each query row."""
    floor = lambda v: [int(np.floor(64 * np.float64(x))) for x in v]
    out = []
    for q, v in asked:
        a = floor(v)
        scored = sorted((-topk.clamped(sum(x * y for x, y in zip(a, floor(c)))), i) for i, c in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_huge_components_and_repeated_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(60)]
    rows += [(60, [1e30] * 20), (61, [-1e30] * 20), (62, [1e17, -3.0] + [0.0] * 18), (40, [2.0] * 20), (40, [-2.0] * 20), (63, [-1e-17] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] % 20 == 0]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(tuple(r) for r in got) == plain_top(rows, asked, 5)
    assert len([r for r in got if r.query_id == 40]) == 15


def test_pairs_are_pruned(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    (block,) = topk.query_blocks(df, df.where("vec_id % 20 = 0"), 20, 64)
    t = topk.integers(df, 64).toArrow()
    search = topk.scan(iter(t.to_batches()), block, 20)
    left = search.left
    assert left["pairs"] == len(rows) * len(block.ids) and left["pairs"] > left["norm"] >= left[1] >= left[2] >= left[3] and left[3] < 0.5 * left["pairs"]
    ranked = sorted((int(q), n + 1, c, -s) for q, found in zip(block.ids, search.found) for n, (s, c) in enumerate(found))
    assert ranked == plain_top(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert sorted(tuple(r) for r in topk.op7_exact_topk(spark, "/root/testdata/sf0.01").collect()) == ranked


# pseudonyms

KEY = b"0123456789abcdef"


def planted(rng):
    """A value of a random kind, as (kind, text)."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice(["email", "card", "iban", "phone", "ip", "date", "key", "secret"])
    if kind == "email":
        return kind, rng.choice(["jo", "ann.lee", "x" * rng.randrange(1, 90)]) + digits(rng.randrange(3)) + "@mail.example.org"
    if kind == "card":
        body = "4" + digits(14)
        full = body + pii.check_digit(body)
        return kind, rng.choice([full, "-".join(full[k : k + 4] for k in range(0, 16, 4))])
    if kind == "iban":
        body = digits(18)
        return kind, f"DE{98 - pii.mod97('DE00' + body):02d}{body}"
    if kind == "phone":
        a, b, c = str(rng.randrange(200, 1000)), str(rng.randrange(200, 1000)), digits(4)
        return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1{a}{b}{c}", f"+44 20 {digits(4)} {digits(4)}"])
    if kind == "ip":
        return kind, ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "date":
        return kind, rng.choice([f"{rng.randrange(1900, 2100)}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}", f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{rng.randrange(1900, 2100)}"])
    if kind == "key":
        return kind, "AKIA" + "".join(rng.choice("ABCDEFG123456") for _ in range(rng.randrange(16, 60)))
    return kind, rng.choice(["token = ", "password: "]) + "".join(rng.choice("abcdef0123456789") for _ in range(40)) + "7"


def test_planted_values_are_found_and_nothing_else():
    rng = random.Random(14)
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randrange(1, 12)):
            text += " ".join(rng.choice(["words", "of", "prose,", "and", "v2", "17", "3.5", "It's"]) for _ in range(rng.randrange(1, 6))) + " "
            kind, value = planted(rng)
            if not want or not text.rstrip().endswith(("17", "3.5")):
                want.append((kind, len(text), len(text) + len(value)))
                text += value + " said "
        new, spans = pii.pseudonymised(text, KEY)
        assert spans == want
        at = 0
        for _, a, b in spans:  # clean text stays, values keep their length but for addresses
            assert text[at:a] in new
            at = b
        again, same = pii.pseudonymised(new, KEY)
        assert [k for k, _, _ in same] == [k for k, _, _ in spans]


def test_spellings_of_one_value_stay_linked():
    phones = ["+1 415 555 1234", "+14155551234", "415-555-1234", "+1 (415) 555-1234", "1-415-555-1234", "(415) 555-1234"]
    new = [pii.pseudonym("phone", p, KEY) for p in phones]
    assert len({"".join(c for c in p if c.isdigit())[-10:] for p in new}) == 1 and all(p != q for p, q in zip(phones, new))
    assert all("".join("9" if c.isdigit() else c for c in p) == "".join("9" if c.isdigit() else c for c in q) for p, q in zip(phones, new))
    assert new[1].startswith("+1") and pii.pseudonym("phone", "+44 20 7946 0958", KEY).startswith("+44 ") and pii.pseudonym("phone", "+352 621 123 456", KEY).startswith("+352 ")
    days = [pii.pseudonym("date", d, KEY) for d in ("2020-02-01", "1.2.2020", "01.02.2020", "2/1/2020", "02/1/2020")]
    y, m, d = days[0].split("-")
    assert days[1:] == [f"{int(d)}.{int(m)}.{y}", f"{d}.{m}.{y}", f"{int(m)}/{int(d)}/{y}", f"{m}/{int(d)}/{y}"] and len(days[1]) == 8


def test_every_length_of_every_kind():
    for n in [*range(1, 60), 80, 129, 217, 230, 500, 1023, 1024, 1025, 2500, 5000]:
        made = [pii.pseudonymised(f"to {'a' * n}@example.com", KEY), pii.pseudonymised(f"sk-{'Z9' * max(8, n)}", KEY), pii.pseudonymised(f'secret="{"0f" * max(4, n)}"', KEY), pii.pseudonymised("+1 " + "5" * n, KEY), pii.pseudonymised("9" * n + ".1", KEY)]
        assert [len(x[1]) for x in made[:3]] == [1, 1, 1]
    assert len({pii.pseudonym("secret", f"token={k:08d}", KEY) for k in range(3000)}) == 3000


def test_keys_are_wanted(spark, docs):
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, b"short")
    with pytest.raises(TypeError):
        pii.pseudonymise(docs)
    other = b"another key, 16+"
    assert pii.pseudonym("card", "4111111111111111", KEY) != pii.pseudonym("card", "4111111111111111", other)


def test_no_secret_of_the_tables_is_left(spark):
    out = pii.op6_pii_pseudonyms(spark, "/root/testdata/sf0.01")
    old = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.col("text").alias("old"))
    secret = F.regexp_extract_all(F.col("old"), F.lit('token = "([0-9a-f]{40})"'), 1)
    rows = out.join(old, "doc_id").where(F.size(secret) > 0).select("text", secret.alias("secrets")).collect()
    assert rows and all(s not in r.text for r in rows for s in r.secrets)


# languages


def test_filter_against_exact_sets():
    rng = np.random.default_rng(2)
    langs = [f"l{k:03d}" for k in range(70)]
    grams = {lang: rng.integers(0, 1 << 62, 900).astype(np.uint64) for lang in langs}
    for lang in langs[1:]:
        grams[lang][:50] = grams[langs[0]][:50]  # shared by all
    filters = language.Filters(langs, grams)
    asked = np.concatenate([grams["l000"][:200], grams["l069"][100:300], rng.integers(0, 1 << 62, 20_000).astype(np.uint64)])
    exact = np.array([np.isin(asked, grams[lang]) for lang in langs])
    found = filters.lookup(asked)
    got = np.array([found[k // 64] >> found[k // 64].dtype.type(k % 64) & found[k // 64].dtype.type(1) for k in range(70)]).astype(bool)
    assert (got | ~exact).all()  # nothing is missed
    extra = (got & ~exact).sum(1)
    assert len(found) == 2 and extra.sum() <= 5 + 3 * filters.false.sum() * len(asked)
    assert filters.counts(asked) == got.sum(1).tolist()


def test_decision_is_that_of_exact_sets():
    rng = random.Random(8)
    stems = {"aa": ["zor", "mik", "tal"], "bb": ["quen", "vesh", "rul"], "cc": ["zor", "vesh", "dam"]}
    text = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(2)) for _ in range(n))
    codes = lambda t: np.concatenate([g for part in language.pieces(t) for _, g in part])
    sets = {k: np.unique(codes(text(k, 300))) for k in stems}
    filters = language.Filters(list(stems), sets)
    for k in [*stems] * 30:
        t = text(k, rng.randrange(1, 20))
        grams = codes(t)
        shares = [np.isin(grams, sets[x]).mean() for x in stems]
        lang, score = filters.decide(t)
        top, rest = sorted(shares, reverse=True)[:2]
        assert lang == list(stems)[int(np.argmax(shares))] or top - rest < 0.01
        assert score == pytest.approx(top / (top + rest), abs=0.01)


def test_texts_without_letters_are_undetermined():
    filters = language.Filters(["aa"], {"aa": np.unique(np.concatenate([g for _, g in language.codes(" aaa ")]))})
    for t in (None, "", "12 ½ ² Ⅷ", "٣ 一2"[:1], "!?"):
        assert filters.decide(t) == ("und", 0.0)
    assert filters.decide("aaa½")[0] == "aa" and language.letters("x½y Ⅷz") == " x y z "


def test_many_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 3 + " " + f"{chr(97 + i // 26)}q{chr(97 + i % 26)} ", f"l{i:02d}") for i in range(80) for _ in range(2)]
    filters = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(filters.langs) == 80 and sum(filters.decide(t)[0] == lang for _, t, lang in rows) >= 150


def gram_counts(rows):
    """Plain counts by (lang, n) of rows (lang, text)."""
    want = {}
    for lang, text in rows:
        for part in language.pieces(text):
            for n, grams in part:
                want.setdefault((lang, n), Counter()).update(grams.tolist())
    return want


def test_languages_are_learnt_from_every_document(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 5)))
    rows = [("aa", f"{word()} {word()} {word()}") for _ in range(3000)] + [("aa", "vesh rul")] * 3000 + [("bb", "xyz " + word()) for _ in range(50)]
    filters = language.learn(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    want = gram_counts(rows)
    kept = {lang: [g for n in language.SIZES for g, k in want[lang, n].items() if k >= sum(want[lang, n].values()) * language.MIN_SHARE] for lang in ("aa", "bb")}
    exact = language.Filters(["aa", "bb"], {lang: np.array(grams, dtype=np.uint64) for lang, grams in kept.items()})
    assert filters.langs == exact.langs
    assert all((a == b).all() for got, own in zip(filters.words, exact.words, strict=True) for a, b in zip(got, own, strict=True))


def test_levels_come_from_every_document(spark):
    rng = random.Random(32)
    noise = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(40))
    rows = [(i, "zormik talben miktal bentalzor mikben zor talzor", "aa") for i in range(800)] + [(1000 + i, noise(), "aa") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in language.known_language(df).collect()} == set(range(800))  # the median document is a copy


def test_partial_sums_of_grams(monkeypatch):
    monkeypatch.setattr(language, "WAITING", 300)
    monkeypatch.setattr(language, "SUMS", 500)
    monkeypatch.setattr(language, "OUT", 64)
    rng = random.Random(33)
    rows = [(rng.choice(["aa", "bb"]), "".join(rng.choice("abcde  ") for _ in range(rng.randrange(200)))) for _ in range(100)] + [("aa", None), ("cc", "1")]
    batches = [pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows[at : at + 40], strict=True)], names=["lang", "text"]) for at in range(0, len(rows), 40)]
    got = {}
    for b in language.count_grams(iter(batches)):
        assert b.num_rows <= 64
        for lang, n, gram, times in zip(*[c.to_pylist() for c in b.columns], strict=True):
            got.setdefault((lang, n), Counter())[gram % (1 << 64)] += times
    docs = {(lang, 0): Counter({0: k}) for lang, k in Counter(lang for lang, _ in rows).items()}
    assert got == gram_counts((lang, text or "") for lang, text in rows) | docs


def test_medians_are_exact(spark):
    rng = random.Random(34)
    shares = {"one": [0.25], "ends": [0.0, 1.0], "ones": [1.0] * 7 + [0.0], "many": [rng.gauss(0.6, 0.05) for _ in range(12_001)], "near": [0.5 + rng.randrange(40) * 1e-6 for _ in range(500)], "same": [rng.choice([0.1, 0.7]) for _ in range(300)]}
    rows = [(lang, x) for lang, xs in shares.items() for x in xs]
    rng.shuffle(rows)
    got = language.medians(spark.createDataFrame(rows, "lang string, share double")).collect()
    assert {r.lang: r.level for r in got} == {lang: sorted(xs)[(len(xs) - 1) // 2] for lang, xs in shares.items()} and len(got) == len(shares)


def test_op10_and_op5_as_registered(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = language.op10_language_id(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    filters = language.learn(spark.createDataFrame([(r.text, r.lang) for i, r in docs.items() if zlib.crc32(str(i).encode()) % 4 != 2], "text string, lang string"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows} == {i: filters.decide(r.text) for i, r in docs.items()}
    out = toxicity.op5_toxicity(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


# toxicity


def brute_segments(scores):
    """All maximal scoring segments, by their definition: the best one, then the same left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left = brute_segments(scores[:a])
    return left + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(scores[b:])]


def test_segments_are_those_of_the_definition():
    rng = random.Random(18)
    model = toxicity.Model(odds={w: (1.0, s) for w, s in zip("pqr", (1.0, 0.4131, 0.0717))})
    for _ in range(150):
        text = " ".join(rng.choice("pqrzzzzzz") for _ in range(rng.randrange(25)))
        scores = [model.token_score(w) for w in text.split()]
        found, _ = model.segments(text)
        assert [(a, b) for _, a, b in found] == brute_segments(scores)


def test_lambda_and_logistic_curve():
    model = toxicity.Model(odds={"bad": (2.0, 1.5), "poor": (1.0, 0.5)})
    texts = ["bad " + "fine " * 50, "poor poor " + "fine " * 97, None, ""]
    hits = toxicity.background(texts, model)
    assert hits == {None: 150, 1.5: 1, 0.5: 2}
    lam = toxicity.root_of(hits)
    assert sum(n * np.exp(lam * s) for s, n in ((1.5, 1), (0.5, 2), (toxicity.DRIFT, 147))) == pytest.approx(150, rel=1e-6)
    rng = np.random.default_rng(6)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x)))).astype(float)
    bias, slope = toxicity.logistic(x, y)
    loss = lambda a, b: (np.logaddexp(0, a + b * x) - y * (a + b * x)).sum() + 0.025 * (a * a + b * b)
    assert all(loss(bias, slope) <= loss(bias + d, slope + e) for d in (-0.01, 0, 0.01) for e in (-0.01, 0, 0.01))


def test_edge_texts_under_a_learnt_model(spark, docs, texts):
    rows = [(i, f"plain w{i % 7} w{i % 5} words {'vile horrid' if i % 4 == 0 else 'kind soft'} end{i}") for i in range(400)]
    labels = spark.createDataFrame([(i, 7 if i % 4 == 0 else 0) for i, _ in rows] + [(1, -3), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert model.odds
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    huge = "kind soft words " * 200_000
    assert model.score(huge) < 0.5 < model.score(huge + "vile horrid " * 6 + huge)


# sharding


def test_shards_cut_along_the_curve_can_be_skipped(spark):
    rng = random.Random(3)
    rows = [(i, f"{i}" + "x" * rng.randrange(1, 4000), rng.choice(["de", "en", "es", "fr"]), f"https://host{rng.randrange(64):02d}.example/") for i in range(4000)]
    out = sharding.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 64).select("shard", "lang", "source", "size")
    box = out.groupBy("shard").agg(*[f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    queries = {"source": "https://host17.example/", "lang": "es", "size": 800}
    for column, value in queries.items():
        read = sum(b[f"lo_{column}"] <= value <= b[f"hi_{column}"] for b in box)
        assert read <= 64 * 0.5, (column, read)
    both = sum(all(b[f"lo_{c}"] <= v <= b[f"hi_{c}"] for c, v in queries.items()) for b in box)
    assert both <= 4


# the pipeline


def test_stages_on_rows_of_every_kind(spark, docs, texts, empty, tmp_path):
    items = [(1, "an item of the benchmark that some of the texts hold word for word, all of it"), (2, None), (None, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leak = docs.where("doc_id = 8").select(*[F.lit(items[0][1]).alias(c) if c == "text" else F.lit(99).cast("long").alias(c) if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns])
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, str(tmp_path))
    got = {r.doc_id for r in known.collect()}
    assert {0, 1, 2} <= got <= {i for i, t, _, _ in texts if any(c.isalpha() for c in t or "")}
    one = stages["near_dedup"](spark, known.unionByName(leak), str(tmp_path))
    assert {None, 0, 99} <= {r.doc_id for r in one.collect()} and not {1, 2} & {r.doc_id for r in one.collect()}
    clean = stages["decontaminate"](spark, one, str(tmp_path))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - {99}
    mixed = stages["mix"](spark, clean, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()} and mixed.columns == docs.columns
    assert stages["shard"](spark, mixed, str(tmp_path)).count() == mixed.count()
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0

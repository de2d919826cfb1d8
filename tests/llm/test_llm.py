"""The corpus operators against brute force on small tables: odd rows, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratal.llm import decontaminate, fingerprint, jaccard_join, pieces, pii, pitman_yor, repeats, token_counts, toxicity, url_filter
from stratal.llm.components import components

MODEL, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
ODD = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "   "), (5, "A b\tc d E f g"), (5, "A b\tc d E f g"), (6, "x " * 3000), (None, "a b"), (7, "é日本 𝒳 \x00 ▁")]
# columns whose names the operators use themselves
CLASH = "doc_id long, text string, lang string, ids int, decoded int, toxicity int, leaks int, tree int, n_tokens int, email int, term int, host int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(1, "mail x.y@z.org now", "en", *[5] * 9), (2, None, None, *[None] * 9)], CLASH)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def made(seed, n=250):
    """Texts with near copies, exact copies, shared passages and short ones."""
    r, out = random.Random(seed), []
    for _ in range(n):
        if r.random() < 0.5 and out:
            w = r.choice(out).split()
            for _ in range(r.randint(0, 2)):
                if w:
                    w[r.randrange(len(w))] = r.choice("pqrst")
        else:
            w = [r.choice("abcdefghijklmnop") for _ in range(r.choice([0, 1, 4, 5, 7, 12, 30, 90]))]
        out.append(" ".join(w))
    return out


# op1
def test_token_trees():
    counter, r = token_counts.Counter(token_counts.read_ranks(RANKS)), random.Random(1)
    some = ["the ", "a", " ", "  ", "\n", "'s", "'ll", "12", "é", "!!", "x" * 9, "日本", "I'm "]
    for _ in range(400):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 300)))
        tree = token_counts.Tree.of(text, counter)
        for _ in range(4):
            a = r.randint(-2, len(text) + 2)
            b = a + r.randint(-1, 30)
            text = tree.edit(text, a, b, "".join(r.choice(some) for _ in range(r.randint(0, 40))), counter)
            assert (tree.tokens, tree.chars) == (len(counter.encoding.encode_ordinary(text)), len(text))


def test_token_counts_odd(odd, none, clash):
    ranks = token_counts.read_ranks(RANKS)
    edits = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end"), F.lit("zz ").alias("replacement")), F.lit(None)).cast(token_counts.EDITS)
    got = token_counts.edited(token_counts.with_trees(odd, ranks).withColumn("edits", edits), ranks).collect()
    counter = token_counts.Counter(ranks)
    assert len(got) == len(ODD) and all(r.n_tokens == len(counter.encoding.encode_ordinary(r.text)) for r in got)
    assert token_counts.with_trees(none, ranks).count() == 0
    assert token_counts.with_trees(clash, ranks).where("doc_id = 1").first().n_tokens > 0


def test_long_edit_touches_little():
    counter = token_counts.Counter(token_counts.read_ranks(RANKS))
    text = "some words and more " * 5000
    tree = token_counts.Tree.of(text, counter)
    tree.edit(text, 50_000, 50_010, "new", counter)
    assert tree.recounted < 1000


# op2
def test_fingerprints(spark, odd, none):
    texts = made(3)
    docs = sorted(enumerate(texts))
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in docs:
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, nxt)):
            exact = len(shingles(t) | shingles(other)) <= fingerprint.K
            assert value == pytest.approx(near(shingles(t), shingles(other)), abs=1e-9 if exact else 0.12)
    prints = Counter((t, got[i].fingerprint) for i, t in docs)
    assert len({t for t, _ in prints}) == len(prints)
    assert fingerprint.compare_with_edits(none).count() == 0
    assert fingerprint.compare_with_edits(odd).count() == len(ODD)


def test_sketches_merge(spark):
    df = spark.createDataFrame([(list(range(0, 900)), list(range(300, 1200)))], "a array<int>, b array<int>")
    hashed = lambda c: F.slice(F.sort_array(F.transform(c, lambda x: F.xxhash64(x))), 1, 128)
    got = df.select(fingerprint.merged(hashed("a"), hashed("b")).alias("m"), hashed(F.array_union("a", "b")).alias("u"), fingerprint.resemblance(hashed("a"), hashed("b")).alias("r"), fingerprint.distinct_count(hashed("a")).alias("n"), fingerprint.containment(hashed("a"), hashed("b")).alias("c")).first()
    assert got.m == got.u and abs(got.r - 0.5) < 0.15 and abs(got.n - 900) < 250 and abs(got.c - 2 / 3) < 0.2


# op3
def test_language_model(spark, odd, none):
    docs = list(enumerate(made(4, 120))) + [(1000, None)]
    got = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=1500).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter(w for i, t in docs if not out[i] for w in [*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        w = [*words(t), ""]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (out[i], len(w), sum(x in counts for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i].score <= 0
    held = [got[i] for i, _ in docs if out[i]]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.score(none).count() == 0 and pitman_yor.score(odd).count() == len(ODD)


def folds(n, modulus=5, held_out=1):
    """n ids that train and n that are held out."""
    out = {i: zlib.crc32(str(i).encode()) % modulus == held_out for i in range(20 * n + 100)}
    return [i for i in out if not out[i]][:n], [i for i in out if out[i]][:n]


def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a b", "c c a", "a", "a b c", "b a c b a c"]
    train, held = folds(40)
    # the last word of each: every known word, one unknown, and the end stands for itself
    starts = ["", "a ", "b a ", "zzz ", "c zzz ", "c c ", "a b a "]
    asked = [x + w for x in starts for w in ("a", "b", "c", "zzz", "")]
    rows = list(zip(train, texts, strict=False)) + list(zip(held, asked, strict=False))
    got = {r.doc_id: r.token_scores for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), by_token=True).collect()}
    for n, start in enumerate(starts):
        assert sum(10 ** got[i][len(start.split())] for i in held[5 * n : 5 * n + 5]) == pytest.approx(1, abs=1e-9), start


def seated(texts, strength, discount, sweeps, burn, seed):
    """The same model customer by customer: probabilities of a word after a context, averaged over sweeps."""
    r = random.Random(seed)
    vocabulary = {w for t in texts for w in t}
    #: by context (two words, one, none): dish -> sizes of tables
    rooms = {}

    def probability(w, context):
        if context is None:
            return 1 / (len(vocabulary) + 1)
        parent = None if context == () else context[1:]
        room = rooms.get(context, {})
        guests, held = sum(map(sum, room.values())), sum(map(len, room.values()))
        mine = room.get(w, [])
        return (sum(mine) - discount * len(mine) + (strength + discount * held) * probability(w, parent)) / (strength + guests)

    def sit(w, context):
        if context is None:
            return
        room = rooms.setdefault(context, {})
        tables = room.setdefault(w, [])
        parent = None if context == () else context[1:]
        fresh = (strength + discount * sum(map(len, room.values()))) * probability(w, parent)
        k = r.choices(range(len(tables) + 1), [z - discount for z in tables] + [fresh])[0]
        if k < len(tables):
            tables[k] += 1
        else:
            tables.append(1)
            sit(w, parent)

    def leave(w, context):
        if context is None:
            return
        tables = rooms[context][w]
        k = r.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            leave(w, None if context == () else context[1:])

    customers = [(w, tuple(c)) for t in texts for padded in [["<", "<", *t]] for w, c in zip(t, zip(padded, padded[1:], strict=False), strict=False)]
    for c in customers:
        sit(*c)
    asked = sorted(set(customers))
    total = dict.fromkeys(asked, 0.0)
    for n in range(burn + sweeps):
        for c in customers:
            leave(*c)
            sit(*c)
        if n >= burn:
            for c in asked:
                total[c] += probability(*c) / sweeps
    return total


def test_language_model_against_seats_one_by_one(spark):
    r, (train, _) = random.Random(31), folds(40)
    texts = [[r.choice("aaabbcdefgh") for _ in range(r.randint(3, 12))] for _ in range(30)] + [list("abcabcabd")] * 6
    got = pitman_yor.score(spark.createDataFrame([(i, " ".join(t)) for i, t in zip(train, texts, strict=False)], "doc_id long, text string"), samples=40, burn=10, common=2.0, by_token=True).collect()
    got = {x.doc_id: x.token_scores for x in got}
    want = seated([[*t, "."] for t in texts], 1.0, 0.75, 300, 30, 7)
    pairs = []
    for i, t in zip(train, texts, strict=False):
        padded = ["<", "<", *t, "."]
        pairs += [(got[i][k], math.log10(want[padded[k + 2], (padded[k], padded[k + 1])])) for k in range(len(t) + 1)]
    off = np.array([a - b for a, b in pairs])
    print(abs(off.mean()), np.abs(off).mean(), np.abs(off).max())
    assert abs(off.mean()) < 0.01 and np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.15


def test_tables_of_one_restaurant():
    """Mean numbers of tables against seats one by one, the parent's probabilities held."""
    strength, discount = 1.0, 0.75
    counts, share = [1, 2, 7, 30, 4], [0.05, 0.3, 0.2, 0.4, 0.0001]
    r, tables, total = random.Random(5), [[1] * 1 + [c - 1] * (c > 1) for c in counts], np.zeros(5)
    for n in range(6000):
        for w, c in enumerate(counts):
            for _ in range(c):
                k = r.choices(range(len(tables[w])), tables[w])[0]
                tables[w][k] -= 1
                if not tables[w][k]:
                    tables[w].pop(k)
                fresh = (strength + discount * sum(map(len, tables))) * share[w]
                k = r.choices(range(len(tables[w]) + 1), [z - discount for z in tables[w]] + [fresh])[0]
                tables[w][k : k + 1] = [tables[w][k] + 1] if k < len(tables[w]) else [1]
        if n >= 500:
            total += [len(t) for t in tables]
    copies = 3000  # of the restaurant, with keys of their own; each customer comes from a pair of its own
    c1 = np.tile(counts, copies)
    dish, family = np.repeat(np.arange(len(c1)), c1), np.repeat(np.arange(copies), 5)
    keys = [np.arange(n).astype(np.uint64) * np.uint64(7919) + np.uint64(k << 40) for k, n in enumerate((len(dish), len(dish), copies, len(c1)))]
    run = pitman_yor.Families(np.ones(len(dish), dtype=np.int64), dish, np.arange(len(dish)), family, np.tile(share, copies), tuple(keys), strength, discount)
    got = run.sampled(15, 10)["t1"].reshape(copies, 5).mean(axis=0) / 10
    assert got == pytest.approx(total / 5500, rel=0.04), (got, total / 5500)


@pytest.mark.parametrize("discount", [0.3, 0.75, 0.9])
def test_stirling_numbers(discount):
    rows = pitman_yor.stirling(discount)
    assert [math.exp(x) for x in rows[3]] == pytest.approx([(1 - discount) * (2 - discount), 3 * (1 - discount), 1])
    for c in (500, 2000):
        t = np.arange(1.0, c - 60)
        assert np.abs(pitman_yor.stirling_far(c, t, discount) - rows[c][: len(t)]).max() < 1e-6
    rng = np.random.default_rng(0)
    u, log_a, log_h = rng.random(60), np.log(rng.uniform(3, 5000, 60)), np.log(rng.uniform(1e-4, 0.5, 60))
    near = pitman_yor.drawn(np.full(60, 1500), log_a, log_h, np.full(60, 2.5), np.full(60, 900.0), u, discount)
    far = [int(pitman_yor._pick(pitman_yor._far(1500, a, h, 2.5, 900.0, discount), x)) for a, h, x in zip(log_a, log_h, u, strict=True)]
    assert np.abs(near - np.array(far)).max() <= 1 and (near == np.array(far)).mean() > 0.95


def test_random_numbers():
    key = np.arange(200_000).astype(np.uint64)
    assert pitman_yor.uniform(key, 3).mean() == pytest.approx(0.5, abs=0.003)
    for shape in (1.3, 9.0, 4000.0):
        x = pitman_yor.gamma(np.full(len(key), shape), key)
        assert x.mean() == pytest.approx(shape, rel=0.01) and x.var() == pytest.approx(shape, rel=0.03)


def test_scores_do_not_depend_on_layout(spark):
    r = random.Random(14)
    follow = {w: [r.randrange(3000) for _ in range(3)] for w in range(3000)}

    def chain():
        w = r.randrange(3000)
        for _ in range(40):
            yield f"w{w}"
            w = r.choice(follow[w])

    docs = spark.createDataFrame([(i, " ".join(chain())) for i in range(400)], "doc_id long, text string")
    few = {x.doc_id: x.score for x in pitman_yor.score(docs).collect()}
    many = {x.doc_id: x.score for x in pitman_yor.score(docs.orderBy(F.desc("text")).repartition(3), block_bytes=400).collect()}
    assert len(few) == 400 and all(few[i] == pytest.approx(many[i], abs=1e-9) for i in few)


def test_language_model_odd_rows_by_value(spark, odd):
    """Nulls and empty texts are the end alone; rows that repeat score alike; extra columns change nothing."""
    got = sorted((x.doc_id or 0, x.n_tokens, x.score) for x in pitman_yor.score(odd).collect())
    assert [x[:2] for x in got] == [(0, 3), (1, 8), (2, 1), (3, 1), (4, 1), (5, 8), (5, 8), (6, 3001), (7, 5)]
    assert got[2][2] == got[3][2] == got[4][2] and got[5] == got[6] and got[1][2] == got[5][2]
    extra = odd.selectExpr("*", "1 AS block", "2 AS score", "'x' AS ids", "3 AS answers")
    assert sorted((x.doc_id or 0, x.n_tokens, x.score) for x in pitman_yor.score(extra).collect()) == got


def test_common_contexts_come_from_all_blocks(spark):
    r = random.Random(15)
    # the late word is in the last third only, and no block of the first twenty has it
    docs = [(i, " ".join(f"x{r.randint(0, 5000)}" for _ in range(30)) + (" late late late" if i >= 200 else "")) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    blocks = pitman_yor.in_blocks(frame, 2000)
    assert blocks.count() > 20
    every = Counter(w for _, t in docs for w in [*words(t), ""])
    _, n, v, hot = pitman_yor.counted(blocks, 8, 5, 1)
    train = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*words(t), ""])
    assert (n, v) == (sum(train.values()), len(train))
    names = [w for w in every if w and every[w] * 1000 >= sum(every.values())]
    raw = " ".join(names).encode()
    want = set(pitman_yor.hashed(raw, np.array([0, len(raw)]))[0].tolist()) | {int(pitman_yor._END)}
    assert "late" in names and set(hot.tolist()) == want


def test_texts_are_read_three_times(spark, monkeypatch):
    """Counts, triples and scores; what words get from their parents' tables comes from the seatings alone."""
    asks, asked = [], pitman_yor.asked
    monkeypatch.setattr(pitman_yor, "asked", lambda *a: asks.append(a) or asked(*a))
    docs = spark.createDataFrame(list(enumerate(made(8, 60))), "doc_id long, text string")
    assert pitman_yor.score(docs, block_bytes=1500).count() == 60 and len(asks) == 2


def test_customers_of_words_are_the_tables_passed_on():
    buckets, words = 3, np.array([5, 4096 + 5, 9 * 4096 + 5, 2 * 4096 + 8], dtype=np.int64)  # bucket 2, by shards 5 and 8
    squeezed, planes = pitman_yor._squeezed, pitman_yor._planes
    passed = [squeezed(planes(np.diff(x, prepend=0)), planes(np.array(n))) for x, n in ((words[[0, 1]], [3, 1]), (np.sort(words[[0, 3]]), [2, 7]))]
    counts = []
    for mine in ([1, 0, 3], [2, 0]):
        shard = words[mine] % 4096
        payload = squeezed(planes(np.array(mine) + 10), planes(words[mine] // 4096), planes(shard // buckets, 2))
        counts.append(pitman_yor.pack(np.frombuffer(payload, dtype=np.uint8), *[np.zeros(0)] * 3))
    got = [pitman_yor.unpack(x) for x in pitman_yor._word_adder(2, buckets, counts, passed)]
    told = [[pitman_yor._whole(x).tolist() for x in pitman_yor._spread_out(g[0].tobytes())] for g in got]
    assert told == [[[11, 10, 13], [1, 5, 7]], [[12, 10], [0, 5]]]
    assert [g[k].tolist() for g in got for k in (1, 2)] == [[1, 5, 7], [1, 1, 1], [], []]
    assert [len(x) for x in pitman_yor.unpack(pitman_yor._word_adder(2, buckets, counts[:1], [])[0])[1:]] == [0, 0]


def test_distinct_numbers():
    r = np.random.default_rng(2)
    for x in (
        np.zeros(0, dtype=np.int64),
        np.array([7]),
        r.integers(0, 50, 3000),
        r.integers(0, 2**62, 3000),
        r.integers(0, 2**64, 500, dtype=np.uint64)[r.integers(0, 500, 3000)],
        # the same highest bits, so that places cannot be told by them
        np.uint64(2**63) + r.integers(0, 9, 3000).astype(np.uint64),
        np.array([2**64 - 1, 0, 2**64 - 2, 2**64 - 1], dtype=np.uint64),
    ):
        got, want = pitman_yor._distinct(x), np.unique(x, return_index=True, return_inverse=True)
        assert got[0].dtype == x.dtype and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    x = r.integers(0, 40, 3000)
    assert np.array_equal(pitman_yor._order(x, 6), np.argsort(x, kind="stable"))
    assert np.array_equal(pitman_yor._whole(pitman_yor._planes(np.array([0, 255, 256, 2**39]))), [0, 255, 256, 2**39])


@pytest.mark.parametrize("alike", [True, False])
def test_dishes_drawn_together_are_drawn_alone(alike):
    r = np.random.default_rng(3)
    c = np.concatenate([r.integers(1, 60, 400), r.integers(60, 2048, 60), r.integers(2049, 90_000, 12), [2048, 2049, 0]])
    n = len(c)
    log_a, log_h, u = np.log(r.uniform(1, 500, n)), np.log(r.uniform(1e-5, 0.5, n)), r.random(n)
    alpha, beta = (None, None) if alike else (r.uniform(0.5, 90, n), r.uniform(90, 900, n))
    one = lambda x, i: None if x is None else x[i : i + 1]
    alone = [int(pitman_yor.drawn(*(one(x, i) for x in (c, log_a, log_h, alpha, beta, u)), 0.75)[0]) for i in range(n)]
    assert pitman_yor.drawn(c, log_a, log_h, alpha, beta, u, 0.75).tolist() == alone


# op4
def test_url_filter(spark):
    r = random.Random(5)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q", "ftp://net", "x://y://z/p#f", "http://org/fr/", "http://a.org?x/fr/"]
    urls += [f"https://{r.choice('abcdefgh')}{i % 70}.{r.choice(['example.net', 'example.com', 'org'])}{r.choice(['', '/', '/en/1', '/de/2', '/fr/', '?a', '#b'])}" for i in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (url_filter.Rule("net", "/", False), url_filter.Rule("example.net", "/en/", True), url_filter.Rule("example.com", "/de/", False), url_filter.Rule("org", "/fr/", True))
    listed = F.xxhash64("key") % 3 == 0
    bad = {x.key for x in pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct().where(listed).collect()}
    got = {x.page_id: x for x in url_filter.filter_urls(pages, rules, listed).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.text), default=None)
        verdict = ("allow" if rule.allow else "block") if rule else "block" if host in bad else "allow"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule.text, verdict)
    assert url_filter.filter_urls(pages.limit(0), rules, listed).count() == 0
    assert url_filter.filter_urls(pages.withColumn("host", F.lit(1)), rules, listed).count() == len(urls)


@pytest.mark.parametrize("max_bits", [1 << 27, 512])
def test_cascade_is_exact(spark, max_bits):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys, rate=0.2, max_bits=max_bits)
    assert (cascade.shards > 1) == (max_bits == 512) and len(cascade.levels) > 2
    assert cascade.mark(keys, F.col("key"), "found").where("found <> listed").count() == 0


# op5
def test_grammar():
    g = toxicity.Grammar({"idiot$": 3.0, "ach": 2.5})
    score = lambda text: g.features(text.encode().lower().split())[1]
    assert score("you idiot.") > score("an idiot.") > score("not an idiot.") > 0
    assert score("he said an idiot.") < score("he an idiot.") and score("achlich da.") > 0 and score("good day. you said.") == 0
    # a state ends with its clause
    assert score("he said this. an idiot.") == score("an idiot.")
    # threats: an intent and a verb, or a verb and a target; a verb alone is nothing
    assert score("burn the wood.") == score("fire can burn.") == 0 and score("we will burn it.") > 0 and score("burn you.") > score("will burn.")
    assert score("we will not burn it.") < score("we will burn it.") and score("will the long old wide house burn.") == 0
    assert score("kill. you.") == 0 and score("they said we will kill him.") < score("they think we will kill him.")
    # clauses are read whole
    for n in (1, 70, 500):
        assert score("you " + "so " * n + "idiot.") == score("you idiot.") == 4.5
        assert score("he said " + "so " * n + "idiot " + "so " * n + "idiot.") == 2 * score("he said idiot.")
    assert len(toxicity.MACHINE) == 2 * 6 * 2 * 4 * 2


def test_composition_is_the_parts_side_by_side():
    r = random.Random(41)
    for _ in range(300):
        states = start = tuple(0 for _ in toxicity.PARTS)
        at = toxicity.STATES.index(start)
        for kind in (r.randrange(7) for _ in range(r.randint(1, 25))):
            steps = [p[s, kind] for p, s in zip(toxicity.PARTS, states, strict=True)]
            states = tuple(x[0] for x in steps)
            at, emitted, factor = toxicity.MACHINE[at][kind]
            assert toxicity.STATES[at] == states and emitted == max(x[1] for x in steps) and factor == pytest.approx(math.prod(x[2] for x in steps))


def test_features_against_clauses_one_by_one():
    g, r = toxicity.Grammar({"idiot$": 3.0, "scum$": 2.0}), random.Random(42)
    for _ in range(300):
        ws = [r.choice(["you", "not", "said", "will", "kill", "idiot", "scum", "so", "the"]) + r.choice(["", "", "", ".", ","]) for _ in range(r.randint(0, 40))]
        clauses, scores, insults = [[]], [], 0
        for w in ws:
            clauses[-1].append(w)
            if w[-1] in ".,":
                clauses.append([])
        for c in clauses:
            states, score = [0] * 5, 0.0
            for w in (w.strip(".,") for w in c):
                kind = {"idiot": toxicity.INSULT, "scum": toxicity.INSULT}.get(w, toxicity._KINDS.get(w, toxicity.OTHER))
                steps = [p[s, kind] for p, s in zip(toxicity.PARTS, states, strict=True)]
                states, emitted = [x[0] for x in steps], max(x[1] for x in steps)
                insults += emitted == toxicity.INSULTED
                score += math.prod(x[2] for x in steps) * {0: 0, 1: {"idiot": 3.0, "scum": 2.0}.get(w), 2: toxicity.THREAT}[emitted]
            scores.append(score)
        top = sorted([s for s in scores if s], reverse=True) + [0.0, 0.0]
        got = dict(zip(toxicity.FEATURES, g.features([w.encode() for w in ws]), strict=True))
        assert got["total"] == pytest.approx(math.log1p(sum(scores))) and (got["most"], got["second"]) == pytest.approx((top[0], top[1]))
        assert got["insults"] == pytest.approx(math.log1p(insults)) and got["clauses"] == pytest.approx(math.log1p(len(top) - 2))


def test_toxicity_odd(spark, odd, none, clash):
    model = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, label int"))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0 and toxicity.score(clash, model).count() == 2
    by_id = {}
    for x in got:
        by_id.setdefault(x.text or "", set()).add(x.toxicity)
    assert all(len(v) == 1 for v in by_id.values()) and by_id[""] == by_id["   "]
    long = spark.createDataFrame([(1, "you " + "so " * 700_000 + "idiot."), (2, "you idiot. " + "so " * 700_000)], "doc_id long, text string")
    assert len({round(x.toxicity, 12) for x in toxicity.score(long, model).collect()}) == 1


def test_toxicity_held_out(spark, tiny):
    from stratal.llm import queries

    sf = tiny.replace("sf0.001", "sf0.01")
    got = queries.queries()["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [r for r in got if r.toxic == 1]
    assert sum(r.score > 0.5 for r in hit) > 0.6 * len(hit) and sum(r.predicted for r in got if r.toxic == 0) <= 1


# op6
def spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_entities(spark):
    r = random.Random(6)
    some = ["a", "@", ".", "-", "+", "1", "2", " ", "\x02", "\x01", "\x03", "é", "4111111111111111", "1.2.3.4", "x@y.z", "0", "(", "_", "\n", "255", "256", "𝒳"]
    rows = [(i, "".join(r.choice(some) for _ in range(r.randint(0, 60)))) for i in range(1500)] + [(9998, None), (9999, "1 " * 20_000 + "a." * 20_000)]
    got = pii.with_entities(spark.createDataFrame(rows, "doc_id long, text string")).select("text", pii.digest(pii.KINDS).alias("d")).collect()
    assert all(x.d == spans(x.text or "") for x in got)


def test_disclosing_terms(spark, none, clash):
    rows = [(i, f"plain text of no note {i}") for i in range(200)]
    rows += [(1000 + i, "call zebulon42 quagmire at q.z@mail.org about the text") for i in range(4)]
    rows += [(2000 + i, "the text about") for i in range(50)] + [(3000, None)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == len(rows)
    clean = {r.doc_id: r.t for r in found.select("doc_id", pii.sanitised(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    assert clean[1000] == "[TERM] [NUMBER] [TERM] [TERM] [EMAIL] about the text".replace("[TERM] [NUMBER] [TERM] [TERM]", "[TERM] [NUMBER] [TERM] [TERM]")
    assert clean[5] == rows[5][1] and clean[3000] == ""
    assert pii.find_personal_data(none).count() == 0 and pii.find_personal_data(clash).where("size(email) = 1").count() == 1


def test_disclosing_terms_at_any_distance(spark):
    far = " ".join(["plain"] * 40)
    rows = [(i, f"{far} note") for i in range(300)]
    rows += [(1000 + i, f"\tZebulon {far} (at q.z@mail.org) {far} zebulon, quagmire \U0001d4b3 zebulon") for i in range(4)]
    rows += [(2000, f"{far} zebulon and Quagmire {far}"), (2001, "zebulon")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    terms = {r.doc_id: [(s.start, s.end, s.value) for s in r.term] for r in found}
    assert len(found) == len(rows) and not any(terms[i] for i in range(300))
    n_t, docs = Counter(w for _, t in rows for w in set(words(t))), len(rows)
    degree = {w: math.log2(docs / n_t[w]) / math.log2(docs / 4) for w in n_t}  # n(e,t) = n(e) for the words beside
    assert degree["zebulon"] >= 0.9 and degree["quagmire"] >= 0.9 > degree["plain"]
    told = {w for w in n_t if degree[w] >= 0.9 and w in words(rows[300][1]) and w not in words("(at q.z@mail.org)")} | {"(at"}
    for i, t in rows:
        want = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0d]+", t) if m[0].lower() in told]
        assert terms[i] == want, i


def shuffled(spark):
    """Bytes that all stages so far have written to shuffle files."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_terms_do_not_move(spark):
    r = random.Random(66)
    rows = [(i, " ".join(f"{r.getrandbits(64):x}" for _ in range(200))) for i in range(1000)]
    rows += [(2000 + i, "call zebulon42 quagmire at q.z@mail.org about it") for i in range(4)] + [(3000, "zebulon42 again"), (3001, None), (3002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, moved = {}, {}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (before, "-1"):  # few hits, and more than a broadcast takes
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            found = pii.find_personal_data(docs)
            at = shuffled(spark)
            found.write.format("noop").mode("overwrite").save()
            moved[threshold] = shuffled(spark) - at
            kept[threshold] = sorted((x.doc_id, x.text, x.spans) for x in found.withColumn("spans", pii.digest((*pii.KINDS, "term"))).collect() if x.text)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept[before] == kept["-1"] and len(kept["-1"]) == len(rows) - 2
    assert {i: s for i, _, s in kept["-1"]}[3000] == "term:0:9" and {i: s for i, _, s in kept["-1"]}[2000].startswith("email:27:39,term:0:4,term:5:14")
    whole = sum(len(t or "") for _, t in rows)
    assert moved["-1"] < 0.1 * whole and moved["-1"] < 2 * max(moved[before], 0.01 * whole)


def test_sieve_loses_no_key(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)], "k string")
    for most, least, top in ((1 << 27, 500, 600), (64, 500, 3500)):  # sized by the keys; far too small for them
        test = pii._sieve(keys, most=most)
        passed = {x.k for x in spark.createDataFrame([(f"k{i}",) for i in range(3500)], "k string").where(test(F.col("k"))).collect()}
        assert {f"k{i}" for i in range(500)} <= passed and least <= len(passed) <= top
    assert spark.createDataFrame([("k1",)], "k string").where(pii._sieve(keys.limit(0))(F.col("k"))).count() == 0


# op7
def test_leaks(spark, odd, none, clash):
    r = random.Random(7)
    items = [(i, " ".join(r.choice("abcdefghijk") for _ in range(r.choice([2, 5, 9, 30, 70])))) for i in range(40)] + [(99, None), (98, " ")]
    docs = []
    for i in range(120):
        w = [r.choice("lmnopqrstuvwxyz") for _ in range(r.choice([0, 3, 40, 600]))]
        for _ in range(r.randint(0, 2)):
            part = items[r.randrange(40)][1].split()
            if r.random() < 0.4:
                part = part[r.randint(0, len(part) // 3) :]
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((i, " ".join(w)))
    got = {(x.doc_id, x.item_id): x.n_found for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), part_bytes=900).collect()}
    want = {}
    for (d, t), (i, q) in itertools.product(docs, items):
        w, v = words(t), words(q)
        n = min(5, len(v))
        have = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        both = have & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if both and len(both) >= 0.8 * len(have):
            want[d, i] = len(both)
    assert got == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.with_leaks(odd, empty).where("size(leaks) = 0").count() == len(ODD)
    assert decontaminate.find_leaks(none, empty).count() == 0 and decontaminate.with_leaks(clash, empty).count() == 2


# op8
def linked(docs):
    ids, parent = [i for i, _ in docs], {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in docs}
    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("most", [500, 6])
def test_jaccard_join(spark, monkeypatch, most):
    docs = list(enumerate(made(8)))
    whole = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda *a: whole(*a, most=most))
    got = jaccard_join.linked(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=1200).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(docs)


def test_jaccard_odd(spark, odd, none):
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in jaccard_join.linked(odd).collect())
    assert got == [(0, 0, 1), (1, 1, 3), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 1, 3), (5, 1, 3), (6, 6, 1), (7, 7, 1)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_of_each(odd).collect()) == [0, 1, 2, 3, 4, 6, 7]
    assert jaccard_join.linked(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "")] * 2, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(twice).collect()) == [1, 2, 2]


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 300), r.randint(100, 300)) for _ in range(120)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# op9
def test_pieces(spark, odd, none, clash):
    vocabulary, r = pieces.load(MODEL), random.Random(10)
    codec = pieces.Codec(vocabulary)
    best = lambda ids: sum(vocabulary.scores[i] for i in ids)
    table = {p: s for p, s, k in zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True) if k == pieces.NORMAL}
    some = ["the", "Hello", " ", "  ", "ing", "tion", ".", "er", "   "]
    for _ in range(300):
        text = "".join(r.choice(some) for _ in range(r.randint(0, 8)))
        ids = np.frombuffer(codec.encode(text), dtype=np.int32).tolist()
        marked = ("▁" + text.replace(" ", "▁")) if text else ""
        score = [0.0] + [-1e300] * len(marked)
        for j in range(1, len(marked) + 1):
            score[j] = max((score[i] + table[marked[i:j]] for i in range(max(0, j - 16), j) if marked[i:j] in table), default=-1e300)
        assert best(ids) == pytest.approx(score[-1]) and codec.decode(np.array(ids, dtype=np.int32)) == text
    for text in ["▁", "a▁ b", "\x00▁", "𝒳é\n\t日", "a" * 500, " lead", "trail ", "\ufffd"]:
        assert codec.decode(np.frombuffer(codec.encode(text), dtype=np.int32)) == text
    got = pieces.decode(pieces.encode(odd, vocabulary), vocabulary).collect()
    assert len(got) == len(ODD) and all(x.decoded == (x.text or "") for x in got)
    once = pieces.encode_and_decode(odd, vocabulary).collect()
    assert sorted((x.text or "", x.ids, x.decoded) for x in once) == sorted((x.text or "", x.ids, x.decoded) for x in got)
    assert pieces.encode(none, vocabulary).count() == 0 and pieces.encode(clash, vocabulary).count() == 2


def _message(*fields):
    """A protocol buffer message of (number, value): text and bytes, floats, whole numbers."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, v in fields:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def test_true_unigram_model():
    """A model with log scores of its own against the public library."""
    import sentencepiece

    r = random.Random(21)
    some = sorted({"".join(r.choice("abcdé") for _ in range(r.randint(1, 5))) for _ in range(150)} - {"e"})
    known = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]]
    known += [(p, r.uniform(-9, -1), 1) for x in some for p in (x, pieces.MARK + x)] + [(pieces.MARK, -2.5, 1)]
    model = b"".join(_message((1, _message((1, p), (2, float(s)), (3, k)))) for p, s, k in known)
    model += _message((2, _message((3, 1), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.Codec(pieces.Vocabulary.read(model))
    texts = ["".join(r.choice("abcdé  xyz日") for _ in range(r.randint(1, 90))) for _ in range(400)] + ["x" * 300, "a" * 5000, " ", "  a"]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        mine = np.frombuffer(ids, dtype=np.int32).tolist()
        score = lambda found: sum(codec.scores[i] if i > 258 else codec.lost for i in found)
        assert mine == theirs.encode(text) or score(mine) == pytest.approx(score(theirs.encode(text)), abs=1e-3)
        assert codec.decode(np.array(mine, dtype=np.int32)) == text


def test_chunks_together_and_alone():
    """Segmenting many chunks at once gives what one at a time gives."""
    codec, r = pieces.Codec(pieces.load(MODEL)), random.Random(22)
    texts = ["".join(r.choice(["th", "e", " ", "  ", "▁", "é", "日", "𝒳", "\n", "ing", "0", "q" * 70]) for _ in range(r.randint(0, 40))) for _ in range(300)]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, dtype=np.int32).tolist() == [i for c in (codec._chunks(" " + text) if text else []) for i in codec._best(c)]
    long = "wörd " * 300_000 + "z" * 100_000
    ids = np.frombuffer(codec.encode(long), dtype=np.int32)
    assert codec.decode(ids) == long


def test_trie():
    r = random.Random(11)
    keys = {bytes(r.choice(b"ab\xc3\xe2\x81") for _ in range(r.randint(1, 6))): i for i in range(400)}
    t = pieces.DoubleArray(keys)
    for probe in [*keys, *(bytes(r.choice(b"abc\xc3\xe2") for _ in range(r.randint(1, 6))) for _ in range(400))]:
        state = 0
        for b in probe:
            to = t.base[state] + b + 1
            if t.check[to] != state or to == 0:
                state = -1
                break
            state = to
        assert (t.value[state] if state >= 0 else -1) == keys.get(probe, -1)


# op10
def test_repeats(spark, odd, none):
    r = random.Random(12)
    passages = ["".join(r.choice("abc dé") for _ in range(r.randint(10, 80))) for _ in range(12)]
    texts = []
    for _ in range(250):
        k = r.random()
        t = r.choice("ab") * r.randint(0, 90) if k < 0.2 else ("abcd" * 40)[: r.randint(0, 100)] if k < 0.3 else r.choice(texts) if k < 0.5 and texts else "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 6)))
        texts.append(t)
    raw = [t.encode() for t in texts]
    seen = Counter(t[i : i + 20] for t in raw for i in range(len(t) - 19))
    got = {x.doc_id: x for x in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length=20, gram=6, block_bytes=1500).collect()}
    for n, t in enumerate(raw):
        gone = bytearray(len(t))
        for i in range(len(t) - 19):
            if seen[t[i : i + 20]] > 1:
                gone[i : i + 20] = b"\1" * 20
        assert bytes(got[n].kept) == bytes(x for x, g in zip(t, gone, strict=True) if not g)
        assert sum(s.end - s.start for s in got[n].spans) == sum(gone)
    assert repeats.remove_repeats(none).count() == 0 and repeats.remove_repeats(odd).count() == len(ODD)


# the pipeline
def test_pipeline(spark, tiny, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    final = p.run(spark, tiny)
    kept = {r.doc_id: r for r in final.collect()}
    assert 100 < len(kept) < docs.count() and all(r.n_tokens == len(r.ids) for r in kept.values())
    ids = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    rest = docs.join(ids, "doc_id")
    assert decontaminate.find_leaks(rest, spark.read.parquet(f"{tiny}/benchmark.parquet")).count() == 0
    assert jaccard_join.linked(rest.select("doc_id", "text")).where("doc_id <> component_id").count() == 0
    plain = rest.where(~F.col("text").rlike("[0-9@]")).collect()
    assert plain and all(kept[r.doc_id].text == r.text for r in plain)


@pytest.mark.parametrize("rows", [[], [(2, None, "en", "s", 0), (3, "", None, None, None), (3, "", None, None, None), (4, "x", "en", "s", 1)]])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == len(rows)

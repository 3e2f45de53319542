"""Every corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from flowmill.llm import decontaminate, lm, media, minhash, packing, quality, sharding, suffix, toxicity, warc

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, id int, part int, class_id string"
WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


LONG = prose(1, 400)
NEAR = " ".join(LONG.split()[:200] + ["changed"] + LONG.split()[201:])
TEXTS = {0: LONG, 1: LONG, 2: NEAR, 3: None, 4: "", 5: "  \n ", 6: "a b", 7: prose(2, 300), 8: "é" * 300, 9: prose(3, 6000), 10: "x" * 500, 11: "a b"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, None, "s", 1, 7, 8, 9, "z") for k, t in TEXTS.items()] + [(None, "no key here at all", None, None, None, None, None, None, None), (7, TEXTS[7], None, "s", 1, 7, 8, 9, "z")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_minhash(docs, none):
    got = sorted((r.doc_id, r.class_id) for r in minhash.classes(docs).collect() if r.doc_id is not None)
    classes = dict(got)
    assert len(got) == 13 and classes[1] == classes[2] == 0 and classes[11] == 6 and classes[3] == 3 and classes[7] == 7
    assert minhash.classes(none).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 3, 4, 5, 6, 7, 8, 9, 10, None]))


def test_minhash_of_texts_without_a_key_or_with_another_texts(spark):
    a, b, c = prose(41, 300), prose(42, 300), prose(43, 300)
    rows = [(1, a), (None, a), (None, a + " end"), (2, b), (9, b + " end"), (9, c), (3, c + " end"), (9, c), (None, "alone without a key"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), str(r.class_id)) for r in minhash.classes(docs).collect()))
    assert got == sorted([("1", "1"), ("None", "1"), ("None", "1"), ("2", "2"), ("9", "2"), ("9", "3"), ("3", "3"), ("9", "3"), ("None", "None"), ("4", "4")])
    kept = sorted(((str(r.doc_id), str(r.text)) for r in minhash.one_of_each(docs).collect()))
    assert kept == sorted([("1", a), ("2", b), ("3", c + " end"), ("None", "alone without a key"), ("4", "None")])


def all_pairs_classes(spark, docs, texts, near):
    """Classes by comparing all pairs that near(a, b) allows."""
    idf = minhash.bucket_weights(minhash.document_frequencies(docs, "text"), len(texts))
    sets = []
    for t in texts:
        _, h, n = minhash.shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        sets.append((h, minhash.weights(h, n, idf)))
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if near(a, b) and minhash.weighted_jaccard(*sets[a], *sets[b]) >= 0.8:
                x, y = sorted((want[a], want[b]))
                want = [x if w == y else w for w in want]
    return dict(enumerate(want))


def test_minhash_links_between_rows_of_different_leaders(spark):
    """Chains of edits, whose ends reach the threshold only with each other, against all pairs compared."""
    rng, texts = np.random.default_rng(5), []
    for chain in range(40):
        words = prose(100 + chain, 300).split()
        for _ in range(6):
            texts.append(" ".join(words))
            for k in rng.choice(300, 4 + chain % 4, replace=False):
                words[k] = f"edit{rng.integers(1 << 40)}"
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = all_pairs_classes(spark, docs, texts, lambda a, b: order[a] // 6 == order[b] // 6)
    assert len(set(want.values())) < len(texts) - 40
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want


def test_minhash_in_crowded_buckets(spark):
    """A passage in many texts, and a large group of copies with one to six edits, against all pairs compared."""
    rng, texts = np.random.default_rng(6), []
    passage, base = prose(300, 100), prose(301, 200).split()
    for k in range(150):
        texts.append(f"{passage} {prose(400 + k, 60)}")
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, 1 + k % 6, replace=False):
            words[at] = f"edit{rng.integers(1 << 40)}" if k % 5 else f"shared{at}"
        texts.append(" ".join(words))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = all_pairs_classes(spark, docs, texts, lambda a, b: min(order[a], order[b]) >= 150)
    assert 150 + 10 < len(set(want.values())) < 300 - 30
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == want


def test_links_beyond_the_leader_are_found(spark):
    """In one crowded bucket 0 leads and is linked to 1; 2 is near 1 only; 3 near none; the others have nothing in common."""
    members = {0: range(100), 1: [*range(9, 100), *range(200, 209)], 2: [*range(18, 100), *range(200, 218)], 3: [*range(40, 100), *range(300, 340)]}
    members |= {k: range(1000 * k, 1000 * k + 100) for k in range(4, 40)}
    sets = [(k, bytearray(minhash.packed(np.array(sorted(m), np.uint64))), bytearray(np.ones(len(m), np.uint32).tobytes())) for k, m in members.items()]
    sets = spark.createDataFrame(sets, "id long, h binary, n binary")
    buckets = spark.createDataFrame([(7, k, 100.0, 40) for k in members], "key long, id long, total double, n long")
    idf = spark.sparkContext.broadcast(np.ones(minhash.BUCKETS, np.float32))
    assert {r.id: r.label for r in minhash.linked(buckets, sets, idf, 0.8).collect()} == {0: 0, 1: 0, 2: 0}


def test_idf_means_the_same_beside_many_rare_shingles():
    """A passage in a tenth of the documents weighs the same whether each bucket holds 2 or 5,000 rare shingles."""
    rng = np.random.default_rng(0)
    for documents, rare in ((10_000, 2), (10_000_000, 5_000)):
        frequency = rng.poisson(rare, minhash.BUCKETS)
        frequency[5] += documents // 10
        w = minhash.bucket_weights(frequency, documents)
        assert w[5] == pytest.approx((1 + np.log(10)) ** 0.5, rel=0.01) and np.median(w) == pytest.approx((1 + 16 * np.log(2)) ** 0.5, rel=0.01)


def test_weighted_jaccard():
    assert minhash.weighted_jaccard(np.array([1, 2, 3], np.uint64), np.array([1, 2, 1], np.float32), np.array([2, 3, 4], np.uint64), np.array([1, 1, 2], np.float32)) == pytest.approx(2 / 6)
    assert (minhash.unpacked(minhash.packed(np.array([0, 5, (1 << 48) - 1], np.uint64))) == [0, 5, (1 << 48) - 1]).all()


def test_sampling_agrees_with_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(1, 1 << 48, 3000).astype(np.uint64)
    hits = 0
    for k in range(40):
        a, b = np.sort(h[60 * k : 60 * k + 50]), np.sort(h[60 * k + 10 : 60 * k + 60])
        both = np.r_[a, b]
        _, s = minhash.samples(np.repeat([0, 1], 50), both, np.ones(100, np.float32), 2)
        hits += (s[0] == s[1]).sum()
    assert hits / (40 * 30) == pytest.approx(40 / 60, abs=0.05)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 50)], "a long, b long")
    assert {r.id: r.label for r in minhash.components(edges).collect()} == {**dict.fromkeys(range(21), 0), 40: 40, 50: 40}


def test_sharding(docs, none):
    got = sharding.shard_by_bytes(docs, 3).collect()
    assert len(got) == 14 and sharding.shard_by_bytes(none, 3).count() == 0
    size = lambda t: len((t or "").encode()) + 8
    assert all(r.size == size(TEXTS[r.doc_id]) and r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    keys = [(-1 if r.doc_id is None else r.doc_id, r.shard) for r in got]
    assert [s for _, s in sorted(keys)] == sorted(s for _, s in keys)


def test_classifiers(docs, none, labels):
    for module in (quality, toxicity):
        model = module.train(docs, labels)
        out = module.score(docs, model, out="score")
        got = out.collect()
        assert len(got) == 14 and all(0 <= r.score <= 1 for r in got) and set(out.columns) == set(docs.columns)
        assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1
        assert module.score(none, model).count() == 0
        assert isinstance(module.train(none, labels), float) and module.score(docs, 0.5).first().score == 0.5


def test_classifiers_learn():
    good, bad = [prose(k, 60) for k in range(60)], [("ZZ!! " + WORDS[k % 10].upper() + "!! ") * 30 for k in range(60)]
    y = np.array([1, 0] * 50, np.float32)
    net = quality.Net().fit([t.encode() for pair in zip(good[:50], bad[:50], strict=True) for t in pair], y, epochs=15)
    data, at = toxicity.joined(good[50:] + bad[50:])
    got = net.score(data, at)
    assert got[:10].min() > 0.5 > got[10:].max()
    toxic = [t + " you idiot scum" for t in good]
    model = toxicity.fit([t for pair in zip(good[:50], toxic[:50], strict=True) for t in pair], np.array([0, 1] * 50))
    data, at = toxicity.joined(good[50:] + toxic[50:])
    got = model.score(data, at)
    assert got[:10].max() < 0.5 < got[10:].min()


def test_capped_samples_keep_the_odds(spark):
    docs = spark.createDataFrame([(k, "the same words in every text") for k in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 10 != 0), int(k % 10 == 0)) for k in range(1000)], "doc_id long, quality int, toxic int")
    first = docs.limit(1)
    for good, bad in ((1000, 1000), (100, 100), (40, 60)):  # no cap binds, one, both
        value = quality.score(first, quality.train(docs, labels, most_good=good, most_bad=bad)).first().score
        assert abs(value - 0.9) < 0.04, (good, bad, value)
        value = toxicity.score(first, toxicity.train(docs, labels, most_toxic=bad, most_ordinary=good)).first().score
        assert abs(value - 0.1) < 0.04, (good, bad, value)


def test_network_gradient():
    """Of every kind of parameter, the filters and the bytes' embedding among them, against differences of the loss."""
    rng = np.random.default_rng(1)
    net = quality.Net(dims=3, filters=4, hidden=3)
    data, at = toxicity.joined([prose(4, 300), "short", prose(5, 90)])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, got = net.forward(data, at)
    d = np.array([1.0, -0.5, 0.7])
    g = net.gradient(got, d)
    loss = lambda: net.forward(data, at)[0] @ d
    assert set(g) == set(net.p)
    for k, slope in g.items():
        for _ in range(4):
            where = (ord("e"), int(rng.integers(3))) if k == "bytes" else tuple(int(rng.integers(n)) for n in net.p[k].shape)
            value = net.p[k][where]
            net.p[k][where] = value + 1e-5
            up = loss()
            net.p[k][where] = value - 1e-5
            down = loss()
            net.p[k][where] = value
            assert (up - down) / 2e-5 == pytest.approx(slope[where], rel=1e-2, abs=1e-3), k


def test_network_sees_whole_texts_in_pieces():
    """The answers of a few blocks at a time equal those of all, and the network written out window by window."""
    net = quality.Net(dims=3, filters=4, hidden=3)
    data, at = toxicity.joined([prose(6, 900), "", "x", prose(7, 500), prose(8, 200)])
    whole = net.forward(data, at)[0]
    assert all(np.allclose(net.logits(data, at, piece), whole, atol=1e-5) for piece in (1, 2, 3, 5, 1000))
    p, f = net.p, net.filters
    kernel = np.concatenate([p["conv"][:, :f], p["conv"][:, f:]])
    for k in range(len(at) - 1):
        text = data[at[k] : at[k + 1]]
        blocks = max(1, -(-(len(text) + quality.STRIDE) // quality.BLOCK))
        padded = np.r_[text, np.zeros(blocks * quality.BLOCK - len(text), np.uint8)]
        answers = [np.maximum(p["bytes"][padded[i : i + quality.WIDTH]].reshape(-1) @ kernel + p["conv_b"], 0) for i in range(0, len(padded) - quality.WIDTH + 1, quality.STRIDE)]
        per = quality.BLOCK // quality.STRIDE
        block = [np.max(answers[i * per : (i + 1) * per], axis=0) for i in range(blocks)]
        chunks = [np.maximum(x, y) for x, y in zip(block, block[1:], strict=False)] or block
        h = [np.maximum(c @ p["w1"] + p["b1"], 0) for c in chunks]
        assert np.concatenate([np.mean(h, axis=0), np.max(h, axis=0)]) @ p["w2"] + p["b2"][0] == pytest.approx(whole[k], abs=1e-4)


def test_examples_are_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, "word " * (10 if k % 2 else 2000)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(40)], "doc_id long, quality boolean")
    sample, _ = quality.labelled_sample(docs, labels, "quality", {1: 100, 0: 100}, lambda k: k >= 0, most_bytes=3200)
    assert sample and sum(len(t) for t, _ in sample) <= 3200 and all(len(t) == 50 for t, _ in sample)


def plain_kneser_ney(chains, grams):
    """P of each n-gram's last byte from dictionaries; chains: by order from 1, Counter of n-grams (texts)."""
    p = dict.fromkeys(grams, 1 / 256)
    for order, counts in enumerate(chains, 1):
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.75
        total, kinds = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        discount_left = min(min(counts.values()), discount)
        for g in grams:
            own = g[-order:]
            share = max(counts[own] - discount, 0) / total[own[:-1]] if own in counts else 0.0
            p[g] = share + (discount_left * kinds[own[:-1]] / total[own[:-1]] if total[own[:-1]] else 1.0) * p[g]
    return p


def test_kneser_ney_equals_plain_counting(monkeypatch):
    texts = [prose(800 + k, 30) + (" you fool  of" if k % 3 == 0 else " You all") for k in range(30)]
    y = np.array([int(k % 3 == 0) for k in range(30)])
    pad = lambda t: b"\0" * 4 + b" " + b" ".join(t.lower().encode().split()) + b" "
    grams_of = lambda t: [pad(t)[i - 4 : i + 1] for i in range(5, len(pad(t)))]
    assert toxicity.ORDER == 5 and toxicity.OWN == 3
    whole = [Counter(g for t, b in zip(texts, y, strict=True) if b == c for g in grams_of(t)) for c in (0, 1)]
    chains, threes = [], set()
    for top in whole:
        chain = [top]
        for order in (4, 3):
            chain.insert(0, Counter(g[-order:] for g in chain[0]))
        chains.append(chain)
        threes |= set(chain[0])
    shared = [Counter(g[-2:] for g in threes)]
    shared.insert(0, Counter(g[-1:] for g in shared[0]))
    model = toxicity.counted(texts, y)
    asked = texts[0] + " unseen words"
    keys, word, row = toxicity.running(*toxicity.joined([asked]))
    grams = grams_of(asked)
    assert len(keys) == len(grams) and (np.bincount(word) == [len(w) + 1 for w in asked.split()]).all() and set(row) == {0}
    for got, chain in zip(model.log_likelihoods(keys), chains, strict=True):
        want = plain_kneser_ney([*shared, *chain], grams)
        assert got == pytest.approx([np.log(want[g]) for g in grams])
    assert model.difference(*toxicity.joined(["you fool of", "you all", ""]))[0] > 0


def test_packing(docs, none):
    got = packing.pack(docs, PATH, 64, 2).collect()
    assert packing.pack(none, PATH, 64, 2).count() == 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    for k, text in TEXTS.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: (r.piece, r.sequence_id))
        if k == 7:
            own = own[::2]
        assert sum(r.length for r in own) == len(ids) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
        assert all(r.length == 64 for r in own[1:])
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def optimum(sizes, capacity):
    best = len(sizes)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= sizes[k]:
                place(k + 1, [*room[:i], room[i] - sizes[k], *room[i + 1 :]])
        place(k + 1, [*room, capacity - sizes[k]])

    place(0, [])
    return best


def test_dominance_keeps_the_optimum():
    """What is fixed, and the optimum of the rest, make the optimum of all; best fit packs the rest whole."""
    rng, fixed = np.random.default_rng(5), 0
    for _ in range(150):
        sizes = rng.integers(1, 21, 9)
        count = np.bincount(sizes, minlength=21).astype(np.int64)
        groups = packing.reduce_by_dominance(count, 20)
        rest = np.repeat(np.arange(21), count)
        fixed += 9 - len(rest)
        assert sum(t for _, t in groups) + optimum(sorted(rest.tolist(), reverse=True), 20) == optimum(sorted(sizes.tolist(), reverse=True), 20)
        groups += packing.best_fit(count, 20)
        used = np.zeros(21, int)
        for what, times in groups:
            assert sum(s * n for s, n in what) <= 20
            for s, n in what:
                used[s] += n * times
        assert (used == np.bincount(sizes, minlength=21)).all()
    assert fixed > 300


def test_kept_pieces_change_no_ids():
    """Ids with a small store of pieces, emptied again and again, and with white space of all kinds, equal plain encoding."""
    rng = np.random.default_rng(3)
    spaces = [" ", " ", " ", " ", "  ", "\n", " \n", "\t ", "\u00a0", " \u2003", "\r\n\r\n", "\x1d", "\x85 "]
    texts = ["".join(w + str(rng.choice(spaces[: 4 + 9 * (k % 2)])) for w in prose(700 + k, 80).split()) + "é'll 's 12 !" * (k % 3) for k in range(40)] + ["", " ", "  x", "\n"]
    encoder = packing.Encoder(PATH, most=50)
    for _ in range(2):
        for part in (texts[:20], texts[20:]):
            ids, at = encoder.encode(pa.array(part))
            for k, t in enumerate(part):
                assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_lm(docs, none):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert lm.score(none).count() == 0
    assert len(got) == 13 and got[3].n_tokens == 1 and got[5].n_tokens == 1 and got[6].n_tokens == 3
    assert all(r.score <= 0 and r.base_score <= 0 and r.train_tokens == got[3].train_tokens for r in got.values())


def test_lm_base_score_equals_counting(docs):
    """n_tokens, n_known, train_tokens and base_score against plain counting."""
    import re

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [*(w.lower() for w in re.findall(r"[^\x20\x09-\x0d]+", t or "")), None]
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in lm.score(docs).collect():
        if r.doc_id is not None:
            own = tokens(TEXTS[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c[w] > 0 for w in own), n)
            assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own))


def test_lm_estimates_are_counts_at_a_few_times_the_cost_of_the_keys():
    """Counts of tokens, contexts and pairs against plain counting; and the seconds of both on 4 MB of many words."""
    rng = np.random.default_rng(5)
    words = [f"w{k}".encode() for k in rng.integers(0, 200_000, 600_000)]
    rows = [b"", b"A a  b", b"", b" ".join(words), b"a b"]
    data, sizes = np.frombuffer(b"".join(rows), np.uint8), np.array([*map(len, rows)])
    word, context, pair, row = lm.grams(data, sizes)
    key, n = np.unique(np.r_[word, pair], return_counts=True)
    alone, before, both, own = lm.estimates(data, sizes, n)
    c, two = Counter(word.tolist()), Counter(pair.tolist())
    assert alone.tolist() == [c[w] for w in word.tolist()] and before.tolist() == [c[w] for w in context.tolist()]
    assert both.tolist() == [two[w] for w in pair.tolist()] and (own == row).all()
    none = np.zeros(0, np.int64)
    assert [len(x) for x in lm.estimates(np.zeros(0, np.uint8), none, none)] == [0] * 4

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    # a search of the sorted keys for each token misses the cache: over four times as long
    assert least(lambda: lm.estimates(data, sizes, n)) < 4 * least(lambda: lm.grams(data, sizes))


def test_counts_above_32_bits_stay_exact():
    counts = np.array([0, 1, 255, 70_000, (1 << 32) - 1, 1 << 32, 5_000_000_001], np.int64)
    for k in range(len(counts) + 1):
        assert (lm.from_counts_blob(lm.counts_blob(counts[:k])) == counts[:k]).all()


def test_media(docs, none):
    got = {r.doc_id: r for r in media.round_trip(docs).collect()}
    assert media.round_trip(none).count() == 0
    waves = {r.doc_id: (r.codec, np.frombuffer(r.pcm, "<i2")) for r in media.transcode(media.stored_documents(docs)).collect()}
    for k, text in TEXTS.items():
        body = (text or "").encode()
        body += bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        r = got[k]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        codec, wave = waves[k]
        plain = media.TABLES[codec][np.frombuffer(body, np.uint8)] if codec != "adpcm" else None
        if plain is not None:  # at 16 from 8 kHz each second sample is one of the file's, the others lie halfway
            assert (wave[::2] == plain).all() and (wave[1::2] == np.floor((plain.astype(int) + np.r_[plain[1:], plain[-1]]) / 2)).all()
        wide = wave.astype(int)
        turns = sum((a < 0) != (b < 0) for a, b in zip(wide, wide[1:], strict=False))
        assert r.feature == f"{codec} rate=16000 samples={len(wave)} rms={int((wide**2).mean() ** 0.5)} peak={abs(wide).max()} turns={turns} pcm_crc32={zlib.crc32(wave.tobytes())}"


def test_media_of_null_files_and_in_pieces(spark, monkeypatch):
    wave = np.random.default_rng(0).integers(-32768, 32768, 5000).astype(np.int16)
    whole = media.resampled(wave, 8000, 12000), media.summary(wave)
    monkeypatch.setattr(media, "PIECE", 7)
    assert (media.resampled(wave, 8000, 12000) == whole[0]).all() and media.summary(wave) == whole[1]
    rows = spark.createDataFrame([(1, 5, bytearray(media.to_wav("alaw", b"hello"))), (2, None, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media.features(media.transcode(rows)).collect()}
    assert got[1].payload_bytes == 5 and got[2].media_bytes is None and got[2].feature is None


def test_companding_tables():
    assert media.TABLES["mulaw"][0xFF] == 0 and media.TABLES["mulaw"][0x80] == 32124 and media.TABLES["mulaw"][0] == -32124
    assert media.TABLES["alaw"][0xD5] == 8 and media.TABLES["alaw"][0x55] == -8 and media.TABLES["alaw"][0xAA] == 32256


def test_adpcm_equals_one_step_at_a_time():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (5, 20), dtype=np.uint8)
    got = media.adpcm_blocks(blocks)
    for b, row in zip(blocks, got, strict=True):
        value, index, out = int.from_bytes(b[:2].tobytes(), "little", signed=True), min(int(b[2]), 88), []
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                d = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    d += part if code & bit else 0
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + int(media.MOVES[code & 7])))
                out.append(value)
        assert row[1:].tolist() == out


def test_decontamination(spark, docs, none):
    item = TEXTS[7][100:320]
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "not in any of these texts at all, nowhere")], "item_id long, text string")
    found = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(7, 1)} and all(r.edits == 0 and r.start == 100 for r in found if r.end == 320)
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for k in [*(k for k in TEXTS if k != 7), None])


def least_edits(item, text):
    """The fewest edits that make item a part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        p = int(rng.integers(0, len(out)))
        out[p : p + int(rng.integers(0, 2))] = [str(rng.choice(list("xyz")))]
    return "".join(out)


def test_alignment_equals_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(40):
        item = "".join(rng.choice(list("abcdefghij"), 120))
        data, at = toxicity.joined([prose(9, 20) + edited(rng, item, int(rng.integers(0, 8))) + prose(8, 20)])
        block = decontaminate.Block([1], [np.frombuffer(item.encode(), np.uint8)], 0.1)
        got = block.verify(data, at, *block.regions(data, at))
        least = least_edits(item, data.tobytes().decode())
        assert least <= 12 and min(g[4] for g in got) == least


def test_short_items_have_their_whole_budget():
    """Items of 1 to 48 bytes, with up to a tenth of them in edits and more, against edit distances."""
    rng = np.random.default_rng(4)
    for size in list(range(1, 49)) * 2:
        item = "".join(rng.choice(list("abcdefghijklmnop"), size))
        for edits in range(size // 10 + 2):
            data, at = toxicity.joined([prose(rng.integers(99), 4).upper().replace(" ", "") + edited(rng, item, edits) + "QQQ"])
            block = decontaminate.Block([1], [np.frombuffer(item.encode(), np.uint8)], 0.1)
            got = block.verify(data, at, *block.regions(data, at))
            least = least_edits(item, data.tobytes().decode())
            assert (min(g[4] for g in got) == least) if least <= size // 10 else not got


def test_alignment_of_a_long_item():
    item = prose(31, 4000)
    data, at = toxicity.joined([item[:9000] + "x" + item[9000:]] * 3)
    block = decontaminate.Block([1], [np.frombuffer(item.encode(), np.uint8)], 0.01)
    assert {(g[0], g[4]) for g in block.verify(data, at, *block.regions(data, at))} == {(0, 1), (1, 1), (2, 1)}


def test_warc(spark):
    trap = "x WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n y"
    pages = {1: "same", 2: "same", 3: None, 4: "", 5: trap, 6: "é\r\n\r\n", 7: "same"}
    df = spark.createDataFrame([(k, f"http://h/{k}\n", v, 1) for k, v in pages.items()], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == 7 and warc.round_trip(df.limit(0)).count() == 0
    for k, v in pages.items():
        body = (v or "").encode()
        assert got[k].payload_bytes == len(body) and got[k].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 7, 3, 4)] == [("revisit", 7), ("revisit", 7), ("response", None), ("revisit", 4), ("response", None)]


def test_warc_of_null_and_repeated_keys_and_files_by_other_names(spark, tmp_path):
    import gzip

    rows = [(None, None, "alone"), (None, "u", "both"), (4, "u", "both"), (5, None, "twice"), (5, None, "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes) for r in warc.round_trip(pages).collect())
    assert got == sorted([("None", "response", "None", 5), ("None", "revisit", "4", 4), ("4", "response", "None", 4), ("5", "response", "None", 5), ("5", "response", "None", 5)])
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "c.other").write_bytes(record)
    assert [r.payload_bytes for r in warc.read(spark, str(tmp_path)).collect()] == [3] * 4


def test_warc_files_stay_within_their_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 20_000)
    pages = spark.createDataFrame([(k, "u", prose(k, 300)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("*.txt")]
    assert len(sizes) > 5 and max(sizes) <= 20_000 and warc.read(spark, str(tmp_path / "w")).count() == 60


def brute(texts, length):
    first, out = {}, {}
    for k, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (k, p))
    for k, t in texts:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (k, p):
                covered[p : p + length] = True
        out[k] = (len(b), int(covered.sum()), np.frombuffer(b, np.uint8)[~covered].tobytes())
    return out


def test_suffix(docs, none, monkeypatch):
    got = {r.doc_id: r for r in suffix.cut(docs).collect()}
    assert suffix.cut(none).count() == 0 and len(got) == 13
    for k, (n, removed, kept) in brute(sorted(TEXTS.items()), 100).items():
        assert (got[k].n_bytes, got[k].n_removed, bytes(got[k].kept)) == (n, removed, kept)
    left = suffix.with_kept_text(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(TEXTS) - {1} | {None}


def test_contexts_hold_each_string_once(monkeypatch):
    """Every string lies in a context of the same anchor wherever it occurs, and without equal grams in one only."""
    monkeypatch.setattr(suffix, "PIECE", 1000)
    rng = np.random.default_rng(8)
    random = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    passage = random(700)
    plain = [random(3000), b"", random(99), random(100), random(400) + passage + random(50), passage[100:]]
    for rows, once in ((plain, True), ([*plain, b"a" * 500, b"ab" * 300 + passage], False)):
        data, at = np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])
        row, lo, hi, a = suffix.contexts(at, 100, suffix.Sums(data))
        assert (at[row] <= lo).all() and (hi <= at[row + 1]).all() and (hi - lo >= 100).all()
        inside = [(s, int(h)) for x, y, h in zip(lo.tolist(), hi.tolist(), a, strict=True) for s in range(x, y - 99)]
        assert {s for s, _ in inside} == {s for x, y in zip(at[:-1], at[1:], strict=True) for s in range(x, y - 99)}
        anchors = {}
        for s, h in inside:
            anchors.setdefault(data[s : s + 100].tobytes(), set()).add(h)
        assert all(len(h) == 1 for h in anchors.values())
        assert len(inside) == len({s for s, _ in inside}) or not once


def test_later_places_against_all_strings():
    rng = np.random.default_rng(9)
    group, word = np.sort(rng.integers(0, 70_000, 200_000)), rng.integers(0, 3, 200_000).astype(np.uint64)
    for n in (0, 1, 500, 200_000):
        order = suffix.grouped(group[:n], word[:n])
        assert (group[order] == group[:n]).all() and (np.diff(group[order] * 3 + word[order].astype(np.int64)) >= 0).all()
    passage = rng.integers(97, 99, 300).astype(np.uint8).tobytes()
    texts = [passage[k : k + 110 + 9 * k] for k in range(8)] + [b"a" * 250, b"short", b""] + [passage] * 2
    doc, lo = np.array([3, 1, 2, 5, 4, 6, 0, 7, 8, 9, 10, 11, 1]), np.array([10, 0, 5, 0, 0, 7, 0, 0, 3, 0, 0, 0, 400])
    got = suffix.later_places(np.frombuffer(b"".join(texts), np.uint8), np.array([*map(len, texts)]), doc, lo, 100)
    places = {}
    for t, d, x in zip(texts, doc.tolist(), lo.tolist(), strict=True):
        for k in range(len(t) - 99):
            places.setdefault(t[k : k + 100], set()).add((d, x + k))
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(p for own in places.values() for p in own - {min(own)})


def test_suffix_with_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 9)
    line = prose(11, 30)
    texts = [(k, prose(100 + k, 3) + line + prose(200 + k, 40)) for k in range(60)]
    got = {r.doc_id: r for r in suffix.cut(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, (_, removed, kept) in brute(texts, 100).items():
        assert (got[k].n_removed, bytes(got[k].kept)) == (removed, kept)


def test_anchors_spread_thinly_are_tallied():
    """One context in each of 20,000 slices: the tally comes to about that, though each slice has but one."""
    anchors = np.array([3, 1 << 60, (1 << 64) - 5], np.uint64)
    total = np.zeros(3)
    for seed in range(20_000):
        a, n = suffix.tallied(anchors[[0, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2]], seed * 0x9E3779B97F4A7C15)
        total[np.searchsorted(anchors, a)] += n
    assert total == pytest.approx([20_000, 40_000, 180_000], rel=0.1)


def test_columns_of_any_name_stay(spark):
    line = prose(61, 60)
    rows = [(k, 100 + k, "z", 5 * k, 6, b"k", 7, line + prose(900 + k, 30), 1) for k in range(6)] + [(9, None, None, None, None, None, None, line + prose(900, 30), None)]
    docs = spark.createDataFrame(rows, "doc_id long, n_bytes long, `a.b` string, id int, lo int, kept binary, `__id` int, text string, `null` int")
    cut = suffix.with_kept_text(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    assert got[0].text == rows[0][7] and got[1].n_bytes == 101 and got[1]["a.b"] == "z" and got[2].id == 10 and bytes(got[3].kept) == b"k" and got[4].text == rows[4][7][len(line) :].lstrip() or got[4].text in rows[4][7]
    one = minhash.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) in ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4])


def test_two_stage_sorting():
    rng = np.random.default_rng(1)
    for _ in range(30):
        body = bytes(rng.choice(list(b"ab\0"), int(rng.integers(1, 300))).astype(np.uint8)) * int(rng.integers(1, 3))
        data = np.frombuffer(body + bytes(140), np.uint8)
        order = suffix.two_stage(data, 120)
        cut = [data[i:].tobytes()[:104] for i in order]
        assert cut == sorted(cut) and sorted(order) == list(range(len(data)))


def test_a_text_of_megabytes_goes_through_every_operator(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(20_000)]
    text = lambda n: " ".join(words[k] for k in rng.integers(0, len(words), n))
    long = text(600_000)
    docs = spark.createDataFrame([(k, text(200)) for k in range(8)] + [(8, long), (9, long + " end")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {**{k: k for k in range(9)}, 9: 8}
    assert sum(r.length for r in packing.pack(docs, PATH).select("doc_id", "length").collect() if r.doc_id == 8) > 600_000
    assert quality.score(docs, quality.train(docs, labels)).count() == toxicity.score(docs, toxicity.train(docs, labels)).count() == 10
    assert {r.doc_id: r.n_tokens for r in lm.score(docs).collect()}[8] == 600_001
    assert {r.doc_id: r.payload_sha256 for r in media.round_trip(docs).collect()}[8] == hashlib.sha256(long.encode() + bytes(-len(long.encode()) % 64)).hexdigest()
    item = spark.createDataFrame([(1, long[2_000_000:2_000_300])], "item_id long, text string")
    assert {(r.doc_id, r.start) for r in decontaminate.matches(docs, item).filter("edits = 0").collect()} == {(8, 2_000_000), (9, 2_000_000)}
    assert {r.doc_id: r.n_removed for r in suffix.cut(docs).collect()}[9] == len(long.encode())

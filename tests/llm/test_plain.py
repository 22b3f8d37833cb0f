"""Cores of the corpus operators without Spark, against brute force."""

import random

import numpy as np
import pytest

from siftline.llm import quality, simhash, tokencount, tokenfile, toxicity

tokenizers = pytest.importorskip("tokenizers")
TEXTS = ["", " ", "a ", " a", "\n a\n", "a \n b", "don't I'll 'sabc x's ###'s a_b 12ab ½ 1/2", "« é » – “x” ß×ß", "a\u00a0b", "日本 語 ², x²", "a", "  two  spaces\n\nlines \t", "It's a test, isn't it? 123 €𝄞 é́", "<|endoftext|> x", "x" * 5000, "\x1c odd \x85 space", "same same same same " * 300]


def test_encoder_equals_the_library():
    enc = tokenfile.Encoder(tokenfile.default_tokenizer())
    lib = tokenizers.Tokenizer.from_file(tokenfile.default_tokenizer())
    for _ in range(2):
        ids, n = enc.encode(TEXTS)
        want = [lib.encode(t, add_special_tokens=False).ids + [0] for t in TEXTS]
        assert ids.tolist() == [x for w in want for x in w] and n.tolist() == list(map(len, want))


def _packed(doc_ids, docs):
    """Each id is a piece of its own; piece 0 is the end id."""
    ids = np.concatenate(docs)
    names = np.unique(np.r_[0, ids])
    flat = np.r_[names]
    return tokenfile.pack(doc_ids, np.array(list(map(len, docs))), np.searchsorted(names, ids), flat.astype(np.uint32), np.arange(len(flat)), np.ones(len(flat), np.int64))


def test_shards_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [np.r_[rng.integers(1, 6, k), 0] for k in (0, 5, 3000, 1, 0, 200)] + [np.array([7, 7, 7, 7, 7, 0])] + [np.r_[np.tile(9, 700), 0]]
    s = tokenfile.Shard(_packed([3, None, 3, 4, 5, 6, 7, 8], docs))
    assert s.all().tolist() == np.concatenate(docs).tolist() and s.doc_ids[1] is None and len(s.rules)
    for k in (7, 6, 2, 0, 5):
        assert s.document(k).tolist() == docs[k].tolist()
    broken = bytearray(_packed([1], [np.array([5, 0])]))
    broken[-6] ^= 1
    with pytest.raises(ValueError):
        tokenfile.Shard(bytes(broken))


def test_ids_beyond_sixteen_bits():
    docs = [np.array([70000, 1, 100000, 0]), np.array([2**32 - 1, 0])] + [np.r_[np.arange(1, 70001) * 3, 0]] * 2
    s = tokenfile.Shard(_packed([1, 2, 3, 4], docs))
    assert s.sym.dtype == np.uint32 and s.all().tolist() == np.concatenate(docs).tolist()
    assert [s.document(k).tolist() for k in (1, 0)] == [docs[1].tolist(), docs[0].tolist()]


def test_no_pair_stays_frequent():
    rng = np.random.default_rng(9)
    enc = tokenfile.Encoder(tokenfile.default_tokenizer())
    names = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(names, 200)) for _ in range(120)]
    which, n = enc.numbers(texts)
    used, sym, per, rules = tokenfile.compress(which, enc.flat, enc.off, enc.n)
    ends = np.cumsum(per)
    joins = np.setdiff1d(np.arange(len(sym) - 1), ends - 1)
    pairs = np.unique(sym[joins].astype(np.int64) << 32 | sym[joins + 1], return_counts=True)[1]
    assert pairs.max() < tokenfile.LEAST and len(sym) < int(n.sum()) / 2
    flat, length = tokenfile.expanded(rules, len(used))
    off = np.cumsum(length) - length
    for k, (a, b) in enumerate(rules.tolist()):
        side = lambda x: [x] if x < len(used) else flat[off[x - len(used)] : off[x - len(used)] + length[x - len(used)]].tolist()
        assert flat[off[k] : off[k] + length[k]].tolist() == side(a) + side(b)


def test_encoder_turns_its_generations():
    enc = tokenfile.Encoder(tokenfile.default_tokenizer(), 5)
    lib = tokenizers.Tokenizer.from_file(tokenfile.default_tokenizer())
    for t in ["one two three four five six", "four five six seven eight nine", "one two three", "nine é €"] * 2:
        if enc.full:
            enc.turn()
        ids, n = enc.encode([t])
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids + [0]


def test_trie_equals_the_plain_recurrence():
    import public_tokenizers

    m = tokencount.Unigram(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcethé€𝄞1-") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["the", "thesis", "theses"]
    m.learn(words)
    assert all(m.known[w] == m.alone(w) for w in words)
    assert m.counts([None, "  ", "the the"]) == [(0, 0), (0, 0), (2, 2 * m.alone("the"))]


def test_fingerprints():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == xxhash.xxh64_intdigest(b"one two", 42)
    h = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d")]
    assert simhash.fingerprint("a b c d") == h[0] & h[1]


def _base(text):
    words = [w for w in __import__("re").split(r"[\x20\t-\r]+", text or "") if w]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
    lines = (text or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_base():
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("ab #\n\xa0 ") for _ in range(rng.randint(0, 120)))
        assert quality.base(t) == _base(t)
    assert quality.base(None) == (0, 0, 0, 0, 0)


def test_viterbi_is_the_best_path():
    f = quality.Field()
    rng = np.random.default_rng(4)
    f.emit, f.move = rng.normal(size=quality.WIDTH), rng.normal(size=(2, 2))
    x = rng.integers(0, 2, (7, quality.WIDTH)).astype(float)
    z = x @ f.emit
    value = lambda y: sum(z[i] for i in range(7) if y[i]) + sum(f.move[y[i], y[i + 1]] for i in range(6))
    best = max(([k >> i & 1 for i in range(7)] for k in range(128)), key=value)
    assert f.viterbi(x).tolist() == best


def test_discounts_and_regression():
    assert toxicity.discounts([100, 40, 20, 10]) == pytest.approx([1 - 2 * 40 / 100 / 1.8, 2 - 3 * 20 / 40 / 1.8, 3 - 4 * 10 / 20 / 1.8])
    assert all(0 < d < k for k, d in enumerate(toxicity.discounts([0, 0, 0, 0]), 1))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [1, 50]
    y = (x @ [2, 0.02] + rng.normal(size=400) > 1).astype(float)
    w = toxicity.regression(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    g = np.where(y == 1, toxicity.WEIGHT, 1.0) * (p - y)
    z = (x - x.mean(0)) / x.std(0)
    assert abs(g.sum()) < 1e-2 and np.allclose(z.T @ g + toxicity.RIDGE * np.array(w[1:]) * x.std(0), 0, atol=1e-3)


def test_share_is_cut_in_the_widest_gap():
    good = np.array([False, False, True, True])
    assert quality.cut(np.array([0.0, 0.1, 0.9, 1.0]), good) == 0.5
    assert quality.cut(np.array([0.2, 0.2, 0.2, 0.2]), good) == 0.1  # nothing tells them apart: all are kept
    assert quality.cut(np.array([0.0, 0.0, 0.0, 0.0]), good) == 0.0

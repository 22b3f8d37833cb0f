"""Stages of the pipeline on planted cases, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import common, copies, decontaminate, simhash, tokenfile, toxicity, urls
from siftline.llm.common import Stash


def _groups(texts):
    """The component of each text, by all pairs."""
    sets = [set(copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def test_near_copies_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(copies, "SAMPLED", 1)
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((8, 40, 100, 300)))]
        for _ in range(rng.randint(1, 5)):
            w = words[:]
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w) + (" " + passage if k % 3 == 0 else ""))
    base = [f"b{i}" for i in range(200)]  # one large group
    texts += [" ".join(base[:i] + [f"y{i}"] + base[i + 1 :]) for i in range(0, 200, 4)]
    texts += ["", None, " \n", "one two", "ONE two", passage]
    want = _groups(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect())
    assert kept == sorted(set(want))
    assert len(kept) < len(texts) - 60


def test_the_index_of_fingerprints_finds_near_copies(spark, monkeypatch):
    posts = copies.posts
    # the shingles' lists are empty, those of the index (keys below 56 x 2^24) are not
    monkeypatch.setattr(copies, "posts", lambda entries, stash: stash.put(posts(entries, stash)[0].filter(F.col("key").between(0, 56 << 24))))
    texts = []
    for k in range(20):
        w = [f"w{k}-{i}" for i in range(400)]
        texts += [" ".join(w), " ".join(w[:-1])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").orderBy("doc_id").collect()] == list(range(0, 40, 2))


@pytest.mark.parametrize("long", [64, 2])
def test_pairs_of_the_index(spark, monkeypatch, long):
    monkeypatch.setattr(copies, "LONG", long)
    rng = random.Random(4)
    prints = []
    for _ in range(20):
        base = rng.getrandbits(64)
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(6)]
    prints += [prints[0]] * 2
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    stash = Stash(spark, "test")
    got = {(r.a, r.b) for r in copies.met(spark.createDataFrame([(i, 100, x) for i, x in enumerate(signed)], "e long, n long, fp long"), stash).collect()}
    cut = lambda x, c: tuple(x >> 8 * i & 255 for i in c)
    lists = {}
    for i, x in enumerate(prints):
        for k, c in enumerate(copies.LISTS):
            lists.setdefault((k, cut(x, c)), []).append(i)
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= copies.RADIUS
    short = {(i, j) for m in lists.values() if len(m) <= long for i in m for j in m if i < j and near(i, j)}
    every = {(i, j) for m in lists.values() for i in m for j in m if i < j and near(i, j)}
    assert short <= got <= every and len(every) > 20 and (long == 2 or got == every)
    # each entry of a long list meets the list's one
    for m in lists.values():
        if len(m) > long:
            assert any(all(h == i or not near(h, i) or (min(h, i), max(h, i)) in got for i in m) for h in m)


def test_a_group_of_near_copies_is_not_paired_off(spark, monkeypatch):
    compared, verified = [], copies.verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(copies, "verified", counted)
    base = [f"b{i}" for i in range(300)]
    texts = [" ".join(base[: 4 * i] + [f"y{i}"] + base[4 * i + 1 :]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").collect()] == [0]
    # 1,770 pairs meet in lists of the index
    assert 59 <= sum(compared) <= 8 * 60


def test_near_copies_beyond_three_bits_are_dropped(spark):
    texts = []
    for k in range(10):
        w = [f"w{k}-{i}" for i in range(120)]
        texts += [" ".join(w), " ".join(w[:40] + ["other"] + w[41:80] + ["another"] + w[81:])]  # similarity 106/126
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("text", F.col("doc_id"))
    assert [r.doc_id for r in corpus_pipeline.drop_copies(spark, df, "").orderBy("doc_id").collect()] == list(range(0, 20, 2))


def _plain_differences(rows, trained, kinds):
    """(differences of places, of unknown next characters, a word's) by dictionaries."""
    n = toxicity.ORDER
    cut = lambda w: [(toxicity.START * (n - 1) + w + toxicity.END)[i : i + n] for i in range(len(w) + 1)]
    top = [Counter(), Counter()]
    for i, t in rows:
        if i in trained:
            for w in set(toxicity.words(t)):
                for g in cut(w):
                    top[kinds[i]][g] += 1
    every = set(top[0]) | set(top[1])
    level = Counter(g[1:] for g in every)
    ends = Counter(g[-1] for g in level)
    p1 = {c: (max(k - 0.75, 0) + 0.75 * len(ends) / 256) / len(level) for c, k in ends.items()}
    total, different = Counter(), Counter()
    for g, k in level.items():
        total[g[:-1]] += k
        different[g[:-1]] += 1
    p = {g: (max(k - 0.75, 0) + 0.75 * different[g[:-1]] * p1[g[-1]]) / total[g[:-1]] for g, k in level.items()}
    off = [toxicity.discounts([sum(v == k for v in c.values()) for k in range(1, 5)]) for c in top]
    mass, left = [Counter(), Counter()], [Counter(), Counter()]
    for y in (0, 1):
        for g, v in top[y].items():
            mass[y][g[:-1]] += v
            left[y][g[:-1]] += off[y][min(v, 3) - 1]
    lam = lambda y, c: left[y][c] / mass[y][c] if mass[y][c] else 1.0

    def one(y, g):
        v = top[y][g]
        return (v - off[y][min(v, 3) - 1] if v else 0) / max(mass[y][g[:-1]], 1) + lam(y, g[:-1]) * p[g[1:]]

    ratio = {g: math.log(one(1, g) / one(0, g)) for g in every}
    rest = {g[:-1]: math.log(lam(1, g[:-1]) / lam(0, g[:-1])) for g in every}
    return ratio, rest, lambda w: sum(ratio.get(g, rest.get(g[:-1], 0.0)) for g in cut(w))


@pytest.mark.parametrize("remembered", [400_000, 7])
def test_toxicity_equals_a_plain_model(spark, monkeypatch, remembered):
    monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
    monkeypatch.setattr(toxicity, "HELD", 50)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé𝄞") for _ in range(rng.randint(1, 14)))
    rows = [(i, " ".join(word() for _ in range(12)) + (f" awful{word()} awful" if i % 3 == 0 else " fine") + " x" * (i % 5)) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "w" * 3000), (None, "no id awful"), (3, rows[3][1]), (203, "awful awful")]
    kinds = {i: int(i % 3 == 0) for i in range(150)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*kinds.items(), (3, 0), (None, 1), (999, 1), (5, None)], "doc_id long, toxic int")
    trained = {r.doc_id for r in df.filter(~toxicity.held_out(F.col("doc_id")) & ~toxicity._fold(F.col("doc_id"))).collect()} & set(range(150))
    assert 3 not in trained or kinds[3] == 1
    model = toxicity.fit(df, labels)
    ratio, rest, of = _plain_differences(rows[:150], trained, kinds) if 3 not in trained else _plain_differences(rows[:150] + [(3, rows[3][1])], trained, kinds)
    contexts = model.contexts.collect()
    assert {r.ctx + k: v for r in contexts for k, v in r.ratios.items()} == pytest.approx(ratio)
    assert {r.ctx: r.rest for r in contexts} == pytest.approx(rest)

    def want(t):
        r = sorted(map(of, toxicity.words(t)), reverse=True)
        a, b = (sum(r) / len(r), sum(r[:2]) / 2) if r else (0.0, 0.0)
        return 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * a + model.weights[2] * b)))

    scored = toxicity.score(df, model).collect()
    assert len(scored) == len(rows) and all(r.toxic_score == pytest.approx(want(r.text)) for r in scored)
    both = toxicity.scored(df, labels).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in both) == sorted((r.doc_id or -1, round(r.toxic_score, 6)) for r in scored)
    kept = toxicity.drop(df, labels).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter((r.doc_id, r.text) for r in scored if r.toxic_score < toxicity.THRESHOLD)
    assert all(r.doc_id != 203 for r in kept)


def test_items_cut_at_the_edge_of_a_document(spark):
    w = [f"w{i}" for i in range(38)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    after = " ".join(f"z{i}" for i in range(50))
    texts = [" ".join(w[1:]) + " " + after, after + " " + " ".join(w[:-1]), " ".join(w[1:]), " ".join(w[:-1]), " ".join(w[2:-2]), " ".join(w[:20])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.start, r.similarity) for r in decontaminate.matches(df, items).collect()}
    cut = pytest.approx(33 / 35)
    assert got == {0: (0, cut), 1: (49, cut), 2: (0, pytest.approx(33 / 34)), 3: (0, pytest.approx(33 / 34)), 4: (0, pytest.approx(30 / 34))}


@pytest.mark.parametrize("dedupe", [simhash.dedupe, copies.dedupe])
def test_rows_of_null_and_repeated_ids_are_told_apart(spark, dedupe):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (2, texts[2]), (None, texts[0]), (None, texts[3]), (None, texts[4]), (None, texts[4])]
    kept = dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, texts[0]), (2, texts[1]), (2, texts[2]), (0, texts[3]), (0, texts[4])])


def test_leaks_under_null_and_repeated_ids(spark):
    item, clean = (" ".join(f"{c}{i}" for i in range(38)) for c in "ab")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (None, clean), (1, item), (1, clean), (2, None)]
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, clean), (1, clean), (2, "")]


@pytest.mark.parametrize("broadcast", [50_000, 3])
def test_every_suffix_has_its_statistics(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST", broadcast, raising=False)
    seen = []
    fit = urls.boost.fit
    monkeypatch.setattr(urls.boost, "fit", lambda x, y: (seen.append(x.copy()), fit(x, y))[1])
    rows = [(i, f"https://a.n{i:03}.{'org/x' if i % 2 else 'com/de/x'}") for i in range(700)]
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string")).collect()
    share = (350 + 1.0) / (700 + 2.0)
    own = {round((b + urls.PRIOR * share) / (1 + urls.PRIOR), 9) for b in (0, 1)}
    assert len(got) == 700 and {round(v, 9) for v in seen[0][1::2, -1]} == own


@pytest.mark.parametrize("of", ["sets", "signatures"])
def test_workers_make_a_part_of_a_batch_at_once(spark, of):
    taken, given = [], []

    class Rows:
        """Keeps the function that tasks run."""

        schema = spark.range(0).withColumnRenamed("id", "doc_id").schema
        sparkSession = spark

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    rows = Rows()
    copies.sets(rows) if of == "sets" else copies.signatures(rows, np.zeros(0, np.int64))
    n = 3 * common.SLICE + 7
    ids, texts = pa.array(range(n)), pa.array([f"a b c d e {i}" for i in range(n)])
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["i", "text"]) if of == "sets" else pa.RecordBatch.from_arrays([ids, ids, texts], names=["i", "doc_id", "text"])
    for b in rows.run(iter([batch, batch.slice(0, 0)])):
        given.append(len(b))
        taken += b.column(0).to_pylist()
    assert taken == list(range(n)) and max(given) <= common.SLICE


def test_an_operator_drops_what_a_worker_keeps_for_another():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = tokenfile.encoder(path)
    assert tokenfile.encoder(path) is first
    texts = pa.RecordBatch.from_arrays([pa.array(["one two"])], names=["text"])
    list(toxicity._vocabulary(iter([texts])))
    assert tokenfile.encoder(path) is not first


def test_the_mask_of_shared_keys_sends_no_bitmaps(spark):
    keys = spark.createDataFrame([(k,) for k in (0, 5, 5, -1, copies.PLACES + 9, 1 << 40)], "key long")
    bits = copies._bitmaps(keys)
    mask = copies._marked(keys)
    places = np.flatnonzero(np.unpackbits(mask, bitorder="little"))
    assert places.tolist() == sorted({k % copies.PLACES for k in (0, 5, -1, 9, 1 << 40)})
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("bitmap_construct_agg") < plan.index("Exchange")

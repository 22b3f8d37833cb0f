"""Spelling variants against plain loops, and the automata alone."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import spelling
from siftline.llm.automata import Automaton, Dictionary


def apart(u, v):
    """Whether one added, missing or replaced code point tells u from v."""
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


words = st.lists(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40, unique=True)


@settings(deadline=None, max_examples=80)
@given(words)
def test_automata_number_the_words(found):
    found = sorted(found)
    a = Automaton(found)
    assert [a.number(w) for w in found] == list(range(len(found)))
    assert a.number("abc") is None and a.count[a.start] == len(found)
    # minimal: no two states have the same endings
    assert len({(f, tuple((c, t) for c, (t, _) in n.items())) for f, n in zip(a.final, a.next)}) == len(a.next)


@settings(deadline=None, max_examples=80)
@given(words, st.text("abé", min_size=1, max_size=7))
def test_both_directions_find_all_words_one_error_apart(found, word):
    d = Dictionary(found)
    k = len(word) // 2
    got = d.after(word[:k], word[k:]) | d.before(word[:k], word[k:])
    assert {d.words[i] for i in got} == {w for w in found if apart(w, word)}


def plain(rows, every=97):
    n = Counter()
    for d, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for r in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 5:
                n[r] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), n.get(form.get(w))) for w, c in n.items()), key=repr)


def some(n, seed=1):
    rng = random.Random(seed)
    base = ["spelling", "Spélling", "variants", "variant", "grouping", "automaton", "éÀß÷×", "aaaaa", "aaaaaa", "aaaaaaa", "ab", "length"]
    letters = "abé"

    def word():
        w = rng.choice(base)
        if rng.random() < 0.4:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1 :]
        return w

    return [(i, rng.choice([" ", "-", "1"]).join(word() for _ in range(rng.randrange(60)))) for i in range(n)]


def got(df, **how):
    return sorted((tuple(r) for r in spelling.variants(df, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


SCHEMA = "doc_id long, text string, word string, n string, near string, root string, forward string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", "n", "x", "r", "f") for r in rows], SCHEMA)


@pytest.mark.parametrize("how", [{}, {"held": 10, "half": 3}, {"every": 5}])
def test_equals_plain_loops(spark, how):
    rows = some(150) + [(None, None), (7, ""), (7, "spelling " * 5), (7, "spelling " * 5), (None, "variants variants SPELLING"), (9, "x" * 200_000 + " " + "y" * 200_000), (10, "Length " * 30_000), (11, "abcdefg " * 3 + "abcdefgh " * 8 + "abcdefghi " * 20)]
    want = plain(rows, how.get("every", 97))
    assert got(table(spark, rows), **how) == want
    assert "every" in how or any(r[1] and r[2] != r[1] for r in want)


def test_one_half_is_in_a_third_of_all_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'common' if j % 3 else 'x'}{''.join(rng.choices('abc', k=5))}" for j in range(40))) for i in range(60)]
    assert got(table(spark, rows), held=40, half=20) == plain(rows)


def test_empty(spark):
    assert got(table(spark, [])) == [] and got(table(spark, [(1, None), (2, "to be or not")])) == []


def test_roots_follow_long_chains(spark):
    stash = spelling.Stash(spark, "test")
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("a", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, stash).collect()} == {**{f"w{i}": "w20" for i in range(20)}, "a": "w20"}

from __future__ import annotations

import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from postlode.llm import tokens as tk

TEXT = st.text(alphabet=st.sampled_from(list("abcXYZ019 .,<>&;éßİ\n-")), max_size=80)


def plain_words(t, entities=False):
    t = t or ""
    t = html.unescape(t) if entities else t
    return re.findall("[a-z0-9]+", re.sub("<[^>]*>", " ", t).lower())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_shingle_sets_match_plain(texts):
    got = {int(w): int(n) for s in tk.shingle_sets(texts, 2, 3) for w, n in zip(s.which, s.sizes(), strict=True)}
    want = {}
    for i, t in enumerate(texts):
        w = plain_words(t)
        if len(w) >= 3:
            want[i] = len({tuple(w[k : k + 2]) for k in range(len(w) - 1)})
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_equal_words_hash_alike(texts):
    h, o = tk.words([tk.plain(t) for t in texts])
    words = [w for t in texts for w in plain_words(t)]
    assert len(words) == len(h) and o[-1] == len(h)
    for i in range(len(words)):
        for j in range(i):
            assert (words[i] == words[j]) == (h[i] == h[j])


def test_fingerprints_and_parity():
    a = "one two three four five six seven"
    (s,) = tk.shingle_sets([a, a.upper(), a + " eight", ""], 3, 3)
    fp = s.fingerprints()
    assert (fp[0] == fp[1]).all() and (fp[0] != fp[2]).any()
    bits = np.unpackbits(s.parity(256), axis=1)
    assert (bits[0] == bits[1]).all() and (bits[0] != bits[2]).sum() <= 1


def test_winnowing_keeps_a_fingerprint_of_every_shared_run():
    rng = np.random.default_rng(1)
    run = " ".join(f"w{x}" for x in rng.integers(0, 1000, 9))
    for seed in range(20):
        r = np.random.default_rng(seed + 5)
        pad = lambda: " ".join(f"p{x}" for x in r.integers(0, 10**6, 40))  # noqa: B023, E731
        texts = [f"{pad()} {run} {pad()}", f"{pad()} {run} {pad()}"]
        f = next(iter(tk.winnowed_sets(texts, 3, 3, 4)))[1]
        assert len(np.intersect1d(f.flat[: f.o[1]], f.flat[f.o[1] :]))


def test_long_and_many_texts():
    texts = ["x y z " * 400_000, None, *["a b c d"] * 9000]
    got = list(tk.shingle_sets(texts, 3, 3))
    assert sum(len(s) for s in got) == 9001

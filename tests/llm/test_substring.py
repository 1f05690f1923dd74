"""Substring dedup against dictionaries of windows; the index against plain search."""

import random

import numpy as np
import pytest

from cairn.llm import substring
from cairn.llm.fm_index import FMIndex


@pytest.mark.parametrize("seed", range(80))
def test_matching_statistics(seed):
    rnd = random.Random(seed)
    window = rnd.choice([1, 2, 3, 5])
    words = [bytes([97 + k]) for k in range(rnd.choice([1, 2, 3, 6]))]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(window, 25))] for _ in range(rnd.randint(1, 8))]
    owners = [rnd.randint(0, 6) for _ in texts]
    asked = [[rnd.choice([*words, b"z"]) for _ in range(rnd.randint(0, 30))] for _ in range(rnd.randint(1, 9))] + [texts[0]]
    index = FMIndex(texts, owners, window)
    for text, got in zip(asked, index.matching_statistics(asked), strict=True):
        want = []
        for i in range(max(0, len(text) - window + 1)):
            has = [o for t, o in zip(texts, owners) if any(t[j : j + window] == text[i : i + window] for j in range(len(t) - window + 1))]
            want.append(index.owners.index(min(has)) if has else -1)
        assert got.tolist() == want


def test_hashes_are_of_words_alone():
    x = np.random.default_rng(1).integers(0, 2**63, 500).astype("u8")
    x[300:360] = x[100:160]
    for k in (1, 2, 3, 20, 50):
        h = substring.shingle_hashes(x, k)
        assert len(h) == len(x) - k + 1 and len(set(h.tolist())) == len(h) - (60 - k + 1 if k <= 60 else 0)
        assert (h[300 : 360 - k + 1] == h[100 : 160 - k + 1]).all()
    assert substring.sliding_least(x, 31).tolist() == [min(x[i : i + 31]) for i in range(len(x) - 30)]
    assert len(substring.shingle_hashes(x[:3], 5)) == 0


def test_word_hashes():
    texts = [b"a  b\n\x00 \x00\x00 b", b"", b" \t ", "é a\u3000x ".encode(), b"b" * 3000, b"ab ba"]
    h, starts = substring.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert len(h) == len(words) and np.diff(starts).tolist() == [len(t.split()) for t in texts]
    assert len(set(h.tolist())) == len(set(words)) and {w: x for w, x in zip(words, h.tolist())} == dict(zip(words, h.tolist()))
    assert (substring.word_hashes([b"zzz " * 9, b"b"])[0][-1] == h[1]).all() and len(substring.word_hashes([])[0]) == 0


def brute(rows, window=50):
    owner = {}
    split = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    big = 10**18
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            owner[key] = min(owner.get(key, big), big if i is None else i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < (big if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, k1 long, row string, spans int, n_words int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "r", 2, 3, "w") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture()
def small(monkeypatch):
    """Many shards, tasks and pieces on little data."""
    for name, value in (("INDEX_WORDS", 500), ("STREAM_WORDS", 900), ("PASSAGE_WORDS", 120), ("TOGETHER", 3000), ("IN_STEP", 600)):
        monkeypatch.setattr(substring, name, value)


def test_against_brute_force(spark, small):
    rnd = random.Random(5)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 49, 60, 120, 400)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 4)):
            words += fresh(rnd.choice([0, 1, 5, 30, 60]))
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += p if rnd.random() < 0.5 else p[a : a + rnd.choice([49, 50, 55, 200])]
        rows.append((rnd.randrange(100) if i % 10 else None, rnd.choice([" ", "\n", " \t", "\x0b"]).join(words)))
    copies = " ".join(fresh(300))
    rows += [(k, copies) for k in range(200, 260)] + [(k, copies + f" end{k}") for k in range(260, 300)]
    rows += [(1, "a " * 500), (2, "a " * 300 + "b"), (3, "a b " * 200), (4, None), (5, ""), (6, " \n "), (7, "é　ü " * 60), (8, "é　ü " * 70), rows[3], rows[3], rows[203], (None, copies)]
    rows += [(9, "long " + " ".join(fresh(30_000))), (10, rows[-1][1])]
    got = substring.without_repeats(frame(spark, rows))
    assert got.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), "n_words_", "n_removed"]
    assert sorted(((r.doc_id, r.n_words_, r.n_removed, r.text) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert substring.without_repeats(frame(spark, [])).count() == 0
    got = substring.without_repeats(frame(spark, [(1, "a b"), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_removed, r.text) for r in got) == [(1, 0, "a b"), (2, 0, "")]


def test_string_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    got = substring.without_repeats(spark.createDataFrame([("b", text), ("a", text + " more"), (None, text)], "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {"a": 0, "b": 80, None: 80}

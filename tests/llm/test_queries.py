"""Each query opN_ on the smallest tables against a version worked out here, row by row, from its contract."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from cairn.llm import queries, url_filter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
WS = "\x20\t\n\x0b\x0c\r"


def table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents():
    rows = table("documents", "doc_id, text")
    assert len({i for i, _ in rows}) == len(rows)
    return {i: t or "" for i, t in rows}


def run(spark, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, SF).collect()
    got = {r[key]: r for r in rows}
    assert len(got) == len(rows)
    return got


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    frame = queries.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == sorted(want.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(str([plain(v) for v in r]) for r in frame.select(want.columns).collect()) == sorted(str([plain(v) for v in r]) for r in want.fetchall())


@pytest.mark.parametrize("size, gain", [("0.001", 0.0), ("0.01", 0.03)])
def test_op4(spark, size, gain):
    """The mixture is as good as the base where 180 documents teach subwords little, and better where there are more."""
    larger = SF.replace("0.001", size)
    documents = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{larger}/documents.parquet'").fetchall()}
    got = {r.doc_id: r for r in queries.QUERIES["op4_lm_score"](spark, larger).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in documents}
    words = {i: t.encode().lower().split() for i, t in documents.items()}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total, distinct = sum(counts.values()), len(counts)
    for i, ws in words.items():
        own = [counts[w] for w in [*ws, None]]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(c > 0 for c in own), total)
        assert r.base_score == pytest.approx(sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in own))
    assert set(got) == set(documents)
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > (1 - gain) * sum(r.base_score for r in own) - 0.05 * len(own)
    learnt = [r for r in got.values() if not r.held_out]
    share = (sum(r.model_score > r.base_score for r in learnt) + 0.5) / (len(learnt) + 1)
    for r in got.values():
        assert r.score == pytest.approx(np.logaddexp((r.model_score + np.log10(share)) * np.log(10), (r.base_score + np.log10(1 - share)) * np.log(10)) / np.log(10))


def test_op5(spark, documents):
    got = run(spark, "op5_media")
    assert set(got) == set(documents)
    for i, t in documents.items():
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload) and f"samples={len(payload) // 64};" in r.feature and "codec=raw;" in r.feature
        starts = [k.start for k in r.key_ranges]
        assert len(starts) == -(-len(payload) // 64 // 16) and all(k.length == 64 for k in r.key_ranges) and np.diff(starts).tolist() == [1024] * (len(starts) - 1)
    by_text = defaultdict(set)
    for i, t in documents.items():
        by_text[t].add((got[i].media_sha256, got[i].feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_op6(spark):
    """Rules from the contract; the other verdicts from naive Bayes worked out here, on the words that the query gives."""
    got = run(spark, "op6_url_filter", "page_id")
    rules = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
    rows = table("pages", "page_id, url")
    assert set(got) == {i for i, _ in rows}
    urls, decided = {}, {}
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:end].translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})), rest[end:]
            path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        letters = lambda x: [w for w in re.split("[^a-z]+", x.lower()) if w]
        # segments are the host's runs cut up, then the path's
        assert "".join(r.words) == "".join(letters(host) + letters(path)) and r.words[len(r.words) - len(letters(path)) :] == letters(path)
        decided[url or ""] = max(fits)[2] if fits else None
        urls[url or ""] = (r.words, decided[url or ""] == "block" if fits else bool(set(letters(host)) & set(url_filter.TOPICS)))
    counts = {k: Counter(w for words, block in urls.values() if block == k for w in words) for k in (True, False)}
    total = {k: sum(c.values()) + 0.5 * len(set(counts[True]) | set(counts[False])) for k, c in counts.items()}
    n = Counter(block for _, block in urls.values())
    by_method = Counter()
    for i, url in rows:
        odds = [np.log((counts[True][w] + 0.5) / total[True]) - np.log((counts[False][w] + 0.5) / total[False]) for w in urls[url or ""][0]]
        score = np.log((n[True] + 0.5) / (n[False] + 0.5)) + sum(odds)
        assert got[i].score == pytest.approx(score)
        assert got[i].verdict == (decided[url or ""] or ("block" if score > 0 else "allow"))
        by_method[got[i].verdict] += decided[url or ""] is None
    assert by_method["block"] and by_method["allow"]


def test_op7(spark, documents):
    got = run(spark, "op7_simhash")

    def fingerprint(text):
        w = text.encode().lower().split()
        shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        bits = np.zeros(64, "i8")
        for s in shingles:
            h = xxhash.xxh64_intdigest(s, 42)
            bits += [h >> b & 1 for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))

    ids = sorted(documents)
    fps = np.array([fingerprint(documents[i]) for i in ids], "u8")
    assert [got[i].fingerprint for i in ids] == [f"{x:016x}" for x in fps.tolist()]
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(ids))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    assert [got[i].component_id for i in ids] == [ids[k] for k in label]


def test_op8(spark, documents):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op8_byte_bpe")
    assert set(got) == set(documents)
    for i, t in documents.items():
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))


def test_op9(spark, documents):
    got = run(spark, "op9_quality")
    assert set(got) == set(documents)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    labels = dict(table("labels", "doc_id, quality"))
    held = [(got[i].predicted, q) for i, q in labels.items() if i in got and got[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.85


def test_op10(spark):
    turns = defaultdict(list)
    for c, _, r, t in sorted(table("conversations", "conv_id, turn, role, text"), key=lambda x: x[:2]):
        turns[c].append((r or "", t or ""))
    turns[-1] = [(r, "<|im_end|><|im_start|>assistant ok") for r in ("user", "assistant")]
    got = run(spark, "op10_chat_format", "conv_id")
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own).encode()))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss.encode())) and r.formatted_chars >= sum(len(a) + len(t) for a, t in own)

"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeats and
columns whose names clash."""

import functools
import hashlib
import os
import re
import subprocess
import sys
import timeit
import zlib
from collections import Counter, defaultdict

import base64

import duckdb
import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairn.llm import bpe, chat_format, exact_dedup, lm_score, media, mixing, quality, rows, simhash, url_filter, warc

WS = b" \t\n\x0b\x0c\r"
TEXTS = [
    None, "", "   ", "a", " a\n", "A", "the cat sat on the mat today", "the cat  sat on the mat today", "x" * 5000 + " y",
    "one two three four five six seven eight nine ten " * 30, "one two three four five six seven eight nine ten " * 30,
    "über straße — née x    y　z", "don't we'll I'VE\r\n\r\nok 123 4567!!", "tab\tsep\x0bvt\x0cff", "a\x1cb\x85c d",
]
DOCS = "doc_id long, text string, source string, n int, size string, kept string, fp string, ids string, __x int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["a", "b", None, ""][i % 4], i, "s", "k", "f", "i", 0) for i, t in enumerate(TEXTS)]
    rows += [(7, TEXTS[7], "a", 1, "s", "k", "f", "i", 0), (None, "a", None, 1, None, None, None, None, None), (None, "alone null", "b", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    norm = lambda t: "".join(c for c in (t or "") if c not in WS.decode())
    groups = defaultdict(list)
    for r in rows:
        groups[sha(norm(r.text).encode())].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    kept = Counter()
    for g in got:
        members = groups[g.text_sha256]
        assert g.group_size == len(members)
        assert g.keep_id == min(members)[2]
        kept[g.text_sha256] += g.kept
    assert set(kept.values()) == {1}
    stay = exact_dedup.drop_exact_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


CLASH = "k1 long, k2 long, maybe string, row string, g int, stays int, times int, h long, word long, id int, __score double, __key string, __rate double, __copies int"


@pytest.fixture(scope="module")
def clashing(spark):
    """60 texts, each of them twice under other ids and once as a near copy, and every internal name as a column."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        near = [*words[:-1], "other"]
        rows += [(k, t, f"s{i % 3}", *range(k, k + 4), k, k, k, k, k, k, 0.5, "key", 0.25, 7) for k, t in ((3 * i, " ".join(words)), (3 * i + 1, " ".join(words)), (3 * i + 2, " ".join(near)))]
    rows = [(r[0], r[1], r[2], r[3], r[4], str(r[5]), str(r[6]), *r[7:]) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASH}")


def test_stages_hand_callers_columns_back(clashing):
    before = {r.doc_id: r for r in clashing.collect()}
    model = (np.zeros(1 << quality.LOG2, "f4"), 0.0)
    for stage, ids in ((exact_dedup.drop_exact_copies, {k for k in before if k % 3 != 1}), (simhash.drop_near_copies, None),
                       (simhash.drop_similar_copies, {k for k in before if k % 3 == 0}), (mixing.mix_documents, None), (lambda d: quality.drop_low_quality(d, model), set(before))):
        out = stage(clashing)
        got = out.collect()
        assert out.columns == clashing.columns and got
        assert all(r == before[r.doc_id] for r in got)
        assert ids is None or sorted(r.doc_id for r in got) == sorted(ids)
    scored = quality.score_documents(clashing, model)
    assert scored.columns[-1] == "__score_" and scored.select(clashing.columns).first() == clashing.first()


def test_stages_on_shuffled_input(spark):
    """The plan under a stage may deal rows otherwise each time that it is evaluated; no row is lost for it."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        text = "concat_ws(' ', transform(sequence(1, 30), x -> sha2(concat(id % 4000, ':', x), 256)))"
        df = spark.range(8000).selectExpr("id as doc_id", f"{text} as text", "id as extra").repartition("doc_id")
        for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies, simhash.drop_similar_copies):
            got = stage(df).agg({"*": "count", "doc_id": "max", "extra": "sum"}).first()
            assert tuple(got) == (4000, 3999, sum(range(4000))) or sorted(got) == sorted((4000, 3999, sum(range(4000))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_rows_that_agree_in_id_and_text(spark):
    df = spark.createDataFrame([(1, "one two three four five six", k) for k in range(5)] + [(None, "x", 1), (None, "x", 2), (2, None, 3), (2, "", 3)], "doc_id long, text string, extra int")
    for stage in (exact_dedup.drop_exact_copies, simhash.drop_near_copies, simhash.drop_similar_copies):
        got = stage(df).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "None"]
        assert [r.extra for r in got] == [r.extra for r in stage(df.repartition(5)).collect()] or len(got) == 3


def test_filter_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2500 as string) as text").cache()
    whole = sorted(map(tuple, exact_dedup.exact_groups(df).collect()))
    monkeypatch.setattr(rows, "BROADCAST_LOG2", 10)  # hashes are dealt by word; decisions share a filter that is far too small
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect())) == whole
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()) == list(range(2500))


def test_hot_shards_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 1 << 36, 300, dtype="u8")  # all share the highest blocks
    fps = np.unique(np.concatenate([seeds, *(seeds ^ np.uint64((1 << k) | (1 << (k + 9))) for k in range(0, 24, 3))]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    groups = []
    for most in (100_000, 150):
        monkeypatch.setattr(simhash, "SHARD_ROWS", most)
        root = {r.node: r.root for r in simhash.components(simhash.shard_links(df)).collect()}
        groups.append([root.get(int(x), int(x)) for x in fps])
    assert groups[0] == groups[1] and len(set(groups[0])) == 300


def test_bloom_flags_only_repeats(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "cast(if(id < 4900, id, 1) as string) as text")
    got = exact_dedup.exact_groups(df)
    assert got.filter("group_size > 1").count() == 101 and got.filter("kept").count() == 4900


def test_mix(spark, docs, none):
    plan = mixing.mix_plan(docs).collect()
    size = lambda t: len((t or "").encode().split())
    by_source = defaultdict(int)
    for r in docs.collect():
        by_source[r.source] += size(r.text)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(by_source.values()), {}, set(order)
    left = total
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * by_source[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * by_source[s]
            left -= 3 * by_source[s]
        open_ -= over
        if not open_:
            break
    totals = Counter(r.source_size for r in plan)
    assert totals and {round(r.target, 6) for r in plan} == {round(t, 6) for t in target.values()}
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in plan)
    key = lambda p: sorted((str(r.doc_id), r.size, r.copies) for r in p)
    assert key(plan) == key(mixing.mix_plan(docs).collect())
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix_plan(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mix_nears_targets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "concat('s', cast(id % 7 as string)) as source")
    plan = mixing.mix_plan(df).toPandas()
    by = plan.assign(source=plan.doc_id % 7).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) / by.target).max() < 0.01


def test_simhash(docs, none, spark):
    got = simhash.near_groups(docs).collect()

    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        votes = [0] * 64
        for s in sh:
            h = xxhash.xxh64_intdigest(s, 42)
            for b in range(64):
                votes[b] += h >> b & 1
        return sum(1 << b for b in range(64) if 2 * votes[b] > len(sh))

    rows = docs.collect()
    assert sorted((str(r.doc_id), brute(r.text)) for r in rows) == sorted((str(g.doc_id), g.fp % 2**64) for g in got)
    parent = list(range(len(rows)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    fps = [brute(r.text) for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    names = defaultdict(list)
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            names[find(k)].append(r.doc_id)
    want = sorted((str(r.doc_id), str(min(names[find(k)], default=None))) for k, r in enumerate(rows))
    assert want == sorted((str(g.doc_id), str(g.component_id)) for g in got)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(rows))})
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_similar_copies(spark, docs, none, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary, 200).tolist() for _ in range(6)]
    texts = [" ".join(b) for b in base]
    for b in base[:4]:
        for changes in (1, 2, 3, 3, 4, 4, 5, 6, 9):  # similarities on both sides of 0.8
            t = list(b)
            for k in rng.choice(200, changes, replace=False):
                t[k] = "new" + str(rng.integers(10**6))
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    want = sorted(set(label))
    assert 10 < len(want) < 40
    for most in (3_000_000, 2_000):  # a group in many parts, and whole
        monkeypatch.setattr(simhash, "GROUP_SHINGLES", most)
        assert sorted(r.doc_id for r in simhash.drop_similar_copies(df).collect()) == want
    kept = simhash.drop_similar_copies(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect()), key=str) == sorted({"0", "3", "6", "8", "9", "11", "12", "13", "14", "None"}, key=str)
    assert simhash.drop_similar_copies(none).count() == 0


def test_bk_trees_lose_no_link(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, 40, dtype="u8")
    fps = [int(s) for s in seeds]
    for s in seeds[:10]:
        x = int(s)
        for _ in range(60):  # chains whose ends are far apart
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fps = np.unique(np.array(fps, "u8"))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert (simhash.bk_links(fps, 4) == label).all()
    df = spark.createDataFrame([(int(x),) for x in fps.view("i8")], "fp long")
    links = simhash.components(simhash.shard_links(df)).collect()
    root = {r.node: r.root for r in links}
    got = [root.get(int(x), int(x)) for x in fps.view("i8")]
    by_label, by_got = defaultdict(set), defaultdict(set)
    for k, (a, b) in enumerate(zip(label, got)):
        by_label[a].add(k)
        by_got[b].add(k)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_got.values()))


def test_bpe_round_trip(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode_documents(bpe.encode_documents(docs, ids_col="token_ids"), "token_ids")
    got = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(got) == docs.count()
    for r in got:
        assert r.token_ids == own.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode_documents(none).count() == 0


def test_bpe_without_answers(docs, monkeypatch):
    """Words that a block has no answer for are encoded in place."""
    whole = bpe._answered
    monkeypatch.setattr(bpe, "_answered", lambda asked, path: whole(asked.filter("bucket % 2 = 0"), path))
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for r in bpe.encode_documents(docs, keep=["doc_id", "text"]).collect():
        assert r.ids == enc.encode_ordinary(r.text or "")


def test_words_pre_tokenise_alone():
    rng = np.random.default_rng(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoder(path)
    letters = list(" \t\n ab'sé1!  \x1c\x85​᠎")
    for _ in range(3000):
        text = "".join(rng.choice(letters, rng.integers(0, 12)))
        words = bpe.words_of(text)
        assert b"".join(words).decode() == text
        assert [i for w in words for i in enc.encode_ordinary(w.decode())] == enc.encode_ordinary(text), repr(text)


def test_media(spark, docs):
    for raw in (b"\0" * 64, bytes(range(256)) * 300, b"q" * 64 * 257):
        packed = media.pack(raw)
        assert media.read_samples(packed) == raw
        t = media.sample_table(packed)
        assert t["codec"] == "raw" and t["duration"] == t["ticks"] == len(raw) // 64
        first = int(t["offsets"][t["keys"]][0])
        assert packed[first : first + 64] == raw[:64]
        for cut in range(1, len(packed), 97 if len(packed) < 5000 else 9973):
            with pytest.raises(ValueError):
                media.sample_table(packed[:cut])
    whole = media.pack_column(docs.select("doc_id", media.padded(media.text_of()).alias("p")), "p", "m")
    for r in media.samples_column(media.probe_column(whole, "m", "probe"), "m", "back").collect():
        assert r.back == r.p and len(r.p) % 64 == 0 and r.p and r.probe.codec == "raw" and r.probe.n_samples == len(r.p) // 64
    broken = media.probe_column(spark.createDataFrame([(None,), (b"abc",)], "m binary"), "m", "probe").collect()
    assert [r.probe for r in broken] == [None, None]


def test_media_never_crashes():
    """Bytes flipped, cut, stated numbers blown up, boxes nested: a ValueError or a sound table, and no large allocation."""
    rng = np.random.default_rng(6)
    whole = media.pack(bytes(range(256)) * 70)
    tables = whole.index(b"moov")

    def probe(raw):
        found = media._probe(raw)
        if found is not None:
            assert found["n_samples"] <= len(raw) and all(r["start"] + r["length"] <= len(raw) for r in found["key_ranges"])
        return found

    assert probe(whole)["n_samples"] == 280
    for _ in range(4000):
        raw = bytearray(whole)
        for at in rng.integers(tables - 4, len(raw), rng.integers(1, 4)):
            raw[at] = rng.integers(256)
        probe(bytes(raw[: len(raw) if rng.random() < 0.7 else rng.integers(len(raw))]))
    for at in range(tables, len(whole) - 4):
        for number in (b"\xff\xff\xff\xff", b"\x7f\xff\xff\xff", b"\0\0\0\0", b"\0\0\0\1"):
            probe(whole[:at] + number + whole[at + 4 :])
    nested = b""
    for _ in range(1500):
        nested = media._box(b"moov", nested)
    assert probe(nested) is None
    assert probe(media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"mdhd"))))) is None
    assert media._samples(nested) is None and probe(b"") is None


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/1?x#y", "http://example.com/de/", "http://x.example.com/de", "http://q.org/fr/x",
            "https://notnet/", "http://net", "http://net/", "http://" + "longname" * 300 + ".example.org/" + "p/" * 5000]
    pages = spark.createDataFrame([(i, u, "s", "v", 1) for i, u in enumerate(urls)], "page_id long, url string, word string, verdict string, score int")
    got = {r.url: r for r in url_filter.judge_urls(pages).collect()}
    assert len(got) == len(urls) - 1  # null counts as empty
    got = [got[u or ""] for u in urls]
    assert [r.rule for r in got] == [None, None, None, "example.net/en/", "example.com/de/", None, "org/fr/", None, None, "net/", None]
    assert got[3].host == "a.example.net" and got[3].path == "/en/1" and got[0].host == ""
    assert [got[i].verdict for i in (3, 4, 6, 9)] == ["allow", "block", "allow", "block"]
    assert "".join(got[10].words) == "longname" * 300 + "exampleorg" + "p" * 5000
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_words_and_bayes_against_brute_force(spark):
    """Counts, segmentation, odds and scores of every url, worked out here from the definitions."""
    rng = np.random.default_rng(8)
    names = ["free", "bets", "casino", "news", "river", "old", "mill", "the"]
    urls, texts = [], []
    for k in range(300):
        host = ("-" if rng.random() < 0.3 else "").join(rng.choice(names, 2)) + rng.choice([".example.net", ".example.com", ".example.org"])
        urls.append(f"http://{host}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(names)}{k % 40}.html")
        texts.append("<p>" + " ".join(rng.choice(names, 6)) + "</p>")
    pages = spark.createDataFrame(list(zip(range(300), urls, texts)), "page_id long, url string, html string").repartition(3)
    got = {r.url: r for r in url_filter.judge_urls(pages, html="html").collect()}
    runs = lambda t: re.findall("[a-z]+", t.lower())
    split = lambda u: (u[7:].partition("/")[0], "/" + u[7:].partition("/")[2])
    counts = Counter()
    for u, t in zip(urls, texts):
        host, path = split(u)
        counts.update(w for w in (runs(host) if "-" in host else []) + runs(path) + runs(re.sub("<[^>]*>", " ", t)) if 2 <= len(w) <= 30)
    total = sum(counts.values())

    def best(run):
        if not run:
            return 0.0, []
        tries = []
        for k in range(1, len(run) + 1):
            cost = np.log10(counts[run[:k]] / total) if counts[run[:k]] else -np.log10(total) - k
            tries.append((cost + memo(run[k:])[0], [run[:k], *memo(run[k:])[1]]))
        return max(tries, key=lambda x: x[0])

    memo = functools.lru_cache(None)(best)
    words = {u: [w for r in runs(split(u)[0]) for w in memo(r)[1]] + runs(split(u)[1]) for u in set(urls)}
    assert {u: got[u].words for u in words} == words
    blocked = {u for u in words if got[u].rule in ("net/", "example.com/de/") or got[u].rule is None and set(runs(split(u)[0])) & set(url_filter.TOPICS)}
    by = {c: Counter(w for u in words if (u in blocked) == c for w in words[u]) for c in (True, False)}
    size = len({w for ws in words.values() for w in ws})
    log = lambda w, c: np.log((by[c][w] + 0.5) / (sum(by[c].values()) + 0.5 * size))
    prior = np.log((len(blocked) + 0.5) / (len(words) - len(blocked) + 0.5))
    for u, ws in words.items():
        want = prior + sum(log(w, True) - log(w, False) for w in ws)
        assert got[u].score == pytest.approx(want)
        assert got[u].verdict == (("block" if u in blocked else "allow") if got[u].rule else "block" if want > 0 else "allow")


def test_viterbi_is_best():
    counts = {"a": 3, "ab": 5, "b": 2, "abc": 1, "ca": 4}
    model = url_filter.HostWords(sum(counts.values()))

    def cost(parts):
        return sum(model.known(counts[p]) if p in counts else model.unknown(len(p)) for p in parts)

    def splits(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])]

    for run in ("abcabca", "zabz", "zzz", "cab"):
        assert "".join(model.split(run, counts)) == run
        assert cost(model.split(run, counts)) == pytest.approx(max(map(cost, splits(run))))
    assert "".join(model.split("q" * 20_000, counts)) == "q" * 20_000


def test_chat_round_trip(spark):
    odd = ["", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_start|>", "<\\\\|", "a<|b", "x\n", None, "<|im_start|>", "<|im_end|"]
    rows = [(c, t, r, x, 0) for c in (1, 2) for t, (r, x) in enumerate([(r, x) for r in ("user", "assistant", "we\nird<|im_end|>", None) for x in odd])]
    rows += [(3, None, "assistant", "n", 0), (3, None, "assistant", "n", 0), (None, 1, "user", "u", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int").repartition(5)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.render_turns(df)).collect()}
    for c in (1, 2):
        turns = [(r or "", x or "") for cc, _, r, x, _ in rows if cc == c]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns).encode())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss.encode()))
    assert got[3].n_turns == 2 and got[3].loss_chars == 2 and got[None].n_turns == 1
    assert "<|im_" not in chat_format.render_turn("user", odd[2])[len("<|im_start|>") : -len("<|im_end|>\n")]
    assert chat_format.read_back(chat_format.render_turns(df.limit(0))).count() == 0


def test_warc(spark):
    long = "é" * 80
    pages = [(5, "http://b.com/2", long), (2, "http://www.a.com:80/x?y#z", long), (9, "http://a.com/x", "short"), (4, None, None), (7, "http://a.com/x", "short"),
             (3, "http://a.com/", "z" * 100), (3, "http://a.com/", "z" * 100), (None, "http://n.com/", long), (8, "u\r\nv%0A", "z" * 100)]
    df = spark.createDataFrame([(*p, f"2024010100000{k}") for k, p in enumerate(pages)], "page_id long, url string, html string, ts string").repartition(4)
    archives = warc.write_archives(df)
    merged = warc.merge_runs(warc.capture_runs(archives)).orderBy("range", "pos").collect()
    assert len(merged) == len(pages)
    assert [warc.sort_key((r.page_id, r.urlkey, r.ts)) for r in merged] == sorted(warc.sort_key((r.page_id, r.urlkey, r.ts)) for r in merged)
    got = {r.page_id: r for r in merged}
    assert got[5].record_type == "revisit" and got[5].refers_to == 2 and got[2].record_type == "response" and got[9].record_type == "response"
    assert got[5].payload_digest == sha(long.encode()) and got[5].payload_bytes == 160 and got[4].payload_bytes == 0 and got[4].urlkey == ""
    assert got[None].refers_to == 2 and got[8].refers_to == 3 and got[8].target == "u\r\nv%0A" and got[3].record_type == "response"
    assert got[2].urlkey == "com,a)/x?y"
    assert warc.merge_runs(warc.capture_runs(warc.write_archives(df.limit(0)))).count() == 0


def test_op1_against_sql(spark):
    """The query on the smallest tables, row by row."""
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    want = duckdb.sql(f"""
        WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM '{d}/pages.parquet'),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
        SELECT page_id, n, digest, CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END,
               CASE WHEN n >= 100 AND page_id > first_id THEN first_id END FROM f""").fetchall()
    got = warc.op1_warc_index(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_merge_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = spark.range(1000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.com/', concat('http://h', cast(id % 50 as string), '.com/')) as url", "'x' as html", "'20240101000000' as ts")
    rows = warc.merge_runs(warc.capture_runs(warc.write_archives(df.repartition(4)))).orderBy("range", "pos").collect()
    keys = [(r.urlkey, r.ts, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(set(r.page_id for r in rows)) == 1000
    assert max(Counter(r.range for r in rows).values()) < 120


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in range(0, 12):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_quality(spark):
    good, bad = "The river ran past the old mill and on to the sea. ", "BUY NOW!! CHEAP!! "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 5) + f"w{i}", 0.0) for i in range(300)] + [(300, None, 0.0), (None, "x", 0.0), (5, "twice", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, None), (2, 7), (9999, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert len(quality.score_documents(docs, model).collect()) == len(rows)
    assert np.mean([(got[i]["__score"] >= 0.5) == (i % 3 > 0) for i in range(300) if i != 5 and zlib.crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert 0 <= got[300]["__score"] <= 1
    assert quality.fit(docs, labels.limit(0))[1] == 0.0 and quality.score_documents(docs.limit(0), model).count() == 0


def test_ftrl_gradient_steps_fit():
    rng = np.random.default_rng(0)
    rows = [(np.array([3, 5 + k % 2]), np.array([1.0, 1.0]), k % 2) for k in rng.permutation(400)]
    w, b = quality.train(rows)
    assert w[3] + w[6] + b > 1 and w[3] + w[5] + b < -1


def test_lm_counts_and_base(spark, docs, none):
    got = lm_score.score_documents(docs).collect()
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    train = [r for r in rows if not held(r.doc_id)]
    counts = Counter(w for r in train for w in (r.text or "").encode().lower().split())
    total, distinct = sum(counts.values()) + len(train), len(counts) + 1

    def want(r):
        own = [counts[w] for w in (r.text or "").encode().lower().split()] + [len(train)]
        base = sum(np.log10((c + 0.1) / (total + 0.1 * (distinct + 1))) for c in own)
        return str(r.doc_id), held(r.doc_id), len(own), sum(c > 0 for c in own), total, round(base, 6)

    assert sorted(map(want, rows)) == sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got)
    assert all(g.score < 0 for g in got)
    assert lm_score.score_documents(none).count() == 0


def test_lm_gradient_and_windows():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 900, 100).astype("i4")
    row = (2 + np.arange(901) % 1000).astype("i4")
    rank = (np.arange(901) * 7 % (lm_score.REST + 1)).astype("i4")
    lengths = np.array([1, 60, 39])
    inputs, starts, scored = lm_score.layout(ids, lengths, row)
    assert len(np.unique(scored)) == 100 and len(starts) == 1 + 3 + 2
    windows = inputs[starts[:, None] + np.arange(lm_score._LEN)]
    prev = windows[:, lm_score.CONTEXT :].ravel()[scored]
    assert (prev[[0, 1, 61]] == lm_score.BOS).all() and prev[2] == row[ids[1]] and prev[99] == row[ids[98]]
    targets = np.full(len(starts) * lm_score.STRIDE, -1, "i4")
    targets[scored] = rank[ids]
    targets = targets.reshape(-1, lm_score.STRIDE)
    flat = lm_score.start_weights([np.zeros(n, "f4") for n in (lm_score.WIDTH, *lm_score.TAILS)]) * 3
    loss, g = lm_score.gradient(lm_score.unpack(flat), windows, targets)
    assert loss == pytest.approx(-lm_score.score_ranks(flat, inputs, starts, targets).ravel()[scored].mean() * np.log(10), rel=1e-3)
    for k in np.argsort(-abs(g))[rng.integers(0, 400, 12)]:
        up, down = flat.astype("f8"), flat.astype("f8")
        up[k] += 1e-4
        down[k] -= 1e-4
        slope = (lm_score.gradient(lm_score.unpack(up), windows, targets)[0] - lm_score.gradient(lm_score.unpack(down), windows, targets)[0]) / 2e-4
        assert slope == pytest.approx(g[k], rel=0.03, abs=1e-5)
    # a probability: ranks sum to one at any position
    n = lm_score.REST + 1
    one = lm_score.score_ranks(flat, inputs, np.repeat(starts[1:2], n), np.repeat(np.arange(n, dtype="i4")[:, None], lm_score.STRIDE, 1))
    assert (10 ** one.astype("f8")).sum(0) == pytest.approx(1, abs=1e-3)


def test_lm_sums_gradients_by_id():
    """Frequent, rare and single ids, against plain addition; and clearly faster than one reduceat over the sorted rows, as it was done before."""
    rng = np.random.default_rng(3)
    skewed = np.minimum(rng.zipf(1.3, 4096), 1000).astype("i4")
    for ids in (skewed, np.full(4096, 7, "i4"), np.arange(900, dtype="i4"), np.repeat(np.arange(100, dtype="i4"), lm_score._FEW), np.zeros(1, "i4")):
        grads = rng.normal(size=(len(ids), 129)).astype("f4")
        want = np.zeros((lm_score.INPUTS, 129))
        np.add.at(want, ids, grads)
        assert lm_score._scatter(lm_score.INPUTS, ids, grads) == pytest.approx(want, abs=1e-3)
    ids, grads = np.minimum(rng.exponential(100, 4096), 1000).astype("i4"), rng.normal(size=(4096, 129)).astype("f4")

    def plain():
        order = np.argsort(ids, kind="stable")
        rows, first = np.unique(ids[order], return_index=True)
        out = np.zeros((lm_score.INPUTS, 129), "f4")
        out[rows] = np.add.reduceat(grads[order], first, axis=0)

    best = lambda run: min(timeit.repeat(run, number=1, repeat=40))
    assert best(lambda: lm_score._scatter(lm_score.INPUTS, ids, grads)) < 0.8 * best(plain)


def test_lm_multiplies_by_pieces():
    """Products by some rows at a time are the whole ones, clearly faster where a softmax's gradients are summed; and learning, which leaves the
    loss out, moves weights by the same gradient. Start weights are drawn as they were before ids had one row each."""
    rng = np.random.default_rng(6)
    for n, width in ((3072, lm_score.WIDTH), (797, 128), (335, 320), (1, 512), (40, 512), (0, 128)):
        x, w = rng.normal(size=(n, lm_score.DIM + 1)).astype("f4"), rng.normal(size=(lm_score.DIM + 1, width)).astype("f4")
        d = lm_score._product(x, w, width)
        assert d == pytest.approx(x @ w, abs=1e-3)
        assert lm_score._product(d, np.ascontiguousarray(w.T), width) == pytest.approx(d @ w.T, abs=5e-2)
        assert lm_score._sums(x, d) == pytest.approx(x.T @ d, abs=5e-2)
    # one thread, as in a task
    code = """
import timeit, numpy as np
from cairn.llm import lm_score
x, d = (np.random.default_rng(6).normal(size=(3072, k)).astype("f4") for k in (lm_score.DIM + 1, lm_score.WIDTH))
print(*(min(timeit.repeat(run, number=1, repeat=200)) for run in (lambda: lm_score._sums(x, d), lambda: x.T @ d)))
"""
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join(sys.path)}
    pieces, whole = map(float, subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout.split())
    assert pieces < 0.9 * whole

    p = lm_score.unpack(lm_score.start_weights([np.zeros(n, "f4") for n in (lm_score.WIDTH, *lm_score.TAILS)]))
    drawn = np.random.default_rng(7).normal(0, 0.1, 4 * lm_score.INPUTS * lm_score.DIM + lm_score.INPUTS).astype("f4")
    q, k, v, o = (x.reshape(lm_score.INPUTS, -1) for x in np.split(drawn, np.cumsum([lm_score.INPUTS * (lm_score.DIM + (i == 1)) for i in range(3)])))
    assert (p["q"] == q).all() and (p["k"][:, :-1] == k[:, :-1]).all() and (p["v"] == v).all() and (p["o"] == o).all()
    windows = rng.integers(1, lm_score.INPUTS, (50, lm_score._LEN)).astype("i4")
    targets = rng.integers(-1, lm_score.REST + 1, (50, lm_score.STRIDE)).astype("i4")
    loss, g = lm_score.gradient(p, windows, targets)
    assert loss > 0 and (lm_score.gradient(p, windows, targets, told=False)[1] == g).all()


def test_lm_steps():
    """A learner's weights after some steps are those of Adam's formulas."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 90, 60)
    ids = rng.integers(0, 900, int(lengths.sum())).astype("i4")
    inputs, starts, _, targets = lm_score._windows(ids, lengths, (2 + np.arange(900)).astype("i4"), np.arange(900, dtype="i4"))
    flat = lm_score.start_weights([np.zeros(n, "f4") for n in (lm_score.WIDTH, *lm_score.TAILS)])
    learner = lm_score.Adam(flat, 1)
    order, steps = np.random.default_rng(1).permutation(len(starts)), -(-len(starts) // lm_score.BATCH)
    m, s = np.zeros_like(flat), np.zeros_like(flat)
    learner.learn(inputs, starts, targets)
    assert steps > 1
    for k in range(steps):
        pick = order[k * lm_score.BATCH : (k + 1) * lm_score.BATCH]
        _, g = lm_score.gradient(lm_score.unpack(flat), inputs[starts[pick][:, None] + np.arange(lm_score._LEN)], targets[pick])
        m, s = m + 0.1 * (g - m), s + 0.01 * (g * g - s)
        rate = lm_score.RATE * (1 - 0.9 * k / steps) * (1 - 0.99 ** (k + 1)) ** 0.5 / (1 - 0.9 ** (k + 1))
        flat = flat - rate * m / (np.sqrt(s) + 1e-8)
    assert learner.flat == pytest.approx(flat, abs=1e-5)


def test_lm_beats_the_base(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(["ka", "to", "mi", "ru", "se"], 3)) for _ in range(50)]

    def text():
        out, k = [], 0
        for _ in range(120):
            k = (k * 7 + 3) % 50 if rng.random() < 0.9 else int(rng.integers(50))
            out.append(words[k])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(500)], "doc_id long, text string").coalesce(1)
    got = lm_score.score_documents(df).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_lm_fits_on_all_training_documents(spark, monkeypatch):
    """An id's row moves only if a text that has it was learnt from: here each text has an id of its own, over many blocks."""
    monkeypatch.setattr(lm_score, "FIRST_SHARE", 1000)  # the first round reads next to nothing
    size, n = 2000, 400
    own = np.arange(n) + 1000
    blocks = []
    for part in np.array_split(np.arange(n), 8):
        ids = np.stack([np.full(len(part), 1), own[part], np.full(len(part), size)], 1).ravel()
        held = np.arange(len(part)) == 0
        blocks.append((lm_score._ints(ids), lm_score._ints(np.full(len(part), 3)), held.tobytes()))
    laid = spark.createDataFrame(blocks, "ids binary, n_ids binary, held_out binary").repartition(3)
    counts = np.zeros(size + 1, "i8")
    counts[[1, *own]] = 5
    ids = lm_score.Ids(counts)
    start = lm_score.unpack(lm_score.start_weights(ids.bias))["o"]
    moved = (lm_score.unpack(lm_score._fit(laid, ids))["o"] != start).any(1)[ids.row[own]]
    held = np.concatenate([np.arange(len(p)) == 0 for p in np.array_split(np.arange(n), 8)])
    assert moved[~held].all() and not moved[held].any()


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    good = "The river ran past the old mill number {} and on to the sea with {} boats, then {} more under a grey sky."
    rows = [(i, good.format(i * 7919 % 1000, i, i * 31), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[0][1] + " ", "en", "s0", 0) for i in range(10)] + [(200 + i, "BUY NOW!! CHEAP!! " * 9 + str(i), "en", "s1", 0) for i in range(20)] + [(300, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows[:-1]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, d)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        seen = spark.read.parquet(f"{d}/stage{k}")
        if k == 0:
            left = {r.doc_id for r in seen.collect()}
            assert not left & set(range(200, 220)) and set(range(60)) <= left
        if k == 1:
            assert not {r.doc_id for r in seen.collect()} & set(range(101, 110))
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))


def test_quality_sample_is_bounded_by_rows(spark):
    """20,000 rows of one labelled id are one row of the sample."""
    docs = spark.range(20_000).selectExpr("7L as doc_id", "concat('some words ', id) as text").union(spark.createDataFrame([(3, "good text"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (3, 0), (4, 1), (7, 1)], "doc_id long, quality int")
    assert [zlib.crc32(str(i).encode()) % 5 != 0 for i in (7, 3, 4)] == [True] * 3
    assert sorted((r.t, r.y) for r in quality.training_sample(docs, labels).collect()) == [("", 1), ("good text", 0), ("some words 0", 1)]


def test_release_is_of_one_thread(spark):
    """A thread that releases what it wrote leaves the folders of another."""
    import threading

    from cairn.llm import common

    mark, mine = common.written(), common.materialize(spark.range(5).toDF("x"), "mine")

    def other():
        start = common.written()
        common.materialize(spark.range(3).toDF("x"), "other")
        common.materialize(spark.range(4).toDF("x"), "other")
        common.release(spark, start, keep=0)

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert mine.count() == 5
    common.release(spark, mark, keep=0)
    with pytest.raises(Exception):  # noqa: B017 - the file is gone
        mine.count()


def test_run_together_hosts_are_blocked_through_their_segments(spark, monkeypatch):
    """Names that no url has taught are blocked where their segments are words of blocked urls; as whole names they say nothing."""
    text = "<p>" + "free casino bets garden music win letters house " * 20 + "</p>"
    rows = [(f"https://free-casino-bets.example.com/en/{k}", text) for k in range(12)] + [(f"https://win-casino.example.com/a{k}", text) for k in range(8)]
    rows += [(f"https://{h}.example.com/en/{k}", text) for h in ("garden-house", "music-letters", "house-music") for k in range(15)]
    planted = ["https://freecasinobets.example.com/en/x", "https://www.casinowin.example.com/"]
    clean = ["https://gardenmusic.example.com/en/x", "https://lettershouse.example.org/"]
    pages = spark.createDataFrame(rows + [(u, text) for u in planted + clean], "url string, html string")
    verdicts = lambda: {r.url: r.verdict for r in url_filter.judge_urls(pages, html="html").collect()}
    got = verdicts()
    assert [got[u] for u in planted] == ["block"] * 2 and [got[u] for u in clean] == ["allow"] * 2
    monkeypatch.setattr(url_filter, "segment", lambda runs, counts: runs.select("run", F.array("run").alias("words")))
    whole = verdicts()
    assert {whole[u] for u in planted + clean} == {"allow"} and whole[rows[0][0]] == "block"

"""The segmented index against one that is built anew after every few changes."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.sources import segments

WORDS = "alpha beta gamma delta total price save load".split()


def text(rnd, n):
    """A small Python file with imports and calls of others."""
    use = rnd.sample(range(12), 2)
    lines = [f"import m{k}" for k in use] + ["", f"LIMIT_{rnd.choice(WORDS)} = {n}", ""]
    for k in range(rnd.randint(0, 3)):
        lines += [f"def {rnd.choice(WORDS)}_{k}(x):", f"    return m{use[0]}.{rnd.choice(WORDS)}(x)", ""]
    return "\n".join(lines) + ("def broken(:\n" if rnd.random() < 0.2 else "")


def model(files, batch):
    """``files`` after the batch, worked out one change after the other."""
    files = dict(files)
    for path, _, action, content, new in sorted(batch, key=lambda c: c[1]):
        if action == "modified":
            files[path] = content or ""
        elif action == "deleted":
            files.pop(path, None)
        elif new != path and path in files:
            files[new] = files.pop(path)
    return files


def state_of(spark, root):
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    out = {s: rows(segments.live(spark, root, s).drop("seq")) for s in segments.STORES if s != "vectors"}
    out["vectors"] = rows(segments.live(spark, root, "vectors").select("path", "id", F.transform("embedding", lambda x: F.round(x, 5))))
    out |= {s: rows(segments.sums(spark, root, s)) for s in segments.SUMS}
    out["edges"] = rows(segments.edges(spark, root))
    out["bm25"] = rows(segments.bm25_topk(spark, root, ["alpha", "total", "save", "none"], 7).select("id", "path", F.round("score", 6)))
    return out


def test_equals_a_rebuild(spark, tmp_path):
    rnd, files, root = random.Random(2), {}, f"file://{tmp_path}/index"
    for number in range(5):
        batch, n = [], 0
        for _ in range(rnd.randint(2, 7)):
            n += 1
            path = f"{rnd.choice(['', 'test/'])}m{rnd.randrange(12)}.py"
            kind = rnd.choice(["modified", "modified", "renamed", "deleted"])
            batch.append((path, n, kind, text(rnd, n) if kind == "modified" else None, f"m{rnd.randrange(12)}.py" if kind == "renamed" else None))
        if number == 2:  # a chain of renames, a swap by a third name, and a rename of what the batch wrote
            batch += [("m0.py", 20, "modified", text(rnd, 99), None), ("m0.py", 21, "renamed", None, "t.py"), ("m1.py", 22, "renamed", None, "m0.py"), ("t.py", 23, "renamed", None, "m1.py"), ("gone.py", 24, "renamed", None, "m5.py"), ("../out.py", 25, "modified", "x = 1", None)]
        files = model(files, [c for c in batch if not c[0].startswith("..")])
        state = segments.apply_batch(spark, root, spark.createDataFrame(batch, segments.CHANGES), number)
        assert segments.apply_batch(spark, root, spark.createDataFrame(batch, segments.CHANGES), number) == state  # a repeated batch changes nothing
        assert {r.path: r.content for r in segments.live(spark, root, "files").collect()} == files
    assert len(state["segments"]) < 5 and max(s["level"] for s in state["segments"]) == 1
    anew = f"file://{tmp_path}/anew"
    segments.apply_batch(spark, anew, spark.createDataFrame([(p, k, "modified", c, None) for k, (p, c) in enumerate(files.items())], segments.CHANGES), 0)
    want = state_of(spark, anew)
    assert state_of(spark, root) == want
    whole = segments.merge(spark, root, segments.manifest(spark, root), segments.manifest(spark, root)["segments"])
    assert len(whole["segments"]) == 1 and not whole["tombs"] and segments.vacuum(spark, root)
    assert state_of(spark, root) == want


def test_stream_and_plan(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    changes = str(tmp_path / "changes")
    for k, batch in enumerate([[("a.py", 1, "modified", "def total():\n    return 1\n", None), ("b.txt", 2, "modified", "no source", None)], [("a.py", 3, "renamed", None, "c.py")], []]):
        spark.createDataFrame(batch, segments.CHANGES).coalesce(1).write.mode("append").parquet(changes)
        segments.upkeep(spark.readStream.schema(segments.CHANGES).parquet(changes), root, str(tmp_path / "ck")).awaitTermination()
        assert {r.path for r in segments.live(spark, root, "files").collect()} == ({"a.py"} if k == 0 else {"c.py"})
    assert [r.path for r in segments.bm25_topk(spark, root, ["total"], 3).collect()] == ["c.py"]
    plan = segments.live(spark, root, "chunks")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan  # content is not shuffled
    with pytest.raises(RuntimeError):
        segments._commit(spark, root, segments.manifest(spark, root) | {"version": 0})

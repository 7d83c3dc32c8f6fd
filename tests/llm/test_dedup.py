"""Dedup operators against plain Python on awkward documents."""

import pathlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, components, distinct, frame, lower, sha, texts, words
from tidemark.llm import bwt, embeddings, exchange, lines, minhash, substring
from tidemark.llm.suffix import search, suffix_order
from tidemark.llm.tables import written
from tidemark.session import ship_package


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def rows():
    return sorted(set(texts()), key=lambda r: r[0])


def test_lines(docs, rows):
    white = " \t\n\x0b\x0c\r"
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(lower(line.strip(white)), set()).add(i)
    want = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not (len(k := lower(x.strip(white))) >= 10 and len(holders[k]) > 1 and i != min(holders[k]))]
        want.append((i, len(all_lines), len(all_lines) - len(keep), sha("\n".join(keep))))
    assert distinct(lines.digest(lines.dedup_lines(docs))) == sorted(want, key=repr)


def test_words(docs, rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k: k + 20]), (i, k))
    want = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k: k + 20])] != (i, k):
                gone |= set(range(k, k + 20))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert sum(r[2] for r in want) > 500
    assert distinct(substring.digest(substring.dedup_substrings(docs))) == sorted(want, key=repr)


def test_bytes(docs, rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k: k + 50], i)
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k: k + 50]] < i:
                gone[k: k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    assert sum(r[2] for r in want) > 3000
    assert distinct(bwt.digest(bwt.dedup_bytes(docs))) == sorted(want, key=repr)


def shingles(t, size):
    w = words(lower(t or ""))
    return {tuple(w[k: k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = components(list(sets), links)
    want = sorted(((i, len(s), low[i], low[i] == i) for i, s in sets.items()), key=repr)
    assert len(set(low.values())) < len(low)
    got = minhash.near_duplicates(docs, size=size)
    assert distinct(got) == want
    assert got.count() == docs.count()


def test_near_duplicates_of_a_loose_group(spark):
    """Variants around one text, many of them linked with few others: blocks of all kinds."""
    ship_package(spark)
    r = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.choice(120, int(r.integers(1, 14)), replace=False):
            w[k] = f"x{r.integers(10**6)}"
        rows.append((int(i), " ".join(w)))
    sets = {i: shingles(t, 2) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = components(list(sets), links)
    assert 3 < len(set(low.values())) < 120
    want = sorted(((i, len(s), low[i], low[i] == i) for i, s in sets.items()), key=repr)
    for block in (16, 256):
        assert distinct(minhash.near_duplicates(frame(spark, rows), size=2, block=block)) == want


@pytest.mark.parametrize("run", [
    lambda d: lines.digest(lines.dedup_lines(d)), lambda d: substring.digest(substring.dedup_substrings(d)),
    lambda d: bwt.digest(bwt.dedup_bytes(d)), minhash.near_duplicates])
def test_empty_and_nameless(spark, run):
    ship_package(spark)
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "the same words again and again " * 10
    got = run(frame(spark, [(None, t), (None, t), (4, t), (9, t)]))
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r.asDict())
    assert len(by[None]) == 2 and by[None][0] == by[None][1]
    if "kept" in got.columns:
        assert by[None][0]["kept"] and by[4][0]["kept"] and not by[9][0]["kept"]
    else:
        lost = "n_dropped" if "n_dropped" in got.columns else "n_removed"
        assert by[9][0][lost] > 0


def brute_vectors(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    sizes = {i: len(v) for i, v in ok}
    links = []
    for x, (a, v) in enumerate(ok):
        for b, w in ok[x + 1:]:
            if len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                links.append((a, b))
    low = components([i for i, _ in rows], links)
    count = dict.fromkeys(low, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert sizes
    return sorted(((i, count[i], low[i], low[i] == i) for i, _ in rows), key=repr)


@pytest.mark.parametrize("block,core", [(1024, 64), (30, 10)])
def test_embeddings(spark, block, core):
    ship_package(spark)
    r = np.random.default_rng(1)
    vectors = []
    for k in range(4):
        c = r.normal(size=24)
        spread = 0.05 if k == 0 else 0.22
        vectors += [c + r.normal(size=24) * spread * np.linalg.norm(c) / 5 for _ in range(120 if k < 2 else 15)]
        vectors += [c, c, c * 2]
    vectors += list(r.normal(size=(60, 24)))
    rows = [v.tolist() for v in vectors] + [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23,
                                            [float("inf")] + [1.0] * 23, [1.0, 2.0], [1.0, 2.01], [1e200] * 24, [3e200] * 24]
    rows = [(int(i) * 2, v) for i, v in zip(r.permutation(len(rows)), rows)]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    got = embeddings.near_duplicates(d, block=block, core_size=core)
    with np.errstate(over="ignore"):
        scaled = [(i, [x / 1e200 for x in v] if v and v[0] and abs(v[0]) > 1e100 and np.isfinite(v[0]) else v) for i, v in rows]
    assert distinct(got) == brute_vectors(scaled)
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_embeddings_without_id(spark):
    ship_package(spark)
    d = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (5, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert distinct(embeddings.near_duplicates(d)) == sorted([(None, 0, None, True), (3, 1, 3, True), (5, 1, 3, False)], key=repr)


def test_suffix_order_and_search():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 400):
        t = r.integers(0, 3, n)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        order = suffix_order(t, max(n, 1))
        assert order.tolist() == want
        patterns = r.integers(0, 3, (20, 4))
        lengths = r.integers(1, 5, 20)
        low, high = search(t, order, patterns, lengths)
        for p, k, a, e in zip(patterns, lengths, low, high):
            assert sorted(order[a:e].tolist()) == [i for i in range(n - k + 1) if (t[i: i + k] == p[:k]).all()]


def test_matching_statistics_are_those_of_neighbours():
    r = np.random.default_rng(5)
    t = np.concatenate([r.integers(0, 4, 200), [9], np.tile(r.integers(0, 4, 30), 8), [10]])
    levels = []
    order = suffix_order(t, len(t), levels)
    got = bwt.matching_statistics(t, order, levels)
    for k in range(1, len(t)):
        a, b = t[order[k - 1]:], t[order[k]:]
        n = min(len(a), len(b))
        same = np.flatnonzero(a[:n] != b[:n])
        assert got[order[k]] == (same[0] if len(same) else n)
    borders = int((np.diff(t[order - 1]) != 0).sum()) + 1
    assert borders < 0.6 * len(t)  # the repeats are runs


def test_long_texts_sort_without_packing(monkeypatch):
    from tidemark.llm import suffix

    t = np.random.default_rng(2).integers(0, 2, 300)
    want = suffix_order(t, 300).tolist()
    monkeypatch.setattr(suffix, "PACKED", 64)
    assert suffix.suffix_order(t, 300).tolist() == want


def test_hot_line_join_can_be_split(docs):
    plan = lines.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_passage_of_many_texts_is_combined_before_it_is_sent():
    """Entries of one bucket that a task sends for one key or stretch, from 500 texts that hold it."""
    m = 500
    ids, owns, doc, key = np.arange(m), np.arange(m) * 7919 % 503, np.arange(m), np.full(m, 5, np.uint64)
    one, at = np.full(m, 5, np.uint32), np.arange(m, dtype=np.int32)
    page = np.frombuffer(b"x" * 60 * m, np.uint8)
    for combine, values, ragged in [
        (bwt._combine_anchors, [one], None),
        (bwt._combine_stretches(50), [one, at, np.full(m, 60, np.int32)], (page, np.arange(m) * 60)),
        (substring._combine_probes, [one], None),
        (substring._combine_windows, [key, one, at], None),
    ]:
        sender = exchange.Sender(4, combine)
        batches = [*sender.add(ids, owns, doc, key, *values, ragged=ragged), *sender.flush()]
        rows = [r for b in batches for r in b.to_pylist()]
        sent = sum(int(np.frombuffer(r["counts"], np.int32).sum()) for r in rows if r["bucket"] >= 0)
        told = sum(len(r["ids"]) // 8 for r in rows if r["bucket"] < 0)
        assert sent <= 4 and sent + told >= m


def test_a_passage_of_many_texts(spark):
    """In several tasks, with copies, and against plain Python."""
    ship_package(spark)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    footer = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(1, 30)))) + " " + " ".join(footer.split()[i % 5:]) + " " + word()) for i in range(150)]
    rows += [(1000 - i, rows[i][1]) for i in range(0, 40, 3)]
    docs = frame(spark, rows).repartition(7).cache()
    first, gone = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k: k + 20]), (i, k))
    for i, t in rows:
        w = t.split()
        gone[i] = {p for k in range(len(w) - 19) if first[tuple(w[k: k + 20])] != (i, k) for p in range(k, k + 20)}
    got = {r["row"]["doc_id"]: r["n_removed"] for r in substring.dedup_substrings(docs, keep=["doc_id"]).collect()}
    assert got == {i: len(g) for i, g in gone.items()}
    least: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for k in range(len(t) - 49):
            least.setdefault(t[k: k + 50], i)
    want = {i: len({p for k in range(len(t) - 49) if least[t[k: k + 50]] < i for p in range(k, k + 50)}) for i, t in rows}
    got = {r["row"]["doc_id"]: r["n_removed"] for r in bwt.dedup_bytes(docs, keep=["doc_id"]).collect()}
    assert got == want


def test_stretches_are_packed_before_they_are_sent():
    """Text without repeats takes less room on its way, and comes out as it was."""
    rng = np.random.default_rng(4)
    m, size = 3000, 66
    page = rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), m * size)
    ids, at, key = np.arange(m), np.arange(m, dtype=np.int32), np.arange(m, dtype=np.uint32)
    sender = exchange.Sender(4, bwt._combine_stretches(50))
    batches = [*sender.add(ids, ids, ids, key.astype(np.uint64), key, at, np.full(m, size, np.int32), ragged=(page, ids * size)), *sender.flush()]
    assert sum(len(r["data"]) for b in batches for r in b.to_pylist()) < 0.6 * len(page)
    for b in batches:
        t = pa.Table.from_batches([b])
        of = np.concatenate([np.frombuffer(x, np.int32) for x in t["v1"].to_pylist()])
        assert (exchange._stretches(t["data"], t["v2"], np.int32) == page.reshape(m, size)[of].ravel()).all()


def test_shuffle_files_go_once_a_table_is_written(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    there = lambda: {p.name for d in folders for p in pathlib.Path(d.getPath()).rglob("shuffle_*")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_before = there(), spark.conf.get(setting, None)
    d = spark.range(10_000).groupBy((F.col("id") % 7).alias("k"))
    table = written(d.agg(F.sum("id").alias("n")).join(d.count().hint("merge"), "k"), "test")
    until = time.time() + 10
    while (left := there() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(setting, None) == set_before
    assert table.count() == 7 and table.agg(F.sum("count")).first()[0] == 10_000

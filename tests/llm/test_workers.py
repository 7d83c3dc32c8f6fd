"""What a worker remembers, and ids of tokenizers of other kinds."""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontam, langid, minhash, packing, tables, text as tx

AWKWARD = ["", "Don't stop. It's 12,5 o'clock!?", "ÉCOLE, straße. İstanbul ǅ ﬁn ªº", "x.<|endoftext|>y. <|ENDOFTEXT|>.", "a\x0bb.\x0bc; d…",
           "école. é", "word.\nword,\tWord?!", "日本語。 слово, λόγος.", "\x1c a. b. ", "it's. we'll... 'd", "\0 a\0b."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_whole_text(name):
    path = public_tokenizers.path(name)
    ids, starts = packing.token_ids(pa.array(AWKWARD, pa.large_string()), path, 0)
    tokenizer = Tokenizer.from_file(path)
    assert packing._TEXT_IDS[path].by_word == (name == "word_bpe_49k.json")
    for i, t in enumerate(AWKWARD):
        assert ids[starts[i]: starts[i + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_a_worker_holds_the_words_of_one_operator_within_bytes(monkeypatch):
    monkeypatch.setattr(tx.Remembered, "BYTES", 20_000)
    asked = []
    one = tx.Remembered(lambda ws: asked.extend(ws) or [b"" if w == b"none" else w for w in ws])
    two = tx.Remembered(lambda ws: [w[::-1] for w in ws])
    assert one.of([b"none", b"a"]) == [b"", b"a"] and one.of([b"none"]) == [b""]
    assert asked == [b"none", b"a"]  # no ids are an answer too
    for k in range(100):
        words = [b"%d-%d" % (k, i) for i in range(50)]
        assert one.of(words) == words
        assert len(one.young) + len(one.old) <= 2 * 20_000 // one.ENTRY
    assert two.of([b"ab"]) == [b"ba"] and not one.young and not one.old
    many = [b"w%d" % i for i in range(1000)]
    assert two.of(many) == [w[::-1] for w in many] and len(two.young) <= 20_000 // two.ENTRY


def test_language_groups_hold_a_bounded_number_of_words():
    size = np.array([0, 5, 0, 40, 3, 3, 3, 0])
    groups = list(langid._groups(size, 10))
    assert [k for i, j in groups for k in range(i, j)] == list(range(8))
    assert all(size[i:j].sum() <= 10 or j == i + 1 for i, j in groups)


def anonymous_mb() -> float:
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_a_worker_gives_back_what_a_task_no_longer_uses():
    kept = []

    def run(batches):
        for b in batches:
            held = [np.ones(5_000) for _ in range(5_000)]  # 200 MB
            kept.append(held[-1])  # the last one keeps the rest from going by itself
            del held
            yield b

    before, batch = anonymous_mb(), pa.RecordBatch.from_pydict({"n": [1]})
    assert list(run([batch])) == [batch]
    assert anonymous_mb() > before + 100
    assert list(tables.freeing(run)(iter([batch]))) == [batch]
    assert anonymous_mb() < before + 60


@pytest.fixture
def unset(spark):
    before = spark.conf.getAll.get(tables._BATCH)
    spark.conf.unset(tables._BATCH)
    yield
    spark.conf.unset(tables._BATCH)
    if before is not None:
        spark.conf.set(tables._BATCH, before)


def test_texts_reach_the_workers_in_batches_of_bounded_bytes(spark, unset):
    docs = spark.range(3_000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1_000).alias("text"))  # 33 MB

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    sizes = tables.map_texts(docs, run, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in sizes) == 3_000 and max(r["bytes"] for r in sizes) < 1.1 * tables.BATCH_BYTES
    spark.conf.set(tables._BATCH, "1000000")  # what the session sets stays
    sizes = tables.map_texts(docs, run, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in sizes) == 3_000 and max(r["bytes"] for r in sizes) < 1_100_000


@pytest.mark.parametrize("operator", [
    lambda d: langid.predict(d, langid.fit([])), lambda d: decontam.find_benchmark(d, d, item_col="doc_id"),
    lambda d: packing.pieces(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: minhash.signatures(d, 2, 4),
    lambda d: minhash.full_sets(d, d.select(F.col("doc_id").alias("rep"), F.lit(b"").alias("key")), 2)])
def test_operators_on_texts_bound_their_batches(spark, unset, operator):
    operator(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    assert spark.conf.getAll[tables._BATCH] == str(tables.BATCH_BYTES)

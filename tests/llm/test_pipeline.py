"""The corpus pipeline, each stage against plain Python on what the stage before kept."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.data import components, lower, words
from tidemark.llm.queries import tokenizer_path

SYLLABLES = {"aa": "ka lo mi tu ren", "bb": "sch eit ung der gen"}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(5)
    say = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))
    bench = [(k, say("aa", 20)) for k in range(5)]
    rows = []
    for i in range(120):
        lang = r.choice(["aa", "bb"])
        rows.append((i, say(lang, r.randint(30, 90)), lang))
    line = "a line that many documents share " + say("aa", 4)
    for i in range(0, 40, 4):
        rows[i] = (i, rows[i][1] + "\n" + line, rows[i][2])
    rows += [(200 + i, bench[i][1] + " " + say("aa", 10), "aa") for i in range(5)]       # contaminated
    rows += [(300, say("aa", 600) + " " + bench[0][1], "aa")]                             # a passage below the rule
    near = say("bb", 200).split()
    for i in range(6):
        w = list(near)
        w[10 * i] = "other"
        rows.append((400 + i, " ".join(w), "bb"))
    rows += [(500, None, "aa"), (501, "", None), (502, "123 456 :: 7", None), (503, rows[1][1], rows[1][2]), (504, line, "aa"),
             (505, say("bb", 3000), "bb")]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, bench


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_do_what_they_say(spark, sf):
    path, rows, bench = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "decontaminate", "best_fit_packing"]
    run = dict(cp.STAGES)

    known = run["language_id"](spark, docs, path)
    assert known.columns == COLUMNS
    have, given = rows_of(known), {i: t for i, t, _ in rows}
    assert set(given) - set(have) == {500, 501, 502} and all(given[i] == t for i, t in have.items())

    kept = run["line_dedup"](spark, known, path)
    holders = {}
    for i, t in have.items():
        for x in t.split("\n"):
            holders.setdefault(lower(x.strip()), set()).add(i)
    want = {}
    for i, t in have.items():
        left = [x for x in t.split("\n") if len(k := lower(x.strip())) < 10 or i == min(holders[k])]
        if left:
            want[i] = "\n".join(left)
    assert kept.columns == COLUMNS and rows_of(kept) == want and 504 not in want and 503 not in want
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    single = run["minhash_dedup"](spark, kept, path)
    sets = {i: {tuple(w[k: k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, t in want.items() for w in [words(lower(t))]}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = components(list(sets), links)
    want = {i: t for i, t in want.items() if low[i] == i}
    assert single.columns == COLUMNS and rows_of(single) == want and {400} == {i for i in want if 400 <= i < 406}

    clean = run["decontaminate"](spark, single, path)
    wins = {tuple(w[k: k + 13]) for _, t in bench for w in [lower(t).split()] for k in range(len(w) - 12)}

    def hit(t):
        w, on = lower(t).split(), set()
        for k in range(len(w) - 12):
            if tuple(w[k: k + 13]) in wins:
                on |= set(range(k, k + 13))
        return len(on) > 0 and 20 * len(on) >= len(w)

    want = {i: t for i, t in want.items() if not hit(t)}
    assert clean.columns == COLUMNS and rows_of(clean) == want and 300 in want and not set(range(200, 205)) & set(want)

    packed = run["best_fit_packing"](spark, clean, path).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    length = {}
    for r in packed:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert length == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}

    whole = entry.queries()["pipeline"](spark, path).collect()
    place = lambda rs: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert place(whole) == place(packed)
    assert "pipeline" not in entry.oracle_sql()


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf[0])
        assert docs.columns == COLUMNS and docs.count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf[0]).count() == 0

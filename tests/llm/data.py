"""Small documents with every awkward case, and plain Python answers."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import DataFrame, SparkSession

# Names that the operators use inside, as columns of the input.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, own long, key string, copy boolean, _id int"


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgö") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = say(60), "A shared line of text " + say(5)
    out: list[str | None] = [None, "", " \n\t ", "one", "One", "x" * 300, "x" * 400, "ab " * 200, "\n" * 50, "ümläut " * 30]
    for k in range(60):
        t = say(r.randint(1, 120))
        if k % 4 == 0:
            t += " " + passage + " " + say(10)
        if k % 5 == 0:
            t += "\n  " + line.upper() + "\t\n" + say(5) + "\n" + line
        out.append(t)
    base = say(200)
    out += [base, base, base]
    for _ in range(12):  # near copies
        w = base.split()
        w[r.randrange(200)] = "changed"
        out.append(" ".join(w))
    out.append(say(6000) + " " + passage)  # very long
    rows = [(i, t) for i, t in enumerate(out)]
    r.shuffle(rows)
    rows = [(k * 3 + 1, t) for k, (_, t) in enumerate(rows)]
    rows += [rows[5], rows[20], rows[20]]  # repeated rows
    return rows


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    full = [(i, t, ("en" if i is None or i % 2 else None), "src", len(t or ""), "r", 7, "k", True, 1) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def sha(b: str | bytes) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def distinct(df: DataFrame) -> list[tuple]:
    return sorted({tuple(r) for r in df.collect()}, key=repr)


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    low = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
    return low

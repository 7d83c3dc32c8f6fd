"""Very long texts end within seconds and lose nothing."""

from __future__ import annotations

import random
import re
import time

import pytest

from tests.llm import data
from tidemark.llm import html, secrets
from tidemark.session import ship_package


def prose(n: int, seed: int = 1) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    out = []
    while n > 0:
        out.append(r.choice(words))
        n -= len(out[-1]) + 1
    return " ".join(out)


def test_secrets_in_a_long_text(spark):
    ship_package(spark)
    text = prose(2_500_000) + " 0123456789abcdef0123456789abcdef " + prose(2_500_000, 2)
    many = " ".join(f"token={k:08x}" for k in range(20_000))
    start = time.time()
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(data.frame(spark, [(1, text), (2, many)]), keep=["doc_id"])).collect()}
    assert time.time() - start < 120
    at = text.index("0123456789abcdef")
    assert (rows[1].n_hex, rows[1].n_assign) == (1, 0) and rows[1].base_sha256 == data.sha(f"hex:{at}:{at + 32}")
    spans = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=[0-9a-f]+", many))
    assert rows[2].n_assign == 20_000 and rows[2].base_sha256 == data.sha(spans)


@pytest.mark.parametrize("unit", ["<a ", "<script ", "<!", '<a "', "<a '", "<!--", "<p class=x <b>t", "<div \"' ", "</p ", '<a href="x', "<p>"])
def test_megabytes_of_open_markup(unit):
    page = "<p>The start of the text</p>" + unit * (5_000_000 // len(unit))
    start = time.time()
    got = html.main_text(page)
    assert time.time() - start < 60 and got.startswith("The start of the text")


def test_a_long_page_is_kept_whole():
    text = [prose(2_000, k) for k in range(1_500)]
    page = "<nav><a href=x>Home</a></nav><div>" + "".join(f"<p>{t}</p>" for t in text) + "</div><footer>Copyright</footer>"
    assert html.main_text(page) == " ".join(text)


def test_broken_tags_and_formulas_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi> be</math> one</p><p class=a <b>two</b></article>"
    assert html.main_text(page) == "Let x be one two"
    assert html.main_text("<p>a &lt; b <br> and 3 < 4 > 2</p><div data-x='<p>no'>yes</div>") == "a < b and 3 < 4 > 2 yes"

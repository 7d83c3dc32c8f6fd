"""Secret scan, language id, decontamination, packing and page text."""

import math
import random
import re
import zlib

import pytest

from tests.llm.data import SCHEMA, distinct, frame, lower, sha, texts, words
from tidemark.llm import decontam, html, langid, packing, secrets
from tidemark.llm.queries import tokenizer_path
from tidemark.session import ship_package

R = random.Random(9)
B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def drawn(n, alphabet=B64):
    return "".join(R.choice(alphabet) for _ in range(n))


PLAIN = ["aVeryLongIdentifierInCamelCase", "some-long-hyphenated-compound-word-here", "/usr/local/share/doc/packages/readme",
         "donaudampfschifffahrtsgesellschaft", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "_" * 25]
RANDOM = [drawn(32), drawn(40), drawn(44) + "==", drawn(48), drawn(64), drawn(36, B64[:62])]
TEXTS = [None, "", "nothing here", 'é password: "abc123" and TOKEN=token: xyz', "token:pass", "secret: api_key=zz9",
         "AKIA" + "Q" * 16 + " AKIA12 xAKIA" + "0" * 30, "f" * 23 + " " + "0a" * 12 + "g", "passwd = 'a.b/c+d=' " + "de" * 20,
         "api-key: no, apikey=yes_it_is"] + [f"é here {x} it is" for x in PLAIN + RANDOM]


def base(t):
    ci = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    key = "|".join(map(ci, ["password", "passwd", "secret", "token"])) + "|" + ci("api") + "_?" + ci("key")
    out = []
    for order, (kind, pattern, group, least) in enumerate([
            ("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return sorted(out)


@pytest.fixture(scope="module")
def scanned(spark):
    ship_package(spark)
    d = frame(spark, [(i, t) for i, t in enumerate(TEXTS)])
    return {r["doc_id"]: r for r in secrets.digest(secrets.scan(d)).collect()}, d


def test_base_spans(scanned):
    for i, t in enumerate(TEXTS):
        want, r = base(t or ""), scanned[0][i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)], t
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{e}" for a, _, e, k in want)), t
        assert {f"{k}:{a}:{e}" for a, _, e, k in want} <= set(r["spans"].split(",")) | {""}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def brute_battery(s):
    """(p-value of the battery, p-value of being text) written out again."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    name, alphabet = next((n, a) for n, p, a in secrets.ENCODINGS if re.search(p, s))
    if name in secrets.ONE_CASE:
        s = s.lower()
    n, k = len(s), len(alphabet)
    x = [alphabet.index(c) for c in s]
    squares = sum(s.count(c) ** 2 for c in set(s))
    kind = lambda c: "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o"
    changes = sum(kind(a) != kind(b) for a, b in zip(s, s[1:]))
    q = 1 - sum((sum(kind(a) == c for a in alphabet) / k) ** 2 for c in "dluo")
    z = lambda p: (changes - (n - 1) * p) / math.sqrt((n - 1) * p * (1 - p))
    chi, third = k / n * squares - n, 2 / (9 * (k - 1))
    z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - third)) / math.sqrt(third)
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    lag = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:]))
    z_serial = (lag / spread + 1 / n) * math.sqrt(n) if spread else math.sqrt(n)
    z_runs = z(q) if q > 1e-12 else 0
    f = -sum(math.log(max(p, 1e-300)) for p in (tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
    pair, triple = secrets.TEXT_PAIR, secrets.TEXT_TRIPLE
    m = n * (n - 1) / 2
    var = m * pair * (1 - pair) + n * (n - 1) * (n - 2) * (triple - pair**2)
    z_text = ((m * pair - (squares - n) / 2) / math.sqrt(var) + (z(secrets.TEXT_CHANGE) if q > 1e-12 else 0)) / math.sqrt(2)
    return math.exp(-f) * (1 + f + f * f / 2), tail(z_text)


def test_random_strings_are_added(scanned):
    got, d = scanned
    pattern = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
    found, by_stratum = {}, {}
    for i, t in enumerate(TEXTS):
        for m in re.finditer(pattern, t or ""):
            if any(a < m.end() and m.start() < e for a, _, e, _ in base(t)) or len(m[0].rstrip("=")) < 20:
                continue
            p_random, p_text = brute_battery(m[0])
            stratum = int(math.log2(len(m[0].rstrip("="))))
            step = min(400, math.floor(-10 * math.log10(max(p_text, 1e-45))))
            found[i, m.start(), m.end()] = (p_random, stratum, step)
            by_stratum.setdefault(stratum, []).append(step)
    want = set()
    for key, (p, stratum, step) in found.items():
        steps = by_stratum[stratum]
        least = [k for k in set(steps) if 10 ** (-k / 10) * len(steps) <= 0.01 * sum(x >= k for x in steps)]
        if least and step >= min(least) and p >= 0.001:
            want.add(key)
    have = {(i, int(s.split(":")[1]), int(s.split(":")[2])) for i, r in got.items() for s in r["spans"].split(",") if s.startswith("random")}
    assert have == want
    first = len(TEXTS) - len(RANDOM)
    assert {i for i, _, _ in have} >= set(range(first, len(TEXTS)))  # every random string
    assert not {i for i, _, _ in have} & set(range(10, first))       # and no written one
    assert d.count() == len(got)


def test_scan_has_no_python(scanned, spark):
    plan = secrets.scan(scanned[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron"), (2, "Short one"), (3, None), (4, "!!"),
         (10, "pi rho sigma tau upsilon phi chi psi omega one two three four"), (None, "without name here"), (2, "Short one")]


def test_decontamination(spark):
    ship_package(spark)
    rows = texts() + [(900, "so ALPHA, beta-gamma delta epsilon zeta eta theta iota kappa lamda mu nu! tail"), (901, "a short one is here " * 3),
                      (902, "pi rho sigma tau upsilon phi chi psi omega one two three"), (903, "x " * 600 + "short one"), (904, "short"),
                      (905, "short"), (906, "one"), (907, "beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi")]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = [(str(i), w[k: k + min(13, len(w))]) for i, t in ITEMS if i is not None for w in [split(t)] if w
            for k in range(len(w) - min(13, len(w)) + 1)]
    want = []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        w, hit, names = split(t), set(), set()
        for name, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k: k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    names.add(name)
        want.append((i, len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sum(r[5] for r in want) == 3
    assert distinct(decontam.digest(decontam.find_benchmark(docs, bench))) == sorted(want, key=repr)
    blocks = decontam.find_benchmark(docs, bench, block_bytes=40)
    assert distinct(decontam.digest(blocks)) == sorted(want, key=repr)
    none = decontam.find_benchmark(docs, bench.limit(0))
    assert none.filter("n_hit > 0").count() == 0
    assert decontam.find_benchmark(docs.limit(0), bench).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    ship_package(spark)
    t = Tokenizer.from_file(tokenizer_path())
    rows = texts() + [(None, "no id"), (800, "can't <|endoftext|> ABC, Ünïcode x! " * 40)]
    out = packing.pack(frame(spark, rows), tokenizer_path(), keep_ids=True).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    seen = {}
    for i, text in rows:
        seen.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    for i, want in seen.items():
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert len(pieces) == sum(-(-len(w) // 2048) for w in want)
        for r in pieces:
            w = want[0]
            assert r["ids"] == w[r["start"]: r["start"] + r["length"]] and r["start"] == 2048 * r["piece"]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in out)
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack(frame(spark, rows).limit(0), tokenizer_path()).count() == 0


def test_rule_places_where_squares_are_smallest():
    r = random.Random(4)
    lengths = [r.randint(1, 19) for _ in range(300)]
    sequence, offset, fill = packing.place_all(__import__("numpy").array(lengths), 20)
    gaps: dict[int, int] = {}
    for n, k, at in zip(lengths, sequence, offset):
        squares = lambda g: sum(v * v for gap, v in g.items() if gap > 0)
        options = {}
        for gap in [g for g, v in gaps.items() if v and g >= n] + [20]:
            new = dict(gaps)
            if gap < 20:
                new[gap] -= 1
            new[gap - n] = new.get(gap - n, 0) + 1
            options[gap] = squares(new)
        assert options[20 - at] == min(options.values())
        if at:
            gaps[20 - at] -= 1
        gaps[20 - at - n] = gaps.get(20 - at - n, 0) + 1
    assert fill.max() <= 20


def test_plan_in_waves_places_every_piece_once():
    import numpy as np

    counts = np.zeros(65, np.int64)
    r = np.random.default_rng(0)
    counts[1:64] = r.integers(0, 900, 63)
    waves = packing.plan(counts, 64, 500)
    assert waves[0]["times"] > 1
    fill, taken = {}, set()
    for n in range(1, 64):
        rank = np.arange(counts[n])
        s, o = packing.place(np.full(counts[n], n), rank, waves, 64)
        for a, b in zip(s.tolist(), o.tolist()):
            for p in range(b, b + n):
                assert (a, p) not in taken
                taken.add((a, p))
            fill[a] = fill.get(a, 0) + n
    assert max(fill.values()) <= 64
    # Repeating a small plan costs little beside the rule run over every piece.
    once = packing.plan(counts, 64, 10**6)
    assert len(fill) <= 1.02 * once[0]["sequences"]


SYLLABLES = {"aa": "ka lo mi tu ren", "bb": "sch eit ung der gen", "cc": "ción ado que los ente"}


def test_language_id(spark):
    ship_package(spark)
    r = random.Random(2)
    say = lambda lang, n: " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, say(lang := r.choice(list(SYLLABLES)), r.randint(3, 150)), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, say("aa", 2000), None), (None, say("bb", 40), "bb"), rows[7]]
    mixed = say("aa", 60) + " " + say("cc", 30)
    rows.append((1004, mixed, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = {(x["doc_id"]): x for x in langid.identify(docs).select("row.doc_id", "row.lang", "lang_pred", "score").collect()}
    held = [x for i, x in got.items() if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and sum(x["lang"] == x["lang_pred"] for x in held) >= 0.97 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and all(0 <= x["score"] <= 1 for x in got.values())
    usable = langid.held_out() == False  # noqa: E712
    model = langid.fit(langid.sample(docs, usable))
    runs = langid.predict(docs.filter("doc_id = 1004"), model, runs=True).first()["runs"]
    assert [x["lang"] for x in runs] == ["aa", "cc"] and abs(runs[0]["words"] - 60) <= 2
    none = docs.limit(0)
    assert langid.identify(none).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {x["lang_pred"] for x in langid.identify(unlabelled).collect()} == {"und"}


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    scores, change = r.random((7, 3)) + 0.1, r.random((3, 3)) + 0.1
    starts = np.array([0, 4, 4, 5, 7])
    got, _ = langid.posteriors(scores, starts, change)
    for a, e in zip(starts[:-1], starts[1:]):
        total = np.zeros((e - a, 3))
        for path in itertools.product(range(3), repeat=e - a):
            w = np.prod([scores[a + k, y] for k, y in enumerate(path)]) * np.prod([change[x, y] for x, y in zip(path, path[1:])])
            for k, y in enumerate(path):
                total[k, y] += w
        if e > a:
            assert np.allclose(got[a:e], total / total.sum(1, keepdims=True))


PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    ("<body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>Ti&amp;tle</h1><p>foo<b>bar</b>\n  baz.<p>As.<div class='ad'>buy</div><p>End&nbsp;x"
     "</article><footer>f</footer></body>", "Ti&tle foobar baz. As. End x"),
    ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><div id='cookie-notice'>We use"
     "</div><div class='content'><h1>Head</h1><p>Long text follows here and there.<p>As.</div><aside>more</aside><section class='comments'><p>nice"
     "</p></section><form><input><label>q</label></form></body></html>", "Head Long text follows here and there. As."),
    ("<main><p>kept &lt;p&gt; &#233;&#x41;</p><!-- <p>no</p> --><div class='sidebar'><div>a</div>b</div><p>too</p></main>", "kept <p> éA too"),
    ("<article><p>a<br>b</p><ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article><div class=comment>g</div>", "a b c d e f"),
    ("<p title='a > b'>only text that is long enough to stand</p>", "only text that is long enough to stand"),
]


def test_pages(spark):
    ship_package(spark)
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(3, "u3", PAGES[3][0], "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = {r["page_id"]: r for r in html.digest(html.extract(d)).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (want, len(want), f"u{i}")
    assert html.extract(d.limit(0)).count() == 0


def test_dropped_asides_cut_no_page_in_two():
    long = "Long text follows here and there. " * 9
    for aside in ("<div class='ad'>buy</div>", "<aside>share</aside>", "<nav>menu</nav>" * 4):
        page = f"<body><nav>n</nav><div><h1>Head</h1><p>Lead.</p>{aside}<p>{long}</p>{aside}<p>End.</p></div><footer>f</footer></body>"
        assert html.main_text(page) == f"Head Lead. {long}End."
        assert html.main_text(page.replace("Long text", "b")) == f"Head Lead. {long}End.".replace("Long text", "b")


def test_links_inside_the_text_stay():
    menu = "<div><a href=a>Menu</a> | <a href=b>More &amp; more</a></div>"
    for inner, want in [
        ("<p>By <a>\n Jane Doe\n </a> today</p>", "By Jane Doe today"),
        ("<p>A&nbsp;<a>&quot;&eacute;&eacute;&quot;</a></p>", 'A "éé"'),
        ("<h1><a href=x>Title</a></h1><p>Text.</p>", "Title Text."),
        ("<h1><a href=x>Title</a></h1><p><a>Jane Doe</a></p><p>Text.</p>", "Title Jane Doe Text."),
        ("<h2><a href=x>Title</a></h2><p>Text.</p>", "Title Text."),
        ("<p>Text.</p><ul><li><a>one</a><li><a>two</a> <a>three</a></ul><p>End.</p>", "Text. one two three End."),
        ("<p><a>only</a></p>", ""),
    ]:
        assert html.main_text(f"<body>{menu}<div>{inner}</div>{menu}</body>") == want


def test_names_put_aside_what_they_mean():
    long = ("Long text follows here and there. " * 30).strip()
    for name in ("content has-sidebar", "layout-no-sidebar", "with-comments", "post-header", "entry-header", "sidebar-right", "wrapper widget"):
        assert html.main_text(f"<body><div class='{name}'><h1>Head</h1><p>{long}</p><div class=ad>buy</div></div></body>") == f"Head {long}"
        assert html.main_text(f"<body><article><div class='{name}'><h1>Head</h1><p>{long}</p></div></article></body>") == f"Head {long}"
    for name in ("post-header", "entry-header"):
        assert html.main_text(f"<article><div class='{name}'><h1>Head</h1></div><p>{long}</p></article>") == f"Head {long}"
    for name in ("sidebar", "ad-slot", "main-nav", "cookie-notice", "comments-area", "site_footer", "ad2"):
        assert html.main_text(f"<div><p>{long}</p><div class='{name}'>{long[:300]}</div></div>") == long
    assert html.main_text(f"<div><p>Short.</p></div><div class=comments>{long * 9}</div>") == "Short."


def test_teaser_articles_hide_no_longer_text():
    long = ("Long text follows here and there. " * 9).strip()
    page = f"<div><h1>Head</h1><p>{long}</p></div><div><article><h3><a href=x>Other</a></h3></article><article><p>A card.</p></article></div>"
    assert html.main_text(page) == f"Head {long} Other A card."
    assert html.main_text(f"<div>By the way</div><article><p>{long}</p></article>") == long


def test_menus_between_stretches_go_and_lists_of_the_text_stay():
    long = ("Long text follows here and there. " * 30).strip()
    menu = lambda n: "<ul>" + "".join(f"<li><a href={k}>Item {k}</a>" for k in range(n)) + "</ul>"
    items = lambda n: " ".join(f"Item {k}" for k in range(n))
    few, many = html.WINDOW - 1, html.WINDOW
    for n, shown in ((few, f" {items(few)} "), (many, " ")):
        page = f"<body>{menu(9)}<div>Welcome to us</div>{menu(n)}<div><p>{long}</p></div>{menu(n)}<div>All rights kept</div>{menu(9)}</body>"
        assert html.main_text(page) == f"Welcome to us{shown}{long}{shown}All rights kept"
        # Not where much text goes on, and not in an article.
        assert html.main_text(f"<div><p>{long}</p>{menu(n)}<p>{long[:400]}</p></div>") == f"{long} {items(n)} {long[:400].strip()}"
        assert html.main_text(f"<article><p>Lead.</p>{menu(n)}<p>{long}</p></article>") == f"Lead. {items(n)} {long}"
    assert html.joined([5, 0, 0, 0, 9, 0, 0, 0, 1, 0, 0, 0, 8, 0]) == [(0, 13)] and html.joined([0, 0]) == []
    assert html.joined([1, 0, 0, 0, 9, 0, 0, 0, 1, 0, 0, 0, 8, 0, 0, 0, 2]) == [(0, 1), (4, 13), (16, 17)]


def test_line_weights_surge_and_dive():
    assert html.stretches([0, 0, 5, 0, 7, 0, 0, 0, 3, 0]) == [(2, 5), (8, 9)]
    assert html.stretches([]) == [] and html.stretches([0, 0]) == []
    assert words("a b") == ["a", "b"]

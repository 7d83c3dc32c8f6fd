"""Secret scan: fixed patterns, and strings that look drawn at random.

Everything is a DataFrame expression. The patterns give the base spans. Other
tokens of `min_length` or more secret-like characters are candidates, each with
the smallest alphabet that spells it (digits, hex, base 32, letters, base 36,
62 or 64), and go through a battery of tests:

* chi-squared: are the symbols of the alphabet equally frequent;
* runs: do character classes change as often as for random symbols;
* serial correlation: does a symbol tell about the next.

Fisher's sum of the three must not speak against randomness. The first two are
also held against running text, in which few symbols repeat and classes rarely
change; this gives each candidate a p-value of being text. Short tokens have
little power and are many, so the false-discovery rate is controlled by
Benjamini and Hochberg's rule within each length class (powers of two), over
the candidates of the whole corpus. The counts behind it are a histogram of
bounded size. What was found is written once and the thresholds are applied to
it, so no text and no candidate is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.tables import packed_row, written

# Kinds in the order of equal starts: pattern, and the group and least length that a match must have.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
# Matches whose places are worked out together.
MATCH_BLOCK = 256
FOUND = "random"
SYMBOLS = "[A-Za-z0-9+/_=-]"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings from the narrowest: name, test, alphabet. - and _ are read as + and /.
ENCODINGS = [("digits", "^[0-9]+$", DIGITS), ("hex", "^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"), ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
             ("letters", "^([a-z]+|[A-Z]+)$", LOWER), ("base36", "^([0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
             ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER), ("base64", "", UPPER + LOWER + DIGITS + "+/")]
ONE_CASE = ("hex", "letters", "base36")
MIN_LENGTH = 20
# Running text: chance that two symbols are equal, that three are, and that the class changes.
TEXT_PAIR, TEXT_TRIPLE, TEXT_CHANGE = 0.065, 0.0055, 0.12
RANDOM_LEVEL, DISCOVERY_RATE = 0.001, 0.01
# p-values are kept in steps of a tenth of a power of ten.
STEPS, MOST = 10, 400


def _matches(text: Column, pattern: str, group: int) -> Column:
    """start, end and checked group of every match, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("m"), checked.alias("g"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["m"])
        one = F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["g"].alias("s")))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], one).alias("out"))

    # The last gap follows the last match and has none. Appending copies what is
    # there, so matches are gathered in blocks and only blocks are appended.
    count, empty = F.size(gaps) - 1, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def block(acc: Column, b: Column) -> Column:
        first = F.struct(acc["at"].alias("at"), none.alias("out"))
        some = F.aggregate(F.slice(zipped, b * MATCH_BLOCK + 1, F.least(F.lit(MATCH_BLOCK), count - b * MATCH_BLOCK)), first, step)
        return F.struct(some["at"].alias("at"), F.concat(acc["out"], some["out"]).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.greatest(count, F.lit(1)) - 1) / MATCH_BLOCK).cast("int"))
    return F.when(count > 0, F.aggregate(blocks, empty, block, lambda a: a["out"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """kind, order, start, end of every base span."""
    out = []
    none = F.array().cast("array<struct<kind:string,order:int,start:bigint,end:bigint>>")
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        spans = F.transform(F.filter(_matches(text, pattern, group), lambda m: F.char_length(m["s"]) >= least), lambda m: F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("order"), m["start"].alias("start"), m["end"].alias("end")))
        out.append(F.when(_hint(text, kind), spans).otherwise(none))
    return F.concat(*out)


def _hint(text: Column, kind: str) -> Column:
    """A quick test that a text may have a match: most texts fail at the first
    character class. A text starts as if after a blank."""
    padded = F.concat(F.lit(" "), text)
    if kind == "assign":
        return text.rlike(r"""[dtnyDTNY]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""")
    long_token = padded.rlike(f"{SYMBOLS.replace('[', '[^', 1)}{SYMBOLS}{{20}}")
    if kind == "access":
        return long_token & text.contains("AKIA")
    return long_token & padded.rlike("[^0-9a-f][0-9a-f]{24}") if kind == "hex" else long_token


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    terms = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for c in reversed(terms):
        poly = (poly + c) * t
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, 1 - tail).otherwise(tail)


def _per_encoding(x: Column, value) -> Column:
    out = None
    for name, _, alphabet in ENCODINGS:
        v = value(name, alphabet)
        out = F.when(x["enc"] == name, v) if out is None else out.when(x["enc"] == name, v)
    return out


def _classes(alphabet: str) -> list[int]:
    """How many symbols of each class: digits, small and capital letters, others."""
    kinds = [sum(c in k for c in alphabet) for k in (DIGITS, LOWER, UPPER)]
    return [n for n in (*kinds, len(alphabet) - sum(kinds)) if n]


def _with(items: Column, **fields) -> Column:
    """Add fields to every struct of an array, from the fields it has."""
    def add(name: str, value):
        return lambda x: x.withField(name, value(x))

    for name, value in fields.items():
        items = F.transform(items, add(name, value))
    return items


def candidates(text: Column, base: Column, min_length: int = MIN_LENGTH) -> Column:
    """Candidate tokens with their tests: start, end, length, random (p-value
    of the battery) and step (of the p-value of being text)."""
    pattern = f"(?<!{SYMBOLS}){SYMBOLS}{{{min_length},}}"
    found = F.filter(_matches(text, pattern, 0), lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    found = _with(found, s=lambda x: F.translate(F.regexp_replace(x["s"], "=+$", ""), "-_", "+/"))
    found = F.filter(found, lambda x: F.char_length(x["s"]) >= min_length)

    def encoding(x: Column) -> Column:
        out = None
        for name, test, _ in ENCODINGS[:-1]:
            hit = x["s"].rlike(test)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise(ENCODINGS[-1][0])

    def symbols(x: Column) -> Column:
        s = F.when(x["enc"].isin(*ONE_CASE), F.lower(x["s"])).otherwise(x["s"])
        return F.filter(F.split(s, ""), lambda c: c != "")

    def index(x: Column) -> Column:
        return _per_encoding(x, lambda name, alphabet: F.transform(x["symbols"], lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double")))

    kind_of = lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3)
    found = _with(
        found, enc=encoding, symbols=symbols, n=lambda x: F.size(x["symbols"]).cast("double"), index=index,
        k=lambda x: _per_encoding(x, lambda name, alphabet: F.lit(float(len(alphabet)))),
        # Equal pairs of places, from how often each symbol occurs.
        squares=lambda x: F.aggregate(F.transform(F.array_distinct(x["symbols"]), lambda c: F.size(F.filter(x["symbols"], lambda d: d == c))),
                                      F.lit(0.0), lambda a, n: a + n.cast("double") * n),
        changes=lambda x: F.aggregate(F.zip_with(F.transform(x["symbols"], kind_of), F.transform(F.slice(x["symbols"], 2, F.size(x["symbols"])), kind_of),
                                                 lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v),
        mean=lambda x: F.aggregate(x["index"], F.lit(0.0), lambda a, v: a + v) / x["n"])
    found = _with(
        found, spread=lambda x: F.aggregate(x["index"], F.lit(0.0), lambda a, v: a + (v - x["mean"]) * (v - x["mean"])),
        lagged=lambda x: F.aggregate(F.zip_with(F.slice(x["index"], 1, F.size(x["index"]) - 1), F.slice(x["index"], 2, F.size(x["index"])),
                                                lambda a, b: (a - x["mean"]) * (b - x["mean"])), F.lit(0.0), lambda a, v: a + v))

    def even(x: Column) -> Column:  # chance that the class changes between random symbols
        return _per_encoding(x, lambda name, alphabet: F.lit(1 - sum((n / len(alphabet)) ** 2 for n in _classes(alphabet))))

    chi = lambda x: x["k"] / x["n"] * x["squares"] - x["n"]
    third = lambda x: 2 / (9 * (x["k"] - 1))  # Wilson and Hilferty
    pairs = lambda x: x["n"] * (x["n"] - 1) / 2

    def runs(x: Column, change: Column) -> Column:
        z = (x["changes"] - (x["n"] - 1) * change) / F.sqrt((x["n"] - 1) * change * (1 - change))
        return F.when(x["q"] > 0, z).otherwise(0.0)

    def fewer_pairs(x: Column) -> Column:
        var = pairs(x) * TEXT_PAIR * (1 - TEXT_PAIR) + x["n"] * (x["n"] - 1) * (x["n"] - 2) * (TEXT_TRIPLE - TEXT_PAIR**2)
        return (pairs(x) * TEXT_PAIR - (x["squares"] - x["n"]) / 2) / F.sqrt(var)

    found = _with(
        found, q=even,
        z_chi=lambda x: (F.pow(chi(x) / (x["k"] - 1), F.lit(1 / 3)) - (1 - third(x))) / F.sqrt(third(x)),
        z_runs=lambda x: F.when(x["q"] > 0, runs(x, F.greatest(x["q"], F.lit(1e-9)))).otherwise(0.0),
        z_serial=lambda x: F.when(x["spread"] > 0, (x["lagged"] / x["spread"] + 1 / x["n"]) * F.sqrt(x["n"])).otherwise(F.sqrt(x["n"])),
        z_text=lambda x: (fewer_pairs(x) + runs(x, F.lit(TEXT_CHANGE))) / math.sqrt(2))
    two = lambda z: 2 * upper_tail(F.abs(z))
    found = _with(found, fisher=lambda x: -sum(F.log(F.greatest(p, F.lit(1e-300))) for p in
                                               (upper_tail(x["z_chi"]), two(x["z_runs"]), two(x["z_serial"]))))
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.floor(F.log2(x["n"])).cast("int").alias("stratum"),
        # Tail of chi-squared with six degrees of freedom.
        (F.exp(-x["fisher"]) * (1 + x["fisher"] + x["fisher"] * x["fisher"] / 2)).alias("random"),
        F.least(F.floor(-STEPS * F.log10(F.greatest(upper_tail(x["z_text"]), F.lit(1e-45)))), F.lit(MOST)).cast("int").alias("step")))


def discoveries(histogram: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """Benjamini and Hochberg within each stratum: the least step that counts,
    from (stratum, step, candidates). A step stands for its largest p-value."""
    out = {}
    for stratum in {s for s, _, _ in histogram}:
        steps = sorted(((k, n) for s, k, n in histogram if s == stratum), reverse=True)
        total, seen = sum(n for _, n in steps), 0
        for k, n in steps:
            seen += n
            if 10 ** (-k / STEPS) * total <= rate * seen:
                out[stratum] = k
    return out


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH,
         random_level: float = RANDOM_LEVEL, rate: float = DISCOVERY_RATE) -> DataFrame:
    """`row` (the columns given, or those in `keep`), `base` and `spans`:
    arrays of kind, order, start, end (code points, end exclusive) by start.

    `spans` are the base spans and the random-looking tokens that overlap none
    of them. A NULL text is empty. Repeated rows get equal results, and each
    counts in the statistics; an empty table gives no rows.
    """
    d = docs.select(packed_row(docs.select(*keep) if keep else docs), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("base", base_spans(F.col("text")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,stratum:int,random:double,step:int>>")
    hint = F.col("text").rlike(f"{SYMBOLS}{{{min_length}}}") if min_length < 20 else _hint(F.col("text"), FOUND)
    d = d.withColumn("found", F.when(hint, candidates(F.col("text"), F.col("base"), min_length)).otherwise(none))
    d = written(d.select("row", "base", "found"), "secrets")
    counts = d.select(F.explode("found").alias("c")).groupBy("c.stratum", "c.step").count()
    least = discoveries([tuple(r) for r in counts.collect()], rate)  # at most 400 steps for each power of two
    if least:
        at = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
        good = F.filter("found", lambda c: (c["random"] >= random_level) & (c["step"] >= F.coalesce(at[c["stratum"]], F.lit(MOST + 1))))
    else:
        good = F.filter("found", lambda c: F.lit(False))
    more = F.transform(good, lambda c: F.struct(F.lit(FOUND).alias("kind"), F.lit(len(KINDS)).alias("order"), c["start"].alias("start"), c["end"].alias("end")))
    return d.select("row", _by_start(F.col("base")).alias("base"), _by_start(F.concat("base", more)).alias("spans"))


def _by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(result: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return result.select("row.doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                         joined(F.col("spans")).alias("spans"))

"""Language of words and documents by a linear-chain conditional random field.

Words of a text form a chain; affixes, character n-grams and a lexicon score a
word for each language, learned transitions score a change of language from
word to word, and forward-backward gives every word its posterior. The model
is fitted on a bounded sample of labelled rows: at most `fit_docs` documents a
language and `fit_words` consecutive words of each, spliced into chains of
several documents, so that the chain learns how words of one language stay
together and may change. Prediction is one pass over the documents without a
shuffle: a distinct word is scored once per worker and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import text as tx
from tidemark.llm.tables import map_texts, packed_row

BUCKETS = 1 << 16
UNKNOWN = "und"
# Words times labels whose posteriors a task holds at a time.
GROUP_CELLS = 1_000_000
MARKS = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def core(word: bytes) -> bytes:
    """The word from its first letter to its last, in lower case."""
    w = word.decode()
    return (w if w.isalpha() else MARKS.sub("", w)).lower().encode()


def features(words: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and where those of each word start.

    Features are the n-grams of one to four bytes of the word between two
    marks, so that those with a mark are its prefixes and suffixes, and the
    word itself if the lexicon lists it.
    """
    joined = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # bytes to the end of the word
    code, flat, owner = np.zeros(len(joined), np.uint64), [], []
    padded = np.concatenate([joined, np.zeros(4, np.uint8)]).astype(np.uint64)
    for n in range(1, 5):
        code = code << np.uint64(8) | padded[n - 1: n - 1 + len(joined)]
        ok = left >= n
        h = (code[ok] + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        flat.append((h >> np.uint64(48)).astype(np.int64))
        owner.append(word[ok])
    listed = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    flat.append(BUCKETS + listed[listed >= 0])
    owner.append(np.flatnonzero(listed >= 0))
    flat, owner = np.concatenate(flat), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(words)))


def posteriors(scores: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label at each place of many chains, and the forward
    distributions it came from.

    `scores` are the exponentials of the word scores, chains joined; `transition`
    those of the transition weights. All chains advance together, longest first.
    """
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    begin, size = starts[:-1][order], size[order]
    steps = int(size.max(initial=0))
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # chains longer than t
    forward, out = np.empty_like(scores), np.empty_like(scores)
    a = None
    for t in range(steps):
        k = alive[t]
        at = begin[:k] + t
        a = scores[at] if a is None else (a[:k] @ transition) * scores[at]
        a = a / a.sum(1, keepdims=True)
        forward[at] = a
    b = np.ones((len(size), scores.shape[1]))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        p = forward[at] * b[:k]
        out[at] = p / p.sum(1, keepdims=True)
        if t:
            nxt = (scores[at] * b[:k]) @ transition.T
            b[:k] = nxt / nxt.sum(1, keepdims=True)
    return out, forward


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray        # bucket and listed word x label
    transition: np.ndarray     # label x label
    lexicon: dict[bytes, int]  # listed words

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Exponentials of the scores of words, the best label at 1."""
        if not words:
            return np.zeros((0, len(self.labels)))
        flat, starts = features(words, self.lexicon)
        s = np.add.reduceat(self.weights[flat], starts)
        return np.exp(s - s.max(1, keepdims=True))


def fit(rows: list[tuple[str, list[str]]], rounds: int = 30, rate: float = 0.2, penalty: float = 1e-3,
        splice: int = 12, chain: int = 48, least: int = 3) -> Model:
    """Maximum likelihood by Adam over (label, words) rows."""
    labels = sorted({label for label, _ in rows})
    words = [(labels.index(label), [c for c in (core(w.encode()) for w in ws) if c]) for label, ws in rows]
    counts: dict[bytes, int] = {}
    for _, ws in words:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w: i for i, w in enumerate(w for w, n in counts.items() if n >= least)}
    number = {w: i for i, w in enumerate(counts)}
    # Runs of words of one document, shuffled and joined into chains.
    runs = [(y, [number[w] for w in ws[i: i + splice]]) for y, ws in words for i in range(0, len(ws), splice)]
    x, y = [], []
    for i in np.random.default_rng(7).permutation(len(runs)):
        x += runs[i][1]
        y += [runs[i][0]] * len(runs[i][1])
    x, y, n = np.array(x, np.int64), np.array(y, np.int64), len(labels)
    weights, transition = np.zeros((BUCKETS + len(lexicon), n)), np.zeros((n, n))
    if n < 2 or not len(x):
        return Model(labels, weights.astype(np.float32), transition, lexicon)
    starts = np.append(np.arange(0, len(x), chain), len(x)).astype(np.int64)
    flat, first = features(list(counts), lexicon)
    used, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(counts)), np.diff(np.append(first, len(flat))))
    inner = np.ones(len(x), bool)
    inner[starts[:-1]] = False
    links = np.flatnonzero(inner)
    seen = np.bincount(y[links - 1] * n + y[links], minlength=n * n).reshape(n, n)
    w = np.zeros((len(used), n))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, transition)]
    for r in range(1, rounds + 1):
        s = np.add.reduceat(w[flat], first)
        change = np.exp(transition)
        p, forward = posteriors(np.exp(s - s.max(1, keepdims=True))[x], starts, change)
        g = p.copy()
        g[np.arange(len(x)), y] -= 1
        by_word = [np.bincount(x, g[:, k], len(counts)) for k in range(n)]
        gw = np.column_stack([np.bincount(flat, b[owner], len(used)) for b in by_word]) / len(x) + penalty * w / len(used)
        # Posterior of a pair: forward, transition, and what the second place adds to the forward pass.
        before = forward[links - 1]
        pair = change * (before.T @ (p[links] / (before @ change)))
        for param, grad, (m, v) in zip((w, transition), (gw, (pair - seen) / len(x)), state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    weights[used] = w
    return Model(labels, weights.astype(np.float32), transition, lexicon)


def sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           fit_docs: int = 400, fit_words: int = 120) -> list[tuple[str, list[str]]]:
    """About `fit_docs` labelled documents of each language, evenly over all
    rows, and `fit_words` consecutive words from a place anywhere in each."""
    d = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit("fit"), F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    share = {r["lang"]: fit_docs / r["count"] for r in d.groupBy("lang").count().collect()}
    if not share:
        return []
    of = F.create_map(*[F.lit(v) for pair in share.items() for v in pair])
    even = (F.pmod("h", F.lit(1 << 30)) / (1 << 30)).alias("even")
    ws = F.split(F.trim(F.col("text")), r"\s+")
    take = F.slice("ws", (F.pmod(F.xxhash64("text"), F.greatest(F.size("ws") - fit_words, F.lit(0)) + 1) + 1).cast("int"), fit_words)
    rows = (d.select("lang", "h", "text", even).filter(F.col("even") < F.element_at(of, F.col("lang")))
            .select("lang", "h", "text", ws.alias("ws")).select("lang", "h", take.alias("ws"))
            .orderBy("h").limit(2 * fit_docs * len(share)).collect())
    return sorted((r["lang"], list(r["ws"])) for r in rows)


class Scores:
    """Word scores that a worker remembers for one model."""

    def __init__(self, model: Model):
        self.model, self.known = model, tx.Remembered(self._rows)

    def _rows(self, words: list[bytes]) -> list[bytes]:
        cores = [core(w) for w in words]
        scores = self.model.word_scores(cores).astype(np.float64)
        scores[[not c for c in cores]] = -1  # no letters
        return [row.tobytes() for row in scores]

    def of(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words, and whether each has a letter."""
        s = np.frombuffer(b"".join(self.known.of(vocabulary))).reshape(-1, len(self.model.labels))
        return s, s[:, 0] >= 0


_SCORES: dict[str, Scores] = {}


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            runs: bool = False) -> DataFrame:
    """`row` (the columns given, or those in `keep`), `lang_pred`, `score`, and
    with `runs` the languages along the text (label, first word, words).

    The document's language has the largest mean posterior over the words with
    letters; that mean is the score. A text that is NULL or has no letter, and
    any text when nothing was learned, is `und` with score 0. Predictions use
    the text only; repeated rows get equal results, no rows give none.
    """
    d = docs.select(packed_row(docs.select(*keep) if keep else docs), F.col(text_col).alias("text"))
    kind = T.StructType([d.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if runs:
        run_type = T.StructType().add("lang", "string").add("first", "integer").add("words", "integer")
        kind = kind.add("runs", T.ArrayType(run_type))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = xxhash.xxh64_hexdigest(model.weights.tobytes() + repr(model.labels).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORES:
            _SCORES.clear()
            _SCORES[key] = Scores(shared.value)
        scores, labels = _SCORES[key], shared.value.labels
        change = np.exp(shared.value.transition)
        for s in tx.slices(batches, "text", 2 * tx.SLICE_BYTES):
            codes, starts, vocabulary = tx.words(tx.strings(s.column("text")))
            table, letters = scores.of(vocabulary) if labels else (np.zeros((len(vocabulary), 1)), np.zeros(len(vocabulary), bool))
            use = letters[codes]
            begin = np.concatenate([[0], np.cumsum(use)])[starts]
            size, best, score, along = np.diff(begin), [], [], []
            for i, j in _groups(size, max(1, GROUP_CELLS // table.shape[1])):
                part = slice(starts[i], starts[j])
                p, _ = posteriors(table[codes[part][use[part]]], begin[i: j + 1] - begin[i], change)
                full, n = size[i:j] > 0, np.maximum(size[i:j], 1)[:, None]
                mean = np.zeros((j - i, p.shape[1]))
                if full.any():
                    mean[full] = np.add.reduceat(p, (begin[i:j] - begin[i])[full])
                mean /= n
                best.append(mean.argmax(1))
                score.append(np.clip(mean.max(1), 0, 1))
                if runs:
                    along.append(_runs(p.argmax(1), use[part], starts[i: j + 1] - starts[i], begin[i: j + 1] - begin[i], labels))
            best, score = np.concatenate(best), np.concatenate(score)
            columns = [s.column("row"), pa.array([labels[k] if n else UNKNOWN for k, n in zip(best, size)], pa.string()),
                       pa.array(np.where(size > 0, score, 0.0))]
            if runs:
                columns.append(pa.concat_arrays(along))
            yield pa.RecordBatch.from_arrays(columns, kind.fieldNames())

    return map_texts(d, run, kind)


def _groups(size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring documents of at most `limit` words together, one document at least."""
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
        yield i, j
        i = j


def _runs(label: np.ndarray, use: np.ndarray, starts: np.ndarray, begin: np.ndarray, labels: list[str]) -> pa.Array:
    place = np.flatnonzero(use)
    out = []
    for i in range(len(starts) - 1):
        y = label[begin[i]: begin[i + 1]]
        at = np.flatnonzero(np.diff(np.concatenate([[-1], y]))) if len(y) else np.zeros(0, int)
        word = place[begin[i]: begin[i + 1]] - starts[i]
        last = np.append(at[1:], len(y)) - 1
        out.append([{"lang": labels[y[a]], "first": int(word[a]), "words": int(word[z] - word[a] + 1)} for a, z in zip(at, last)])
    return pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))


def held_out(id_col: str = "doc_id", parts: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             keep: list[str] | None = None, **sizes) -> DataFrame:
    """Learn from the labelled documents that are not held out, then `predict` all.
    A document without an id is not learned from."""
    usable = ~held_out(id_col) & F.col(id_col).isNotNull()
    return predict(docs, fit(sample(docs, usable, id_col, text_col, lang_col, **sizes)), text_col, keep)

"""A quality classifier: an additive model with pairwise interactions, boosted feature by feature.

Every feature is cut into bins once.  Boosting goes round the features: each gets a tree of two levels on its own bins,
whose leaves are added to that feature's table of log odds; so a round is many small steps, and no feature speaks for
another.  Then the pairs whose best four quadrants explain most of what is left get a table each, grown the same way by
trees that split one feature and then the other.  A document's log odds are sums of looked-up entries.

The model is fitted on the driver from feature rows of a bounded sample: at most ``SAMPLE`` labelled rows, those whose
ids hash lowest.  Everything else (features and scores of all texts) runs in tasks, on whole texts, slice by slice.

A null or empty text has features of its own (all zero) and a score like any other.  Very long texts are read in slices
of ``SLICE`` characters cut at white space; what is kept of them is counts, and a count per distinct word.  Repeated rows
are scored one by one.  Labels that are null, that name no document or that another row repeats are left out, left out
and used, in that order.  Without a single labelled row the score is 0.5, with one class only the smoothed share of
label 1.  No documents give no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
SLICE = 1 << 20
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.1
PENALTY = 1.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:?'\"()-",
    "loud": b"!",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "beyond_ascii": bytes(range(0xC0, 0x100)),
}
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_BYTE[list(_bytes), _i] = 1

FEATURES = [
    "log_chars", "log_words", "chars_a_word", "new_words", "top_word", "repeated_next", "short_words", "long_words",
    "capital_words", "shouted_words", "words_with_symbols", "bare_symbols", "log_lines", "repeated_lines", "words_a_line",
    "ended_lines", "byte_entropy", *(f"{name}_share" for name in _CLASSES),
]
_SYMBOLS = frozenset(map(chr, _CLASSES["symbol"]))


def _slices(text: str, size: int) -> Iterator[str]:
    """Pieces of about ``size`` characters that end at white space, so that no word is torn (but one of such length)."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end > at and not text[end].isspace():
            end -= 1
        end = end if end > at else at + size
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def features(text: str | None, size: int = SLICE) -> list[float]:
    """The features of one text, in the order of ``FEATURES``."""
    text = text or ""
    words, lines, seen = Counter(), Counter(), np.zeros(256, np.int64)
    n = again = short = long_ = capital = shouted = marked = bare = letters = 0
    before = None
    for piece in _slices(text, size):
        # crumbs of surrogates cannot come out of Arrow; "replace" only guards callers with other strings
        seen += np.bincount(np.frombuffer(piece.encode("utf-8", "replace"), np.uint8), minlength=256)
        found = piece.split()
        if not found:
            continue
        n += len(found)
        again += sum(map(eq, found, found[1:])) + (found[0] == before)
        before = found[-1]
        words.update(found)
    for word, times in words.items():
        size_ = len(word)
        letters += size_ * times
        short += times * (size_ <= 3)
        long_ += times * (size_ >= 12)
        capital += times * word[0].isupper()
        shouted += times * (size_ > 1 and word.isupper())
        marks = sum(c in _SYMBOLS for c in word) if not word.isalnum() else 0
        marked += times * (0 < marks < size_)
        bare += times * (marks == size_)
    rows = [line for line in text.split("\n") if line and not line.isspace()]
    lines.update(rows)
    total = int(seen.sum())
    shares = seen[seen > 0] / max(total, 1)
    words_, lines_ = max(n, 1), max(len(rows), 1)
    return [
        np.log1p(len(text)), np.log1p(n), letters / words_, len(words) / words_,
        max(words.values(), default=0) / words_, again / words_, short / words_, long_ / words_, capital / words_,
        shouted / words_, marked / words_, bare / words_, np.log1p(len(rows)), (len(rows) - len(lines)) / lines_,
        n / lines_, sum(line.rstrip()[-1] in ".!?:\"'" for line in rows) / lines_, float(-(shares * np.log2(shares)).sum()),
        *(seen @ _OF_BYTE / max(total, 1)),
    ]


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """edges: per feature.  shapes: per feature, the log odds of its bins.  pairs: (f, g) and a table over both bins."""

    start: float
    edges: list[np.ndarray]
    shapes: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, rows: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, rows[:, f], "right") for f, e in enumerate(self.edges)]
        return np.stack(columns, axis=1) if columns else np.zeros((len(rows), 0), np.int64)

    def log_odds(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for f, shape in enumerate(self.shapes):
            out += shape[bins[:, f]]
        for f, g, shape in self.pairs:
            out += shape[bins[:, f], bins[:, g]]
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.bins(rows)), -500, 500)))


def _cut(slope: np.ndarray, bend: np.ndarray) -> tuple[float, int]:
    """The gain of the best cut of a histogram, and its place: bins before it go left.  0 is no cut."""
    if len(slope) < 2:
        return 0.0, 0
    left, weight = np.cumsum(slope)[:-1], np.cumsum(bend)[:-1]
    right, rest = slope.sum() - left, bend.sum() - weight
    gain = left**2 / (weight + PENALTY) + right**2 / (rest + PENALTY) - slope.sum() ** 2 / (bend.sum() + PENALTY)
    best = int(gain.argmax())
    return (float(gain[best]), best + 1) if gain[best] > 1e-9 else (0.0, 0)


def _step(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """What a tree of two levels over one feature's bins adds to its table."""
    out = np.zeros(len(slope))
    _, middle = _cut(slope, bend)
    for a, b in ((0, middle), (middle, len(slope))):
        _, at = _cut(slope[a:b], bend[a:b])
        for lo, hi in ((a, a + at), (a + at, b)):
            if hi > lo:
                out[lo:hi] = slope[lo:hi].sum() / (bend[lo:hi].sum() + PENALTY)
    return out


def _quadrants(slope: np.ndarray, bend: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the step of the best tree that cuts rows once and then each side's columns."""
    best, step = 0.0, np.zeros(slope.shape)
    for middle in range(1, len(slope)):
        gain, cells = 0.0, []
        for rows in (slice(0, middle), slice(middle, None)):
            s, w = slope[rows].sum(axis=0), bend[rows].sum(axis=0)
            _, at = _cut(s, w)
            for columns in (slice(0, at), slice(at, None)):
                up, down = s[columns].sum(), w[columns].sum() + PENALTY
                gain += up**2 / down
                cells.append((rows, columns, up / down))
        if gain > best + 1e-9:
            best, step = gain, np.zeros(slope.shape)
            for rows, columns, value in cells:
                step[rows, columns] = value
    return best, step


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """Fit on a bounded sample held in memory; labels are 0 and 1."""
    n, width = rows.shape
    if not n:
        return Gam(0.0, [], [])
    share = (labels.sum() + 0.5) / (n + 1)
    model = Gam(float(np.log(share / (1 - share))), [], [])
    if labels.min() == labels.max():
        return model
    for f in range(width):
        model.edges.append(np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])))
        model.shapes.append(np.zeros(len(model.edges[f]) + 1))
    bins, labels = model.bins(rows), labels.astype(np.float64)
    odds = model.log_odds(bins)

    def errors():
        guess = 1 / (1 + np.exp(-odds))
        return labels - guess, guess * (1 - guess)

    for _ in range(rounds):
        for f, shape in enumerate(model.shapes):
            step = RATE * _step(*(np.bincount(bins[:, f], w, len(shape)) for w in errors()))
            shape += step
            odds += step[bins[:, f]]

    def histogram(f: int, g: int) -> list[np.ndarray]:
        size = len(model.shapes[f]), len(model.shapes[g])
        cell = bins[:, f] * size[1] + bins[:, g]
        return [np.bincount(cell, w, size[0] * size[1]).reshape(size) for w in errors()]

    gains = sorted(((-_quadrants(*histogram(f, g))[0], f, g) for f, g in combinations(range(width), 2)))
    model.pairs = [(f, g, np.zeros((len(model.shapes[f]), len(model.shapes[g])))) for gain, f, g in gains[:pairs] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for f, g, shape in model.pairs:
            step = RATE * _quadrants(*histogram(f, g))[1]
            shape += step
            odds += step[bins[:, f], bins[:, g]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from.  A null id counts as an empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fit on the ``sample`` labelled rows (doc_id, quality) whose ids hash lowest, held-out ones left out."""
    given = labels.select("doc_id", F.col("quality").cast("int").alias("_label"))
    chosen = given.filter(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "_label").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` narrow rows

    def measured(batches):
        for batch in batches:
            ids = [zlib.crc32(str(i).encode()) for i in batch.column("doc_id").to_pylist()]
            values = _matrix(batch.column("text").to_pylist()).tolist()
            yield pa.RecordBatch.from_pydict({"place": pa.array(ids, pa.int64()), "label": batch.column("_label"), "values": values})

    found = joined.select("doc_id", "text", "_label").mapInArrow(measured, "place long, label int, values array<double>")
    taken = found.orderBy("place", "values", "label").limit(sample).collect()
    rows = np.array([r["values"] for r in taken], np.float64).reshape(-1, len(FEATURES))
    return fit(rows, np.array([r["label"] for r in taken], np.int64))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def scored(batches):
        for batch in batches:
            found = model.scores(_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    rows = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` by a model of ``train``."""
    return score(docs, train(docs, labels))

"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few dozen measures (`MEASURES`), each of which falls into one of some bins; a document's log-odds are
the sum of one table entry a measure and one a chosen pair of measures. Tables are learned by cyclic boosting: turn by
turn each measure gets a tree of three leaves over its bins, fitted to what the others leave, at a small rate; then the
pairs that explain most of the rest get trees of depth two over coarser bins, likewise. A part of the sample is held
back to end each phase at its best round.

Only the fit sees a sample: `sample` labelled documents at most, chosen by a hash of their ids, whose measures (no
texts) come to the driver. Scoring is a lookup and an addition over every whole text, in Arrow batches.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS, STOPS, MARKS = b"#*$%&|<>", b".,;:", b"!?"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
MEASURES = (
    "log_words", "symbols", "uppercase", "digits", "stops", "marks", "bytes_a_letter", "word_length", "longest_word", "distinct_words", "distinct_pairs",
    "repeated_in_a_row", "commonest_word", "duplicate_lines", "words_a_line", "longest_line", "words_with_symbols", "lower_first", "lone_characters", "ends_in_stop",
)


def measures(text: str | None) -> tuple[float, ...]:
    """MEASURES of a whole text: shares, lengths and counts that say nothing of where the text comes from. Texts
    without words have zeros."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    count = lambda of: len(raw) - len(raw.translate(None, of))
    upper, lower, digits, symbols, stops, marks = map(count, (UPPER, LOWER, DIGITS, SYMBOLS, STOPS, MARKS))
    lengths = list(map(len, words))
    chars = sum(lengths)
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [text]
    times = Counter(words)
    marked = sum(1 for w in times.elements() if w[-1] in "#*$%&|<>!") if symbols or marks else 0
    return (
        float(np.log1p(n)), symbols / chars, upper / (upper + lower + 1), digits / chars, stops / n, marks / n, (len(raw) - n) / (upper + lower + 1), chars / n, float(np.log1p(max(lengths))), len(times) / n, len(set(zip(words, islice(words, 1, None)))) / n,
        sum(map(eq, words, islice(words, 1, None))) / n, max(times.values()) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), float(np.log1p(max(map(len, lines)))), marked / n, sum(k for w, k in times.items() if w[0].islower()) / n, lengths.count(1) / n, float(words[-1][-1] in ".!?"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([measures(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(c for name, c in zip(b.schema.names, b.columns) if name != "text"), found], names=[*(n for n in b.schema.names if n != "text"), "x"])


@dataclass(frozen=True)
class Model:
    """base log-odds; per measure the upper bounds of its bins and a table; per pair its places, its bounds and table."""

    base: float
    edges: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray, np.ndarray, np.ndarray], ...]

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of measures: lookups and additions."""
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], "right")]
        for j, k, first, second, table in self.pairs:
            out += table[np.searchsorted(first, x[:, j], "right"), np.searchsorted(second, x[:, k], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -60, 60)))


#: Ridge on a leaf's curvature, least curvature of a leaf, and the rate of each tree.
RIDGE, LEAST, RATE = 1.0, 2.0, 0.15


def _gain(g: np.ndarray, h: np.ndarray, total_g, total_h) -> np.ndarray:
    """What a split of (total_g, total_h) into (g, h) and the rest explains; nothing where a side is too light."""
    rest_g, rest_h = total_g - g, total_h - h
    gain = g * g / (h + RIDGE) + rest_g * rest_g / (rest_h + RIDGE) - total_g * total_g / (total_h + RIDGE)
    return np.where((h >= LEAST) & (rest_h >= LEAST), gain, 0.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    if len(g) < 2:
        return 0.0, 0
    gains = _gain(np.cumsum(g)[:-1], np.cumsum(h)[:-1], g.sum(), h.sum())
    return float(gains.max()), int(gains.argmax()) + 1


def line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of up to three leaves over the bins' gradients and curvatures."""
    cuts = [0, len(g)]
    for _ in range(2):
        tried = [(*_split(g[a:b], h[a:b]), a) for a, b in zip(cuts, cuts[1:])]
        gain, at, start = max(tried)
        if gain <= 0:
            break
        cuts = sorted([*cuts, start + at])
    out = np.zeros(len(g))
    if len(cuts) > 2:
        for a, b in zip(cuts, cuts[1:]):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _halves(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the first cut of a grid along its first axis, each half then cut best along the second."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = 0.0
    for a, b in ((cg[:-1], ch[:-1]), (cg[-1] - cg[:-1], ch[-1] - ch[:-1])):
        total = total + _gain(a[:, :-1], b[:, :-1], a[:, -1:], b[:, -1:]).max(1)
    first = _gain(cg[:-1, -1], ch[:-1, -1], cg[-1, -1], ch[-1, -1])
    gains = np.where(first + total > 0, first + total, 0.0)
    return float(gains.max()), int(gains.argmax()) + 1


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain, and values by cell, of the best tree of depth two over a grid: one axis first, then the other."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    (gain, at), (other, across) = _halves(g, h), _halves(g.T, h.T)
    if other > gain:
        return other, grid_values(g.T, h.T, across).T
    return gain, grid_values(g, h, at) if gain > 0 else np.zeros(g.shape)


def grid_values(g: np.ndarray, h: np.ndarray, at: int) -> np.ndarray:
    out = np.zeros(g.shape)
    for rows in (slice(0, at), slice(at, None)):
        _, cut = _split(g[rows].sum(0), h[rows].sum(0))
        for columns in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + RIDGE)
    return out


def _bounds(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds of bins of about the same number of rows; equal values share a bin."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _boost(y, held, margin, cells, shapes, tree, rounds, patience=25):
    """Cyclic boosting of tables over `cells` (a bin a row and table): the tables of the round that is best on `held`."""
    tables, best = [np.zeros(s) for s in shapes], (np.inf, 0, None, None)
    fit = ~held
    for turn in range(rounds):
        for k, (cell, shape) in enumerate(zip(cells, shapes)):
            p = 1 / (1 + np.exp(-margin))
            size = int(np.prod(shape))
            g = np.bincount(cell[fit], (y - p)[fit], size).reshape(shape)
            h = np.bincount(cell[fit], (p * (1 - p))[fit], size).reshape(shape)
            step = RATE * tree(g, h)
            tables[k] += step
            margin = margin + step.ravel()[cell]
        signed = np.where(y > 0, margin, -margin)[held]
        loss = float(np.logaddexp(0, -signed).mean()) if len(signed) else -turn
        if loss < best[0] - 1e-6:
            best = (loss, turn, [t.copy() for t in tables], margin.copy())
        elif turn - best[1] >= patience:
            break
    return best[2], best[3]


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 10, pairs: int = 8, rounds: int = 300) -> Model:
    """The model of measures x (rows by MEASURES) and labels y of 0 and 1. Without both labels it is their smoothed
    share alone."""
    y = np.asarray(y, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = tuple(_bounds(x[:, j], bins) for j in range(len(MEASURES)))
    if not 0 < y.sum() < len(y):
        return Model(base, edges, tuple(np.zeros(len(e) + 1) for e in edges), ())
    held = np.arange(len(y)) % 5 == 0
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    tables, margin = _boost(y, held, np.full(len(y), base), binned, [(len(e) + 1,) for e in edges], line_tree, rounds)
    coarse = [_bounds(x[:, j], pair_bins) for j in range(len(MEASURES))]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]
    p = 1 / (1 + np.exp(-margin))
    ranked = []
    for j, k in combinations(range(len(MEASURES)), 2):
        shape = (len(coarse[j]) + 1, len(coarse[k]) + 1)
        cell = small[j] * shape[1] + small[k]
        grid = lambda v: np.bincount(cell[~held], v[~held], shape[0] * shape[1]).reshape(shape)  # noqa: B023, E731
        ranked.append((-grid_tree(grid(y - p), grid(p * (1 - p)))[0], j, k, shape))
    chosen = [(j, k, s) for gain, j, k, s in sorted(ranked)[:pairs] if gain < 0]
    grids, _ = _boost(y, held, margin, [small[j] * s[1] + small[k] for j, k, s in chosen], [s for *_, s in chosen], lambda g, h: grid_tree(g, h)[1], rounds) if chosen else ([], None)
    return Model(base, edges, tuple(tables), tuple((j, k, coarse[j], coarse[k], t) for (j, k, _), t in zip(chosen, grids)))


#: Labelled documents that a fit sees at most.
SAMPLE = 20_000


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of labelled documents. An id's label is the smallest of its rows, null ids and labels are left out;
    of repeated ids each row is an example. Both the ids and the examples are those of the smallest hashes, `sample`
    at most, so the driver gets no more rows of measures than that."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("y", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), "text")
    held = rows.mapInArrow(_measured, f"y {dict(chosen.dtypes)['y']}, h long, t long, x array<double>")
    found = held.orderBy("h", "t").limit(sample).select("y", "x").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(len(found), len(MEASURES))
    return fit_tables(x, (found["y"].to_numpy() > 0).astype(float) if len(found) else np.zeros(0))


def classify(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, score (the share of good ones among such documents, 0 to 1), predicted (1 from
    `threshold` on), and the columns in `carry` under names that begin with carried_.

    Null and empty texts have measures of zero and a score like others; texts are read whole, however long; equal texts
    have equal scores; repeated rows and null ids are scored each; no documents give no rows. Labels, languages,
    sources and ids are no inputs; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measures(t) for t in b.column("text").to_pylist()], np.float64).reshape(b.num_rows, len(MEASURES))
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(model.scores(x))], names=[*names, "score"])

    own = docs.select(F.col(id_col).alias("id"), *carried(carry), F.col(text_col).alias("text"))
    kept = own.drop("text").schema.add("score", "double")
    scored = own.mapInArrow(run, kept)
    return scored.select(F.col("id").alias(id_col), "score", predicted(F.col("score"), threshold).alias("predicted"), *(f"carried_{c}" for c in carry))


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")

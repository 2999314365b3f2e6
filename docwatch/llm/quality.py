"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text (counts of kinds of characters, words and lines, found in one pass) are binned at
quantiles. Shallow trees are boosted in turn, one feature after another, round by
round, each adding a small step to that feature's lookup table; then the pairs of features whose joint
cells explain most of what is left get two-dimensional tables the same way. A score is the sum of
table entries at the text's bins, added for a whole batch at once, through the logistic function.

Training uses at most `sample` labelled rows (a documented bound, drawn by a hash of the id); their
features are computed where the texts are, and only these numbers reach the driver. Scoring is one pass without a shuffle.

Null and empty texts have the features of no characters and get a score like any other. Labels, language, source and id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 120, 0.08
NAMES = (
    "log_bytes", "word_bytes", "upper", "digit", "symbol", "bang", "bar", "stop", "other", "line_words",
    "distinct_words", "repeat_next", "distinct_lines", "short_words", "word_spread", "top_word",
)

_KIND = np.full(256, 7, np.int64)  # 7 other, of which bytes above 127 are letters
_KIND[128:] = 0
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b"#$%&*@^~_+=<>{}[]\\/`":
    _KIND[_c] = 3
_KIND[ord("!")] = 4
_KIND[ord("|")] = 5
for _c in b".,;:?'\"()-":
    _KIND[_c] = 6
for _c in b" \t\n\v\f\r":
    _KIND[_c] = 8


def features(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, t in enumerate(texts):
        kinds = np.zeros(9, np.int64)
        for lo in range(0, len(t), 1 << 20):
            kinds += np.bincount(_KIND[np.frombuffer(t, np.uint8, min(1 << 20, len(t) - lo), lo)], minlength=9)
        solid = max(1, int(kinds[:8].sum()))
        words = t.split()
        n = max(1, len(words))
        lines = [x for x in t.split(b"\n") if x.strip()]
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
        out[i] = (
            np.log1p(len(t)), solid / n, kinds[1] / solid, kinds[2] / solid, kinds[3] / solid, kinds[4] / solid, kinds[5] / solid,
            kinds[6] / solid, kinds[7] / solid, n / max(1, len(lines)), len(seen) / n**0.75,
            sum(map(bytes.__eq__, words[1:], words)) / n, len(set(lines)) / max(1, len(lines)),
            (lengths <= 3).mean(), lengths.std(), max(seen.values(), default=0) / n,
        )
    return out


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _step(g: np.ndarray, h: np.ndarray, leaves: int, least: float = 5.0, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of a shallow tree over ordered bins with gradients `g` and weights `h`: best splits first."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            k = np.arange(a + 1, b)
            k = k[(ch[k] - ch[a] >= least * 0.05) & (ch[b] - ch[k] >= least * 0.05)]
            if k.size:
                v = gain(a, k) + gain(k, b) - gain(a, b)
                if v.max() > best[0]:
                    best = (float(v.max()), (a, b), int(k[v.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Values of a depth-two tree over a grid: one cut of the rows, then of each side's columns (or the other way)."""
    best, table = -1.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        cg, ch = np.cumsum(np.cumsum(gg, 0), 1), np.cumsum(np.cumsum(hh, 0), 1)
        for r in range(1, gg.shape[0]):
            got, cuts = 0.0, []
            for lo, hi in ((0, r), (r, gg.shape[0])):
                rg = cg[hi - 1] - (cg[lo - 1] if lo else 0)
                rh = ch[hi - 1] - (ch[lo - 1] if lo else 0)
                v = rg[:-1] ** 2 / (rh[:-1] + ridge) + (rg[-1] - rg[:-1]) ** 2 / (rh[-1] - rh[:-1] + ridge)
                k = int(v.argmax()) if v.size else 0
                got += float(v[k]) if v.size else 0.0
                cuts.append((lo, hi, k + 1, rg, rh))
            if got > best:
                best, t = got, np.zeros_like(gg)
                for lo, hi, k, rg, rh in cuts:
                    t[lo:hi, :k] = rg[k - 1] / (rh[k - 1] + ridge)
                    t[lo:hi, k:] = (rg[-1] - rg[k - 1]) / (rh[-1] - rh[k - 1] + ridge)
                table = t.T if turned else t
    return table, best


class Model:
    """Lookup tables by feature and by pair; a few thousand numbers."""

    def __init__(self, x: np.ndarray):
        self.cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
        self.coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.base = 0.0

    def bins(self, x: np.ndarray, coarse: bool = False) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse if coarse else self.cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, self.bins(x)):
            total += table[b]
        if self.pairs:
            coarse = self.bins(x, True)
            for i, j, table in self.pairs:
                total += table[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one-feature tables, then of pair tables."""
    m = Model(x)
    if not len(x):
        return m
    share = (y.sum() + 1) / (len(y) + 2)
    m.base = float(np.log(share / (1 - share)))
    f = np.full(len(x), m.base)
    fine = m.bins(x)
    for _ in range(ROUNDS):
        for j, b in enumerate(fine):
            p = 1 / (1 + np.exp(-f))
            size = len(m.tables[j])
            step = RATE * _step(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size), 3)
            m.tables[j] += step
            f += step[b]
    coarse = m.bins(x, True)
    shape = [len(c) + 1 for c in m.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        at = coarse[i] * shape[j] + coarse[j]
        n = shape[i] * shape[j]
        return at, np.bincount(at, y - p, n).reshape(shape[i], shape[j]), np.bincount(at, p * (1 - p), n).reshape(shape[i], shape[j])

    gains = sorted(((-_pair_step(*cells(i, j)[1:])[1], i, j) for i in range(x.shape[1]) for j in range(i)))
    m.pairs = [(i, j, np.zeros((shape[i], shape[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(ROUNDS // 4):
        for i, j, table in m.pairs:
            at, g, h = cells(i, j)
            step = RATE * _pair_step(g, h)[0]
            table += step
            f += step.ravel()[at]
    return m


def _measured(names: list[str]):
    def run(batches):
        for b in batches:
            texts = [v or b"" for v in b.column("text").cast(pa.binary()).to_pylist()]
            x = features(texts)
            arrays = [b.column(c) for c in names] + [pa.array(x[:, j]) for j in range(x.shape[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *NAMES])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of `labels` (doc_id, quality), drawn from all of them by a hash of the id."""
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    kept = ["doc_id", "quality"]
    schema = T.StructType([*rows.select(*kept).schema.fields, *[T.StructField(n, T.DoubleType()) for n in NAMES]])
    found = rows.mapInArrow(_measured(kept), schema).orderBy(F.xxhash64("doc_id"), "doc_id", *NAMES).limit(sample).toPandas()
    return fit(found[list(NAMES)].to_numpy(float), found["quality"].to_numpy(float))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with `name`, the probability of label 1; other columns unchanged (a column of that name is replaced)."""
    kept = docs.select(*[c for c in docs.columns if c != name])
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = [v or b"" for v in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told.value.score(features(texts)))], names=[*b.schema.names, name])

    return kept.mapInArrow(run, schema)

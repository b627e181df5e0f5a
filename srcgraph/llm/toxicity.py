"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import pick
from ._text import chunks, hash_words, hashes
from .language import held_out, within

#: Labelled documents that lexicon, trees and calibration are fitted on.
SAMPLE = 12_000
#: UTF-8 bytes of these documents, at most.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: A lexicon entry is a word or word prefix that at least so many toxic documents of the sample have.
SUPPORT, LEAST_ODDS, ENTRIES = 4, 2.0, 4000
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 5
SECOND = ["you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "vous", "votre", "ton", "du", "dich", "dir", "dein", "deine", "ihr", "usted", "ustedes", "ti", "su"]
FEATURES = ["hits", "hit_density", "weight_density", "heaviest", "distinct", "leet_hits", "near_second", "second_density", "capitals", "capital_words", "punctuation", "exclamations", "symbols", "mixed_words", "stretched", "repetition", "log_words"]

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LEET = np.zeros(256, np.uint8)
for _a, _b in zip(b"0134578@$", b"oieastbas", strict=True):
    _LEET[_a] = _b
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"@#$%^&*~_")] = True


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the capital Latin-1 letters."""
    out = data.copy()
    out[_UPPER[data]] += 32
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def _runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(mask)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last[:-1] &= ~mask[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def _keys(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its prefixes; a shorter word has 0 there."""
    keys = [hashes(low, starts, ends, fold=False)]
    for k in PREFIXES:
        long = ends - starts > k
        h = np.zeros(len(starts), np.uint64)
        h[long] = hashes(low, starts[long], starts[long] + k, fold=False) ^ np.uint64(0x5555)
        keys.append(h)
    return keys


def _match(keys: list[np.ndarray], lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    best = np.zeros(len(keys[0]))
    if len(lexicon):
        for h in keys:
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            np.maximum(best, np.where(lexicon[at] == h, weight[at], 0.0), out=best)
    return best


def features(data: np.ndarray, off: np.ndarray, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text; texts without words have zeros."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros((rows, len(FEATURES)))
    low = _fold(data)
    starts, ends, row = _runs(_LETTER[data], off)
    per = lambda r, w=None: np.bincount(r, w, rows).astype(float)
    sums = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[off]).astype(float)
    words, letters, chars = per(row), sums(_LETTER[data]), np.diff(off).astype(float)
    each, many = np.maximum(words, 1), np.maximum(chars, 1)
    value = _match(_keys(low, starts, ends), lexicon, weight)
    hit = value > 0
    hits, heavy = per(row[hit]), np.zeros(rows)
    np.maximum.at(heavy, row[hit], value[hit])
    word = hashes(low, starts[hit], ends[hit], fold=False)
    distinct = per(np.unique(np.stack([row[hit].astype(np.uint64), word]), axis=1)[0].astype(np.int64)) if hit.any() else np.zeros(rows)
    joined = np.where(_LEET[data] > 0, _LEET[data], low)
    s2, e2, r2 = _runs(_LETTER[data] | (_LEET[data] > 0), off)
    digits = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    mixed = digits[e2] - digits[s2]
    mixed = (mixed > 0) & (mixed < e2 - s2)
    leet = _match(_keys(joined, s2[mixed], e2[mixed]), lexicon, weight) > 0
    second = np.isin(hashes(low, starts, ends, fold=False), _SECOND)
    # words to the nearest second-person word, row by row
    at = np.flatnonzero(second)
    near = np.zeros(len(starts), bool)
    if len(at) and hit.any():
        own = np.flatnonzero(hit)
        k = np.searchsorted(at, own)
        for side in (np.maximum(k - 1, 0), np.minimum(k, len(at) - 1)):
            near[own] |= (np.abs(at[side] - own) <= NEAR) & (row[at[side]] == row[own])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (upper[ends] - upper[starts] >= 2) & (upper[ends] - upper[starts] >= 0.6 * (ends - starts))
    same = np.zeros(len(data), bool)
    same[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[data[2:]]
    again = np.zeros(len(starts), bool)
    all_words = hashes(low, starts, ends, fold=False)
    again[1:] = (all_words[1:] == all_words[:-1]) & (row[1:] == row[:-1])
    return np.stack([np.minimum(hits, 50), hits / each, per(row, value) / each, heavy, np.minimum(distinct, 20), per(r2[mixed][leet]), per(row[near]), per(row[second]) / each, sums(_UPPER[data]) / np.maximum(letters, 1), per(row[shout]) / each, sums(_MARK[data]) / many, sums(data == 33) / many, sums(_SYMBOL[data]) / many, per(r2[mixed]) / each, sums(same) / many, per(row[again]) / each, np.log1p(words)], axis=1)


_SECOND = np.sort(hash_words(SECOND))


def learn_lexicon(column: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log odds of the words and word prefixes that mark toxic documents in the sample."""

    def counts(which: np.ndarray, only: np.ndarray | None):
        total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for i, j, data, off in chunks(column):
            low = _fold(data)
            starts, ends, row = _runs(_LETTER[data], off)
            ok = which[i:j][row]
            keys = _keys(low, starts[ok], ends[ok])
            h, r = np.concatenate(keys), np.tile(row[ok], len(keys))
            good = h != 0
            if only is not None:
                at = np.minimum(np.searchsorted(only, h), len(only) - 1)
                good &= only[at] == h
            order = np.lexsort((r[good], h[good]))
            h, r = h[good][order], r[good][order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            value, count = np.unique(h[fresh], return_counts=True)
            value, where = np.unique(np.concatenate([total[0], value]), return_inverse=True)
            total = (value, np.bincount(where, np.concatenate([total[1], count]), len(value)).astype(np.int64))
        return total

    if not toxic.any():
        return np.zeros(0, np.uint64), np.zeros(0)
    value, bad = counts(toxic, None)
    value, bad = value[bad >= SUPPORT], bad[bad >= SUPPORT]
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(0)
    other, count = counts(~toxic, value)
    clean = np.zeros(len(value), np.int64)
    clean[np.searchsorted(value, other)] = count
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / ((~toxic).sum() + 1))
    top = np.lexsort((value, -odds * np.sqrt(bad)))
    top = np.sort(top[odds[top] >= LEAST_ODDS][:ENTRIES])
    return value[top], np.minimum(odds[top], 8.0)


class Boosted:
    """Logistic boosting of histogram trees."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 10):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        self.cuts = [np.unique(np.concatenate([c, [0.0]])) if (x[:, k] > 0).any() else c for k, c in enumerate(self.cuts)]
        binned = self._bin(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.start)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, p - y, p * (1 - p) + 1e-9)
            self.trees.append(tree)
            raw += self._leaf(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        feature, limit, value = [-1] * (2 ** (self.depth + 1)), [0] * (2 ** (self.depth + 1)), [0.0] * (2 ** (self.depth + 1))
        work = [(1, np.arange(len(g)))]
        while work:
            node, at = work.pop()
            sg, sh = g[at].sum(), h[at].sum()
            value[node] = -self.rate * sg / (sh + 1.0)
            if node >= 2**self.depth or len(at) < 2 * self.least:
                continue
            best = (1e-3, -1, 0)
            for k in range(b.shape[1]):
                size = len(self.cuts[k]) + 1
                cg, ch, cn = (np.cumsum(np.bincount(b[at, k], w, size))[:-1] for w in (g[at], h[at], None))
                gain = cg**2 / (ch + 1) + (sg - cg) ** 2 / (sh - ch + 1) - sg**2 / (sh + 1)
                gain[(cn < self.least) | (len(at) - cn < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                feature[node], limit[node] = best[1], best[2]
                left = b[at, best[1]] <= best[2]
                work += [(2 * node, at[left]), (2 * node + 1, at[~left])]
        return np.array(feature), np.array(limit), np.array(value)

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feature, limit, value = tree
        node = np.ones(len(b), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = np.where(b[np.arange(len(b)), np.maximum(f, 0)] <= limit[node], 2 * node, 2 * node + 1)
            node = np.where(f >= 0, go, node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.start + sum((self._leaf(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (score, probability) knots to interpolate between."""
    order = np.argsort(score, kind="stable")
    at, first = np.unique(score[order], return_index=True)
    total, weight = np.add.reduceat(y[order].astype(float), first), np.diff(np.append(first, len(y))).astype(float)
    blocks: list[list[float]] = []
    for lo, t, w in zip(at.tolist(), total.tolist(), weight.tolist(), strict=True):
        blocks.append([lo, lo, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, t2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + t2, blocks[-1][3] + w2]
    x = np.array([v for b in blocks for v in b[:2]])
    p = np.array([b[2] / b[3] for b in blocks for _ in range(2)])
    x, keep = np.unique(x, return_index=True)
    return x, p[keep]


class ToxicityModel:
    def __init__(self, lexicon, weight, trees: Boosted | None, knots):
        self.lexicon, self.weight, self.trees, self.knots = lexicon, weight, trees, knots

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], seed: int = 11) -> ToxicityModel:
        """Two folds take turns: lexicon and trees of one score the other, and these scores are calibrated.

        So neither trees nor calibration see lexicon hits of the documents that the lexicon was learnt from.
        """
        column, y = pa.array(texts, pa.large_string()), np.array(labels, np.int64)
        if len(y) == 0 or y.min() == y.max():
            return cls(np.zeros(0, np.uint64), np.zeros(0), None, (np.array([0.0]), np.array([float(y.mean()) if len(y) else 0.0])))
        matrix = lambda c, lex: np.concatenate([features(d, o, *lex) for _, _, d, o in chunks(c)])
        fold = np.random.default_rng(seed).permutation(len(y)) % 2
        x = np.zeros((len(y), len(FEATURES)))
        for k in (0, 1):
            lex = learn_lexicon(column.filter(pa.array(fold != k)), y[fold != k].astype(bool))
            x[fold == k] = matrix(column.filter(pa.array(fold == k)), lex)
        raw = np.zeros(len(y))
        for k in (0, 1):
            raw[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
        return cls(*learn_lexicon(column, y.astype(bool)), Boosted().fit(x, y), isotonic(raw, y))

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for i, j, data, off in chunks(column):
            raw = self.trees.raw(features(data, off, self.lexicon, self.weight)) if self.trees else np.zeros(j - i)
            out[i:j] = np.interp(raw, *self.knots)
        return np.clip(out, 0.0, 1.0)


def _score(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if k}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(model.score(batch.column(0)))})

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on about ``sample`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Null labels and null ids aren't used; a null text counts as empty. A document with several labels counts
    as toxic when one of them is.
    """
    truth = pick(labels, doc_id=id_col, y=label_col).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(~held_out(1, 3)).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    total = truth.count()
    drawn = truth.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(total, 1)) * (1 << 30)).limit(2 * sample)
    chosen = {r.doc_id: r.y for r in drawn.collect()}  # at most twice ``sample`` pairs of integers
    texts = pick(docs, doc_id=id_col, text=text_col)
    small = texts.sparkSession.createDataFrame(list(chosen.items()) or [(None, None)], "doc_id long, y int")
    turn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    got = within(texts.join(F.broadcast(small), "doc_id").limit(2 * sample), turn, SAMPLE_BYTES, "y").select("doc_id", "text", "y").toArrow()
    got = got.take(pa.compute.sort_indices(got, [("doc_id", "ascending"), ("text", "ascending")]))
    return ToxicityModel.fit(got["text"].to_pylist(), got["y"].to_pylist(), seed)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the calibrated score, from the text alone, to the columns ``keep``.

    Null and empty texts get the score of a text without words. Ties and repeated rows get equal scores; of a very long
    text all words count. With labels of one kind only, the score is their mean. An empty table gives an
    empty result.
    """
    keep = docs.columns if keep is None else keep
    rows = pick(docs, __text=text, **{c: c for c in keep})
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(_score(model), fields + "score double")


def op6(spark, sf_dir: str) -> DataFrame:
    """``score`` all documents by what ``fit_toxicity`` learns outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

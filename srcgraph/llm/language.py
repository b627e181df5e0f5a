"""Language identification by string kernels: presence n-grams, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import cut, pick
from ._text import buffers, chunks

UNKNOWN = "und"
#: Documents per language that the model is fitted on, and the most languages.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 600, 1000
#: UTF-8 bytes of all documents that the model is fitted on, at most.
SAMPLE_BYTES = 64 << 20
#: Hashed n-gram presence slots of length 1, 2 and 3 bytes.
SIZES = (256, 4096, 12288)
LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS = 32, 512
#: Rows scored by one matrix product.
PRODUCT_ROWS = 256
RIDGE = 1e-2

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_BASE = np.concatenate([[0], np.cumsum(SIZES)])
WIDTH = int(_BASE[-1])


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row-normalised presence of the blended spectrum: a dot product of two rows is their kernel.

    Each length's n-grams are a set; the kernel is the mean over lengths of the sets' cosine.
    """
    rows, n = len(off) - 1, len(data)
    flat = np.zeros(rows * WIDTH, bool)
    if n:
        folded = _FOLD[data].astype(np.uint32)
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
        base = row * WIDTH
        flat[base + folded] = True
        h = folded
        for k, size in enumerate(SIZES[1:], 1):
            if n <= k:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ folded[k:]
            at = ((h * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(size)
            inside = row[:-k] == row[k:]
            flat[(base[:-k] + (_BASE[k] + at))[inside]] = True
    out = flat.reshape(rows, WIDTH).astype(np.float32)
    for k in range(len(SIZES)):
        part = out[:, _BASE[k] : _BASE[k + 1]]
        count = part.sum(axis=1, keepdims=True)
        part /= np.sqrt(np.maximum(count, 1) * len(SIZES), dtype=np.float32)
    return out


def has_letter(column: pa.Array) -> np.ndarray:
    data, off = buffers(column)
    first = off[0]
    seen = np.concatenate([[0], np.cumsum(_ASCII[data[first : off[-1]]])])
    out = seen[off[1:] - first] > seen[off[:-1] - first]
    for k in np.flatnonzero(~out & (off[1:] > off[:-1])).tolist():
        out[k] = any(map(str.isalpha, data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


class LanguageModel:
    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, bias: np.ndarray, slope: float):
        self.languages, self.landmarks, self.weights, self.bias, self.slope = languages, landmarks, weights, bias, slope

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel:
        """Nyström map from landmarks drawn evenly from the languages, then one-versus-rest ridge regression."""
        keep = np.flatnonzero(has_letter(pa.array(texts, pa.large_string()))) if texts else np.zeros(0, int)
        texts, langs = [texts[k] for k in keep], [langs[k] for k in keep]
        languages = sorted(set(langs))
        if not languages:
            return cls([], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32), np.zeros(0, np.float32), 1.0)
        rng, label = np.random.default_rng(seed), np.array([languages.index(x) for x in langs])
        each = max(1, min(LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS // len(languages)))
        chosen = np.concatenate([rng.permutation(np.flatnonzero(label == k))[:each] for k in range(len(languages))])
        rows = lambda ts: np.concatenate([presence(d, o) for _, _, d, o in chunks(pa.array(ts, pa.large_string()), rows=PRODUCT_ROWS)])
        landmarks = rows([texts[k] for k in chosen])
        kernel = np.concatenate([presence(d, o) @ landmarks.T for _, _, d, o in chunks(pa.array(texts, pa.large_string()), rows=PRODUCT_ROWS)]).astype(float)
        value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
        good = value > 1e-6 * value.max()
        root = vector[:, good] / np.sqrt(value[good])
        phi = kernel @ root
        share = 1 / np.bincount(label)[label]
        mean = (share @ phi) / share.sum()
        centred, target = phi - mean, np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
        middle = (share @ target) / share.sum()
        left = (centred * share[:, None]).T @ centred
        coef = np.linalg.solve(left + RIDGE * np.trace(left) / len(left) * np.eye(len(left)), (centred * share[:, None]).T @ (target - middle))
        decision = centred @ coef + middle

        def loss(s):
            z = decision * s
            z -= z.max(axis=1, keepdims=True)
            return -(share * (z[np.arange(len(label)), label] - np.log(np.exp(z).sum(axis=1)))).sum()

        slope = min((0.5 * 2 ** (k / 2) for k in range(13)), key=loss)
        return cls(languages, landmarks, (root @ coef).astype(np.float32), (middle - mean @ coef).astype(np.float32), slope)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text (-1: unknown) and its score."""
        n = len(column)
        best, score, letters = np.full(n, -1), np.zeros(n), has_letter(column)
        if not self.languages:
            return best, score
        for i, j, data, off in chunks(column, rows=PRODUCT_ROWS):
            z = (presence(data, off) @ self.landmarks.T @ self.weights + self.bias) * self.slope
            z = np.exp((z - z.max(axis=1, keepdims=True)).astype(float))
            best[i:j] = z.argmax(axis=1)
            score[i:j] = z.max(axis=1) / z.sum(axis=1)
        best[~letters], score[~letters] = -1, 0.0
        return best, score


def _predict(model: LanguageModel):
    names = pa.array([*model.languages, UNKNOWN], pa.string())

    def run(batches):
        for batch in batches:
            best, score = model.predict(batch.column(0))
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names) if k}
            where = np.where(best < 0, len(names) - 1, best)
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": names.take(pa.array(where)), "score": pa.array(score)})

    return run


def held_out(fold: int, folds: int) -> F.Column:
    """Whether crc32 of doc_id as text leaves ``fold``; null ids are never held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % folds == fold, F.lit(False))


def fit_language(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on about ``sample`` documents of each language, chosen by a hash of their ids; null ids aren't used.

    All languages are learnt; with more than MOST_LANGUAGES of them, those with the most documents.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(0, 5))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return LanguageModel.fit([], [])
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    turn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    drawn = rows.where(turn < share[F.col("lang")] * (1 << 30)).limit(2 * sample * len(counts))
    got = within(drawn, turn, SAMPLE_BYTES, "lang").collect()
    got.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return LanguageModel.fit([r.text for r in got], [r.lang for r in got], seed)


def within(drawn: DataFrame, turn: F.Column, most_bytes: int, column: str) -> DataFrame:
    """The drawn ``(doc_id, text, column)`` whose whole texts have at most ``most_bytes`` together, in hashed order.

    Only ids and lengths reach the driver first. A text that doesn't fit any more is passed over, so a few very
    long ones don't keep all others out.
    """
    drawn = cut(drawn.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), column, turn.alias("__turn")))
    chosen, held = [], 0
    for r in sorted(drawn.select("doc_id", "__turn", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["__turn"], r.doc_id, r.n)):
        if held + r.n <= most_bytes:
            held += r.n
            chosen.append((r.doc_id, r.n))
    keep = drawn.sparkSession.createDataFrame(sorted(set(chosen)) or [(None, None)], T.StructType([T.StructField("doc_id", drawn.schema["doc_id"].dataType), T.StructField("__n", T.IntegerType())]))
    return drawn.join(F.broadcast(keep), (drawn["doc_id"] == keep["doc_id"]) & (F.octet_length("text") == F.col("__n")), "left_semi").drop("__turn")  # as many as drawn


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score, from the text alone, to the columns ``keep``.

    A null text, an empty one or one without letters is ``und`` with score 0. A tie goes to the language first
    in order. Repeated rows get equal results; a very long text is one set of n-grams like any other. With no
    language learnt everything is ``und``. An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    rows = pick(docs, __text=text, **{c: c for c in keep})
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(_predict(model), fields + "lang_pred string, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    """``identify`` all documents by what ``fit_language`` learns outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit_language(docs), keep=["doc_id"])
    return out.select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", "score")

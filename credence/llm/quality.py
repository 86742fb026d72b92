"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Every pair of a good and a bad labelled document is a preference. The score of a document is linear in
the features of its text, its weights minimise the logistic loss on the difference of the features of the
two documents of a pair, and a document is accepted when its score reaches the quantile of the training
scores at which the labelled share of bad documents lies. A logistic map puts that quantile at
``THRESHOLD`` and every score between 0 and 1.

Null and empty texts get the features of an empty text and so a score like any other. Repeated rows are
scored one by one. Without labels of both classes every score is the share of good labels (1 without any).
Further columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import crc_mod, label_sample, texts

THRESHOLD = 0.3
#: Labelled rows of either class that the fit may use.
PER_CLASS = 6000
#: Preference pairs drawn from them.
PAIRS = 60_000

_CLASSES = 7  # lower, upper, digit, space, sentence mark, symbol, other letter


def _char_table() -> np.ndarray:
    table = np.full(0x3000, 6, dtype=np.uint8)
    for code in range(0x3000):
        c = chr(code)
        if c.islower():
            table[code] = 0
        elif c.isupper():
            table[code] = 1
        elif c.isdigit():
            table[code] = 2
        elif c.isspace():
            table[code] = 3
        elif c in ".,;:'\"()-":
            table[code] = 4
        elif not c.isalpha():
            table[code] = 5
    return table


_TABLE = _char_table()
#: ASCII symbols, of which a text's commonest counts on its own: a separator or filler shows by its share.
_SYMBOLS = np.flatnonzero(_TABLE[:128] == 5)


def features(text: str | None) -> list[float]:
    """What the whole text shows of its make: characters, words, lines and repetition."""
    text = text or ""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.bincount(_TABLE[np.minimum(codes, 0x2FFF)], minlength=_CLASSES)
    commonest = np.bincount(codes[codes < 128], minlength=128)[_SYMBOLS].max()
    n, nw, nl = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    letters = max(1, kinds[0] + kinds[1] + kinds[6])
    pairs = max(1, len(words) - 1)
    same = sum(map(str.__eq__, words, words[1:]))
    distinct = len(set(words))
    distinct_pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    clean = sum(map(str.isalpha, words))
    ended = sum(x.rstrip().endswith((".", "!", "?", '"')) for x in lines)
    stops = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        np.log1p(len(words)),
        kinds[1] / letters,
        kinds[2] / n,
        kinds[3] / n,
        kinds[4] / n,
        kinds[5] / n,
        commonest / n,
        min(1.0, 20 * kinds[5] / n),
        min(1.0, 5 * kinds[1] / letters),
        min(1.0, 40 * commonest / n),
        distinct / nw,
        distinct_pairs / pairs,
        same / pairs,
        min(1.0, 20 * same / pairs),
        lengths.mean() / 10,
        min(60, int(lengths.max())) / 20,
        lengths.std() / 5,
        clean / nw,
        len(set(lines)) / nl,
        np.log1p(len(words) / nl),
        ended / nl,
        np.log1p(len(words) / (stops + 1)),
    ]


N_FEATURES = len(features(""))


def _widen(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -5, 5)
    return np.hstack([z, z * z / 5, np.abs(z)])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 400) -> dict:
    """Weights, scaling, accepting quantile and slope of the map to 0..1."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"const": float(y.mean()) if len(y) else 1.0}
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = _widen(x, mean, std)
    rng = np.random.default_rng(0)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # of preferring the bad document
        g = -(p @ diff) / pairs + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return {"mean": mean, "std": std, "w": w, "raw": z @ w}


def calibrate(model: dict, y: np.ndarray, share_bad: float) -> dict:
    """Puts the quantile of the scores below which ``share_bad`` of the labelled documents lie at THRESHOLD."""
    if "const" in model:
        return model
    raw = model.pop("raw")
    weight = np.where(y == 0, share_bad / max(1, (y == 0).sum()), (1 - share_bad) / max(1, (y == 1).sum()))
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    k = min(len(order) - 1, int(np.searchsorted(below, share_bad)))
    at = raw[order[k]]
    rest = raw[order[k + 1 :]]
    at = (at + rest[0]) / 2 if len(rest) else at
    spread = max(1e-6, float(np.std(raw)))
    return model | {"at": float(at), "slope": 4 / spread}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    if "const" in model:
        return np.full(len(x), model["const"])
    raw = _widen(x, model["mean"], model["std"]) @ model["w"]
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip((raw - model["at"]) * model["slope"] + base, -30, 30)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows = [features(t) for t in batch.column("text").to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 5, held: int = 0) -> dict:
    """A model fitted outside the held-out fold on at most ``per_class`` labelled rows of either class."""
    known = labels.where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id").cast("long"), mod) != held))
    count = {r["quality"]: r["count"] for r in known.groupBy(F.col("quality").cast("int").alias("quality")).count().collect()}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"],
            )

    sample = label_sample(docs, labels, "quality", mod, held, per_class)
    rows = sample.mapInArrow(gather, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.sort_values("doc_id")
    y = rows["y"].to_numpy(dtype=np.int64)
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), N_FEATURES)
    share_bad = count.get(0, 0) / max(1, sum(count.values()))
    model = fit(x, y)
    if "const" in model:
        return {"const": 1 - share_bad}
    return calibrate(model, y, share_bad)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(apply(model, _matrix(b)), pa.float64())], names=["doc_id", "score"]
                )

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the classifier accepts.

    The rows pass through the scoring function with their columns, so nothing is joined or shuffled.
    """
    model = train(docs, labels)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(apply(model, _matrix(b)) >= THRESHOLD))

    return docs.mapInArrow(run, schema)

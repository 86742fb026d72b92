"""Toxicity by Levenshtein automata over a lexicon trie, with scores of context windows.

The lexicon is learned from labelled documents: words, and beginnings of words, that occur in a far larger
share of the toxic ones, too often for chance. A text's distinct words are matched against it: the states of the Levenshtein
automaton of a word (position, edits left) walk the trie of lexicon words, so a misspelled term is found
with at most one edit, and two from nine letters on; beginnings match as they are. A hit inside quotation
marks within ``WINDOW`` words counts as quoted. The densest window, the density of hits of either kind,
the number of terms and the quoted share are the features of a logistic regression. Its score is shifted
such that the cut that divides the training documents best lies at ``THRESHOLD``.

Labels of the fold left out are never read. Null and empty texts have no hits and get the score of a text
without any. Without labels of both classes every score is the share of toxic labels (0 without any).
Repeated rows are scored one by one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import crc_mod, cut, label_sample, shuffle_width, texts

THRESHOLD = 0.3
#: Labelled rows of either class that the fit may use.
PER_CLASS = 5000
#: The least ratio of an entry's shares of toxic and of other documents; the least share of toxic documents
#: that have it; the least log-likelihood ratio against chance. These alone decide what is in the lexicon.
LIFT, SHARE, CHANCE = 6.0, 0.015, 30.0
WINDOW = 8
PREFIXES = range(3, 9)
_CACHE = 300_000
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Characters that stand for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_OPEN, _CLOSE = "\"“”„«‘'", "\"”“»’'"


def normal(word: str) -> str:
    """A word without marks at its edges, in lower case, look-alikes replaced."""
    word = _EDGE.sub("", word.lower())
    return word if word.isalpha() else "".join(_LETTERS.findall(word.translate(_LEET)))


class Lexicon:
    """Words matched with edits, and beginnings matched exactly, with their weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        #: Words that look like misspelled ones but stand in documents that are not toxic.
        self.clean: set[str] = set()
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        #: Of edits + 1 parts of a word one is untouched, so each part has a trie of the words that have it,
        #: and a word of a text walks the tries of its own parts alone.
        self.heads: dict[str, dict] = {}
        self.tails: dict[str, dict] = {}
        self.inner: dict[str, dict] = {}
        for w in words:
            parts = self.edits(w) + 1
            if parts > 1:
                n = len(w) // parts
                self._insert(self.heads, w[:n], w)
                self._insert(self.tails, w[(parts - 1) * n :], w)
                for k in range(1, parts - 1):
                    self._insert(self.inner, w[k * n : (k + 1) * n], w)
        self.head_sizes = sorted({len(h) for h in self.heads})
        self.tail_sizes = sorted({len(t) for t in self.tails})
        self.inner_sizes = sorted({len(t) for t in self.inner})

    @staticmethod
    def _insert(tries: dict[str, dict], part: str, word: str) -> None:
        node = tries.setdefault(part, {})
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def tries(self, word: str) -> list[dict]:
        """The tries that hold every lexicon word within its edits of ``word``."""
        found = [self.heads.get(word[:n]) for n in self.head_sizes]
        found += [self.tails.get(word[-n:]) for n in self.tail_sizes]
        found += [self.inner.get(word[k : k + n]) for n in self.inner_sizes for k in range(max(1, n - 2), n + 3)]
        return [t for t in found if t is not None]

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def near(self, word: str) -> tuple[str, int] | None:
        """The lexicon word reached with the fewest edits that its length allows."""
        best: tuple[int, str] | None = None
        most = 0 if len(word) < 4 else 1 if len(word) < 7 else 2
        seen: set[tuple[int, int, int]] = set()
        todo = [(trie, 0, 0) for trie in self.tries(word)]
        while todo:
            node, i, used = todo.pop()
            state = (id(node), i, used)
            if state in seen:
                continue
            seen.add(state)
            end = node.get("")
            if end is not None:
                total = used + len(word) - i
                if total <= self.edits(end) and (best is None or (total, end) < best):
                    best = (total, end)
            if i < len(word) and (nxt := node.get(word[i])) is not None:
                todo.append((nxt, i + 1, used))
            if used < most:
                if i < len(word):
                    todo.append((node, i + 1, used + 1))
                for c, child in node.items():
                    if c:
                        todo.append((child, i, used + 1))
                        if i < len(word):
                            todo.append((child, i + 1, used + 1))
        return (best[1], best[0]) if best else None

    def match(self, raw: str) -> tuple[int, float, str] | None:
        """Kind (0 exact, 1 misspelled, 2 beginning), weight and entry of a word of a text."""
        word = normal(raw)
        if len(word) < 3:
            return None
        if (w := self.words.get(word)) is not None:
            return 0, w, word
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return 2, w, word[:n]
        if word not in self.clean and (hit := self.near(word)):
            return 1, self.words[hit[0]] * 0.8 ** hit[1], hit[0]
        return None


class Scanner:
    """Features of texts under a lexicon, with a memory of the words seen."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, float, str] | None] = {}

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        known = self.known
        distinct = set(words)
        if len(known) > _CACHE:
            known.clear()
        for w in distinct:
            if w not in known:
                known[w] = self.lexicon.match(w)
        terms = [w for w in distinct if known[w] is not None]
        n = len(words)
        if not terms:
            return [0.0] * (N_FEATURES - 1) + [np.log1p(n)]
        wanted = set(terms)
        hits = [(i, *known[w]) for i, w in enumerate(words) if w in wanted]
        kinds = Counter(h[1] for h in hits)
        weights = np.array([h[2] for h in hits])
        at = np.array([h[0] for h in hits])
        total = np.concatenate([[0.0], np.cumsum(weights)])
        dense = (total[np.searchsorted(at, at + 2 * WINDOW, "right")] - total[:-1]).max()
        quoted = sum(self._quoted(words, i) for i in at.tolist())
        per = 100 / max(25, n)
        return [
            np.log1p(kinds[0] * per),
            np.log1p(kinds[1] * per),
            np.log1p(kinds[2] * per),
            np.log1p(weights.sum() * per),
            np.log1p(dense),
            float(weights.max()),
            np.log1p(len(hits)),
            np.log1p(len({h[3] for h in hits})),
            quoted / len(hits),
            np.log1p((len(hits) - quoted) * per),
            float(kinds[0] > 0),
            np.log1p(n),
        ]

    @staticmethod
    def _quoted(words: list[str], i: int) -> bool:
        before = words[max(0, i - WINDOW) : i + 1]
        after = words[i : i + WINDOW + 1]
        opens = any(w[0] in _OPEN and not (len(w) > 1 and w.rstrip(".,;:!?")[-1:] in _CLOSE and k < len(before) - 1) for k, w in enumerate(before))
        return opens and any(w.rstrip(".,;:!?")[-1:] in _CLOSE and len(w.rstrip(".,;:!?")) > 1 for w in after)


N_FEATURES = 12


def _surprise(t: int, n: int, toxic: int, other: int) -> float:
    """Twice the log-likelihood ratio of the two shares against one share."""
    both = (t + n) / (toxic + other)
    cells = ((t, toxic * both), (n, other * both), (toxic - t, toxic * (1 - both)), (other - n, other * (1 - both)))
    return 2 * sum(x * np.log(x / e) for x, e in cells if x > 0 and e > 0)


def choose(counts: list[tuple[str, bool, int, int]], toxic: int, other: int) -> Lexicon:
    """The lexicon from (entry, whether a whole word, toxic documents, other documents)."""
    scored = []
    for term, whole, t, n in counts:
        lift = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (other + 1))
        if lift >= np.log(LIFT) and t >= SHARE * toxic and _surprise(t, n, toxic, other) >= CHANCE:
            scored.append((t * lift, whole, len(term), term, t, float(min(6.0, lift))))
    scored.sort(key=lambda x: (-x[0], not x[1], -x[2], x[3]))
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    taken: list[tuple[str, int, float]] = []
    for _, whole, _, term, t, lift in scored:
        # An entry that a chosen one already stands for adds nothing.
        if not whole and any(x.startswith(term) and n >= 0.8 * t for x, n, _ in taken):
            continue
        if any(term.startswith(x) and x in stems and (whole or lift < l + 0.7) for x, _, l in taken):
            continue
        (words if whole else stems)[term] = lift
        taken.append((term, t, lift))
    return Lexicon(words, stems)


def _entry_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain = lru_cache(_CACHE)(normal)
    for b in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            words = set(map(plain, set((t or "").split())))
            entries = {"=" + w for w in words if len(w) >= 3}
            entries.update(w[:k] for w in words for k in PREFIXES if len(w) > k)
            counts[y].update(entries)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
            names=["term", "t", "n"],
        )


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From (text, y) rows. The entries that pass come to the driver: each is in SHARE of the toxic rows of the bounded sample."""
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = size.get(1, 0), size.get(0, 0)
    counts = sample.select("text", "y").mapInArrow(_entry_counts, "term string, t long, n long")
    lift = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (other + 1))
    rows = (
        counts.groupBy("term")
        .agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        .where(F.col("t") >= max(3.0, SHARE * toxic))
        .withColumn("lift", lift)
        .where(F.col("lift") >= float(np.log(LIFT)))
        .collect()
    )
    return choose([(r["term"].removeprefix("="), r["term"].startswith("="), r["t"], r["n"]) for r in rows], toxic, other)


def learn_clean(sample: DataFrame, lexicon: Lexicon) -> set[str]:
    """Words near a lexicon word that two or more documents of the bounded sample that are not toxic have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lru_cache(_CACHE)(lexicon.match)
        for b in batches:
            found = Counter()
            for t in b.column("text").to_pylist():
                found.update({normal(w) for w in set((t or "").split()) if (hit := match(w)) and hit[0] == 1})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    words = sample.where("y = 0").select("text").mapInArrow(run, "word string, n long")
    rows = words.groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2").collect()
    return {r["word"] for r in rows}


def misspelled(x: np.ndarray) -> np.ndarray:
    """The rows with exact hits once more, as if each were one edit away."""
    out = x[x[:, 0] > 0].copy()
    out[:, 1] = np.log1p(np.expm1(out[:, 1]) + np.expm1(out[:, 0]))
    out[:, 0] = out[:, 10] = 0
    out[:, 3:5] = np.log1p(0.8 * np.expm1(out[:, 3:5]))
    out[:, 5] *= 0.8
    return out


def _feature_rows(lexicon) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for b in batches:
            x = [scanner.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    return run


def _widen(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / std, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, z * z / 6])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Logistic regression by Newton's method, and the cut of best F1 on what it was fitted on."""
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-9] = 1.0
    z = _widen(x, mean, std)
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(-raw, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.r_[np.diff(raw[order]) != 0, True]
    best = int(np.argmax(np.where(last, f1, -1)))
    low = raw[order][best + 1] if best + 1 < len(raw) else raw[order][best] - 2
    return {"mean": mean, "std": std, "w": w, "at": float((raw[order][best] + low) / 2)}


def apply(model: dict, x: np.ndarray) -> np.ndarray:
    if "const" in model:
        return np.full(len(x), model["const"])
    raw = _widen(x, model["mean"], model["std"]) @ model["w"] - model["at"]
    return 1 / (1 + np.exp(-np.clip(raw + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, mod: int = 4, held: int = 2) -> tuple[Lexicon, dict]:
    """Lexicon and model from at most ``per_class`` labelled rows of either class outside the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id").cast("long"), mod) != held))
    count = {r["y"]: r["count"] for r in known.groupBy(F.col("toxic").cast("int").alias("y")).count().collect()}
    # Dealt to as many files as a shuffle has partitions: the bounded sample is small, but its words cost time.
    dealt = label_sample(docs, labels, "toxic", mod, held, per_class).repartition(shuffle_width(docs.sparkSession), "doc_id")
    sample = cut(dealt)
    lexicon = learn_lexicon(sample)
    lexicon.clean = learn_clean(sample, lexicon)
    rows = sample.mapInArrow(_feature_rows(lexicon), "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    y = rows["y"].to_numpy(dtype=np.float64)
    share = count.get(1, 0) / max(1, sum(count.values()))
    if not len(y) or y.min() == y.max():
        return lexicon, {"const": share}
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    x = np.array(rows["x"].tolist())
    # Few labelled documents are misspelled, so toxic ones stand in for their misspelled forms too.
    more = misspelled(x[y == 1])
    rest = np.full(len(more), 0.25 * share / y.mean())
    return lexicon, fit(np.vstack([x, more]), np.r_[y, np.ones(len(more))], np.r_[weight, rest])


def score(docs: DataFrame, lexicon: Lexicon, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(lexicon)
        for b in batches:
            if b.num_rows:
                x = np.array([scanner.features(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(apply(model, x), pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    return score(docs, *train(docs, labels)).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

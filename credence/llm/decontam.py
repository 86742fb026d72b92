"""Benchmark decontamination: a BM25 index of test items searched with block-max WAND, then verified.

The index holds the test items; every passage of every training document is a query. A passage has
``PASSAGE`` words, or twice the longest item's, and passages overlap by the longest item, so that each
copy of an item lies in one whole. Items are sorted into blocks by their words. For a passage, the sum of
its terms' greatest impacts in a block bounds every score there, and a block is skipped when that bound is
below the least threshold of its items. In the blocks that are left WAND walks the postings: the pivot is
the first item at which the bounds of the lists up to it reach the threshold, lists before it skip there,
and only pivots are scored.

An item's threshold is the least score that a passage can have that holds ``OVERLAP`` of the item's
``GRAM``-word shingles: the item's score less the most impact that words can have which together stand in
no more shingles than may be missing. Nothing that verification would accept is lost. A pair is verified if
the passage holds OVERLAP of the item's shingles, and ``PART`` of the shingles of its question (all but the
last sentence) and of the words of its answer (the last sentence, if there are several).

The number of items, their mean and greatest length and the items that each word is in are counted over the
whole benchmark. It is then indexed in parts of ``PART_ITEMS``, which bound what is sent to a worker and
change nothing in the result: scores, passages and thresholds come from the counts of the whole.

Null and empty texts and items match nothing. A text of fewer words than GRAM, item or document, has one
shingle, all its words; so a short item is found where it is a whole document, and not inside longer ones.
Equal items are reported each. Rows without a doc_id keep a null doc_id. Repeated rows give repeated results.
Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import cut, texts

PASSAGE = 128
GRAM = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCKS = 100
#: Least share of a question's shingles, and of an answer's words, that a passage with OVERLAP must hold.
PART = 0.5
#: Items to one part of the index; a part is sent to every worker.
PART_ITEMS = 20_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def most_lost(impacts: list[float], spare: int) -> float:
    """The greatest sum of impacts of words that stand in at most ``spare`` shingles of a text together.

    best[v] is that sum for words up to a position of which the last chosen one is, with v shingles void.
    """
    shingles_of = len(impacts) - GRAM + 1
    if spare <= 0 or shingles_of < 1:
        return 0.0
    rows: list[np.ndarray] = []
    far = np.full(spare + 1, -np.inf)  # over all last positions at least GRAM back, or none
    far[0] = 0.0
    top = 0.0
    for j, impact in enumerate(impacts):
        if j >= GRAM:
            far = np.maximum(far, rows[j - GRAM])
        row = np.full(spare + 1, -np.inf)
        last = min(j, shingles_of - 1)
        for back in range(1, GRAM + 1):
            before = far if back == GRAM else rows[j - back] if j >= back else None
            if before is None:
                continue
            # Shingles that hold word j but not the last chosen word.
            fresh = max(0, last - max(j - GRAM + 1, 0, 0 if back == GRAM else j - back + 1) + 1)
            if fresh <= spare:
                row[fresh:] = np.maximum(row[fresh:], before[: spare + 1 - fresh] + impact)
        rows.append(row)
        top = max(top, float(row.max()))
    return top


class Counts(NamedTuple):
    """What BM25 takes of the whole benchmark: items with words, their mean and greatest length, items by word."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


def counts_of(items: list[tuple[int, str]]) -> Counts:
    """The counts of items that are the whole benchmark."""
    words = [w for _, t in items if (w := words_of(t))]
    df = Counter(t for w in words for t in set(w))
    return Counts(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=0), dict(df))


class Index:
    """Postings by block, with the greatest impact of each term in each block, of some items of a benchmark."""

    def __init__(self, items: list[tuple[int, str]], counts: Counts | None = None) -> None:
        counts = counts or counts_of(items)
        known = [(i, t, w) for i, t in items if (w := words_of(t))]
        known.sort(key=lambda x: (x[2], x[0]))  # alike items share a block
        self.ids = [i for i, _, _ in known]
        self.words = [w for _, _, w in known]
        self.shingles = [shingles(w) for w in self.words]
        self.parts = []
        for _, text, w in known:
            tail = words_of(_SENTENCE.split(text.strip())[-1])
            cut = len(w) - len(tail) if 0 < len(tail) < len(w) else len(w)
            self.parts.append((shingles(w[:cut]), set(w[cut:])))
        n = len(known)
        self.longest = counts.longest
        self.size = max(1, -(-n // BLOCKS))
        self.n_blocks = -(-n // self.size)
        df, mean = counts.df, counts.mean
        self.term = {t: k for k, t in enumerate(sorted(set().union(*self.words)))}
        self.best = np.zeros((len(self.term) + 1, self.n_blocks), dtype=np.float32)  # last row: unknown words
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in range(self.n_blocks)]
        self.least = np.zeros(n)
        for d, w in enumerate(self.words):
            b, impacts = d // self.size, {}
            for t in sorted(set(w)):
                tf = w.count(t)
                idf = np.log(1 + (counts.items - df[t] + 0.5) / (df[t] + 0.5))
                s = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean)))
                k = self.term[t]
                self.postings[b].setdefault(k, []).append((d, s))
                self.best[k, b] = max(self.best[k, b], s)
                impacts[t] = s
            total = len(self.shingles[d])
            spare = total - int(np.ceil(OVERLAP * total - 1e-9))
            if total == len(w) - GRAM + 1:
                lost = most_lost([impacts[t] for t in w], spare)
            else:  # some shingle stands twice: any words at all
                lost = sum(sorted(impacts.values(), reverse=True)[:spare])
            self.least[d] = sum(impacts.values()) - lost
        self.block_least = np.array([self.least[b * self.size : (b + 1) * self.size].min() for b in range(self.n_blocks)], dtype=np.float32)

    def wand(self, b: int, terms: list[int]) -> list[tuple[int, float]]:
        """(item, score) of the items of block ``b`` whose score reaches their threshold."""
        post = self.postings[b]
        lists = [(post[t], float(self.best[t, b])) for t in terms if t in post]
        at = [0] * len(lists)
        theta = float(self.block_least[b]) - 1e-6
        out = []
        while True:
            live = sorted((lists[k][0][at[k]][0], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            bound, pivot = 0.0, -1
            for d, k in live:
                bound += lists[k][1]
                if bound >= theta:
                    pivot = d
                    break
            if pivot < 0:
                return out
            if live[0][0] == pivot:
                score = 0.0
                for d, k in live:
                    if d != pivot:
                        break
                    score += lists[k][0][at[k]][1]
                    at[k] += 1
                if score >= self.least[pivot] - 1e-6:
                    out.append((pivot, score))
            else:
                for d, k in live:
                    if d >= pivot:
                        break
                    while at[k] < len(lists[k][0]) and lists[k][0][at[k]][0] < pivot:
                        at[k] += 1

    def search(self, words: list[str]) -> list[tuple[int, int, float, float, float, float]]:
        """(item, first word of the passage, score, overlap, question, answer) of each verified item, its best passage."""
        n = len(words)
        if not n or not self.ids:
            return []
        get, none = self.term.get, len(self.term)
        ids = np.fromiter(map(get, words, repeat(none)), dtype=np.int64, count=n)
        size = max(PASSAGE, 2 * self.longest)
        # The words of the index, with the place where each stood last: a word counts once in a passage.
        at = np.flatnonzero(ids < none)
        ids = ids[at]
        order = np.argsort(ids, kind="stable")
        again = ids[order][1:] == ids[order][:-1]
        before = np.full(len(ids), -1, dtype=np.int64)
        before[order[1:][again]] = at[order[:-1][again]]
        best: dict[int, tuple] = {}
        for s in range(0, max(1, n - self.longest + 1), size - self.longest):
            e = min(s + size, n)
            i, j = np.searchsorted(at, (s, e))
            terms = ids[i:j][before[i:j] < s]
            bound = self.best[terms].sum(axis=0) + 1e-3
            hot = np.flatnonzero(bound >= self.block_least)
            if not len(hot):
                continue
            grams = None
            for d, score in (x for b in hot.tolist() for x in self.wand(b, terms.tolist())):
                if grams is None:
                    inside = words[s:e]
                    # A short end of a longer document is no shingle of it.
                    grams = shingles(inside) if e - s >= GRAM or e - s == n else set()
                    single = set(inside)
                mine = self.shingles[d]
                share = len(mine & grams) / len(mine)
                if share < OVERLAP:
                    continue
                question, answer = self.parts[d]
                q = len(question & grams) / len(question) if question and len(next(iter(question))) == GRAM else 1.0
                a = len(answer & single) / len(answer) if answer else 1.0
                if q >= PART and a >= PART and (d not in best or (share, score) > (best[d][3], best[d][2])):
                    best[d] = (d, s, score, share, q, a)
        return [best[d] for d in sorted(best)]


def _matches(index) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for d, *rest in own.search(words_of(t)):
                    for col, v in zip(out, (i, own.ids[d], *rest), strict=True):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "item_id", "passage_start", "score", "overlap", "question_overlap", "answer_overlap"]
_SCHEMA = "doc_id long, item_id long, passage_start long, score double, overlap double, question_overlap double, answer_overlap double"


def count_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, Counts]:
    """(item_id, text) of the items with a text, (term, df) over all of them, and the other counts."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([sorted(set(w)) for w in words], kind), pa.array(list(map(len, words)), pa.int64())], names=["terms", "n"])

    sized = cut(items.select("text").mapInArrow(run, "terms array<string>, n long").where("n > 0"))
    n, total, longest = sized.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    df = cut(sized.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    return items, df, Counts(n, total / max(1, n), longest, {})


def indexes(benchmark: DataFrame, part_items: int = PART_ITEMS) -> Iterator[Index]:
    """The benchmark in indexes of about ``part_items`` items; only one part is held at a time."""
    items, df, counts = count_items(benchmark)
    parts = max(1, -(-counts.items // part_items))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        rows = [(r["item_id"], r["text"]) for r in dealt.where(F.col("part") == part).collect()]
        mine = {t for _, text in rows for t in words_of(text)}
        if parts == 1:
            known = {r["term"]: r["df"] for r in df.collect()}
        else:
            own = df.sparkSession.createDataFrame([(t,) for t in sorted(mine)], "term string")
            known = {r["term"]: r["df"] for r in df.join(own, "term", "left_semi").collect()} if mine else {}
        yield Index(rows, counts._replace(df=known))


def contaminated(docs: DataFrame, benchmark: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """One row for each document and test item that a passage of it holds."""
    spark = docs.sparkSession
    out = None
    for index in indexes(benchmark, part_items):
        found = texts(docs).mapInArrow(_matches(spark.sparkContext.broadcast(index)), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, no passage of which holds a test item."""
    for index in indexes(benchmark, part_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.search(words_of(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

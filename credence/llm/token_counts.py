"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters without white space, after a word mark (U+2581). A public vocabulary
gives the pieces; a piece of merge rank r has the unigram log probability -ln(r + 1) less a constant, and
a character without a piece costs one token for each of its UTF-8 bytes. The forward score of a prefix is
that of its best segmentation, the fewest tokens breaking ties.

The distinct pre-tokens of a batch, sorted, are their trie in depth-first order: the walk keeps scores of
the current path only, so every shared prefix is scored once, and stores the count of tokens where a
pre-token ends. A text's count is the sum over its pre-tokens. Nothing is shuffled.

Null and empty texts have no tokens. Repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from credence.llm._common import texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Counts that a worker keeps from batch to batch.
CACHE = 200_000


def vocabulary(model: str = MODEL) -> dict[str, float]:
    """Log probability of each piece, by its merge rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class TrieCounter:
    """Counts tokens of sorted pre-tokens, scoring each shared prefix once."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.byte = min(pieces.values(), default=0.0) - 10.0
        self.steps = 0
        #: Pieces read backwards: the pieces that end at a character are one walk from it.
        self.ending: dict = {}
        for piece, p in pieces.items():
            node = self.ending
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = p

    def counts(self, words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        ending = self.ending
        best, fewest = [0.0], [0]
        path = ""
        for word in sorted(words):
            full = MARK + word
            depth, top = 0, min(len(path), len(full))
            while depth < top and path[depth] == full[depth]:
                depth += 1
            del best[depth + 1 :], fewest[depth + 1 :]
            for k in range(depth, len(full)):
                score, count, start, node = None, 0, k, ending
                while start >= 0 and (node := node.get(full[start])) is not None:
                    p = node.get("")
                    if p is not None:
                        s, c = best[start] + p, fewest[start] + 1
                        if score is None or s > score or s == score and c < count:
                            score, count = s, c
                    start -= 1
                if full[k] not in ending or "" not in ending[full[k]]:
                    n = len(full[k].encode("utf-8", "surrogatepass"))
                    s, c = best[k] + n * self.byte, fewest[k] + n
                    if score is None or s > score or s == score and c < count:
                        score, count = s, c
                best.append(score)
                fewest.append(count)
            self.steps += len(full) - depth
            out[word] = fewest[-1]
            path = full
        return out


def count_tokens(docs: DataFrame, pieces: dict[str, float] | None = None, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every row of ``docs``. The vocabulary is as large as its file."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(shared.value)
        known: dict[str, int] = {}
        for b in batches:
            rows = [(t or "").split() for t in b.column("text").to_pylist()]
            words = set().union(*rows)
            fresh = [w for w in words if w not in known]
            if len(known) + len(fresh) > CACHE:
                known, fresh = {}, list(words)
            known |= counter.counts(fresh)
            get = known.__getitem__
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([sum(map(get, r)) for r in rows], pa.int64()), pa.array(list(map(len, rows)), pa.int64())],
                names=["doc_id", "n_tokens", "n_pretokens"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, n_pretokens long")

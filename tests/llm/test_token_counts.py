import math
import os
import random

import pytest

from credence.llm.token_counts import MARK, MODEL, TrieCounter, count_tokens, vocabulary

PIECES = {MARK: -2.0, MARK + "a": -1.5, "a": -3.0, "b": -3.0, "ab": -2.5, "ba": -2.4, "aba": -4.1, "c": -3.5}


def brute(word, pieces, byte):
    """The best score and fewest tokens, by trying every segmentation."""
    full = MARK + word
    best = {len(full): (0.0, 0)}
    for i in range(len(full) - 1, -1, -1):
        options = []
        for j in range(i + 1, len(full) + 1):
            if full[i:j] in pieces:
                options.append((best[j][0] + pieces[full[i:j]], best[j][1] + 1))
        if full[i] not in pieces:
            n = len(full[i].encode())
            options.append((best[i + 1][0] + n * byte, best[i + 1][1] + n))
        best[i] = max(options, key=lambda o: (round(o[0], 9), -o[1]))
    return best[0][1]


def test_counts_equal_every_segmentation():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300)}
    counter = TrieCounter(PIECES)
    assert counter.counts(list(words)) == {w: brute(w, PIECES, counter.byte) for w in words}


def test_shared_prefixes_are_scored_once():
    counter = TrieCounter(PIECES)
    counter.counts(["abab", "ababa", "ababc"])
    assert counter.steps == 5 + 1 + 1


def test_rows(spark, odd, empty):
    got = count_tokens(odd, PIECES)
    assert got.columns == ["doc_id", "n_tokens", "n_pretokens"] and got.count() == odd.count()
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[3].n_tokens, rows[4].n_tokens, rows[5].n_tokens) == (0, 0, 0)
    assert rows[8].n_pretokens == 3000 and rows[9].n_pretokens == 20_000
    one = TrieCounter(PIECES).counts(["one", "two"])
    assert rows[7].n_tokens == one["one"] + one["two"]
    assert count_tokens(empty, PIECES).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_public_vocabulary():
    pieces = vocabulary()
    assert 30_000 < len(pieces) < 32_000 and math.isclose(sum(map(math.exp, pieces.values())), 1.0)
    counter = TrieCounter(pieces)
    words = ["the", "therefore", "thermal", "überall", "日本"]
    assert counter.counts(words) == {w: brute(w, pieces, counter.byte) for w in words}

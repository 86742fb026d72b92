import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from credence.llm import toxicity as T
from tests.llm.conftest import prose

TERMS = ["worthless", "pathetic", "stupid", "moron"]
LEXICON = T.Lexicon(dict.fromkeys(TERMS, 5.0), {"vilst": 3.0})


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("isdaoxz"), st.integers(0, 2)), max_size=3))
def test_automaton_equals_edit_distance(term, edits):
    word = term
    for at, c, kind in edits:
        at = min(at, len(word))
        word = word[:at] + (c if kind != 1 else "") + word[at + (kind != 0) :]
    if len(word) < 3:
        return
    want = min(((distance(word, t), t) for t in TERMS if distance(word, t) <= T.Lexicon.edits(t)), default=None)
    got = LEXICON.match(word)
    if want is None:
        assert got is None or got[0] == 2
    else:
        assert got is not None and (got[0] == 0) == (want[0] == 0)
        assert LEXICON.near(word) == (want[1], want[0])


def test_words_as_they_stand():
    assert LEXICON.match("STUPID!!")[0] == 0 and LEXICON.match("stup1d")[0] == 0 and LEXICON.match("stuupid,")[0] == 1
    assert LEXICON.match("vilsterung")[0] == 2 and LEXICON.match("fine") is None and LEXICON.match("") is None


def test_quotation_is_told_apart():
    scan = T.Scanner(LEXICON).features
    quoted, plain = scan('They wrote "you are a moron indeed" and were fined for it'), scan("They wrote you are a moron indeed and were fined for it")
    assert quoted[8] == 1.0 and plain[8] == 0.0 and quoted[9] < plain[9]
    assert scan(None) == scan("") == [0.0] * T.N_FEATURES


def corpus(spark):
    docs, labels = [], []
    for i in range(600):
        words = prose(i, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for k in range(3):
                words.insert(7 * k, TERMS[(i // 5 + k) % 4] if i % 10 else TERMS[(i // 5 + k) % 4][:-1] + "x")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents(spark, odd, empty):
    docs, labels = corpus(spark)
    d = spark.createDataFrame([*docs, (601, None), (602, ""), (None, "stupid moron"), (0, docs[0][1])], "doc_id long, text string")
    t = spark.createDataFrame([*labels, labels[0], (7, None), (None, 1)], "doc_id long, toxic int")
    got = T.classify(d, t).collect()
    assert len(got) == 604
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert {r.predicted for r in got if r.doc_id in (601, 602)} == {0}
    assert T.classify(odd, t).count() == odd.count() and T.classify(empty, t).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in T.classify(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, turned))
    assert a == b


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.classify(odd, none).collect()} == {0.0}


def test_features_equal_a_plain_count():
    """Densities, windows, quotes and terms of short texts, counted word by word."""
    text = 'You stupid, stupid moron! He said "you are worthless" and that vilsters are pathetlc people ' + "calm " * 40
    words = text.split()
    kinds, weights, quoted, terms = [0, 0, 0], [], 0, set()
    for i, w in enumerate(words):
        plain = w.strip('",!.').lower()
        near = [t for t in TERMS if distance(plain, t) <= T.Lexicon.edits(t)]
        if plain in TERMS:
            kind, weight, term = 0, 5.0, plain
        elif plain.startswith("vilst"):
            kind, weight, term = 2, 3.0, "vilst"
        elif near:
            kind, weight, term = 1, 5.0 * 0.8 ** distance(plain, near[0]), near[0]
        else:
            continue
        kinds[kind] += 1
        terms.add(term)
        weights.append((i, weight))
        opened = sum(x.count('"') for x in words[:i]) % 2 == 1 or w.startswith('"')
        quoted += opened
    n, per, total = len(words), 100 / len(words), sum(w for _, w in weights)
    dense = max(sum(w for j, w in weights if i <= j <= i + 2 * T.WINDOW) for i, _ in weights)
    want = [*(np.log1p(k * per) for k in kinds), np.log1p(total * per), np.log1p(dense), max(w for _, w in weights), np.log1p(len(weights)), np.log1p(len(terms))]
    want += [quoted / len(weights), np.log1p((len(weights) - quoted) * per), 1.0, np.log1p(n)]
    assert kinds == [4, 1, 1] and quoted == 1
    assert np.allclose(T.Scanner(LEXICON).features(text), want)

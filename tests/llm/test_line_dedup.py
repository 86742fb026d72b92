import random

from credence.llm.line_dedup import LENGTH, deduplicate, line_units, remove, repeats, with_offsets
from credence.llm.queries import op3_line_dedup
from tests.llm.conftest import ODD, prose

PASSAGE = prose(77, 63).replace("go", "Go")


def lost_words(docs):
    """Numbers of the words of each document that lie in a line or passage with an earlier place, by tables of all."""
    lines, passages, out = {}, {}, {}
    for i, t in sorted({d for d in docs if d[0] is not None and d[1]}):
        gone = out.setdefault(i, set())
        for at, n, d in line_units(t):
            if lines.setdefault(d, (i, at)) != (i, at):
                gone.update(range(at, at + n))
        w = t.lower().split()
        for p in range(len(w) - LENGTH + 1):
            j, q = passages.setdefault(tuple(w[p : p + LENGTH]), (i, p))
            if j != i or p - q >= LENGTH:
                gone.update(range(p, p + LENGTH))
    return out


def without(text, gone):
    """The text without the words of those numbers, word by word."""
    out, at = [], 0
    for line in text.split("\n"):
        words = line.split()
        rest = [w for k, w in enumerate(words) if at + k not in gone]
        if len(rest) == len(words):
            out.append(line)
        elif rest:
            out.append(" ".join(rest))
        at += len(words)
    return "\n".join(out)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def check(spark, docs):
    """The operator's texts and offsets against the tables of all lines and passages."""
    want = lost_words(docs)
    rows = {r.doc_id: r for r in with_offsets(frame(spark, docs)).collect()}
    assert len(rows) == len(docs)
    for i, t in docs:
        assert rows[i].text == without(t, want[i]), i
        assert rows[i].n_chars == len(rows[i].text)
        went = " ".join(t[x.start : x.end] for x in rows[i].removed).split()
        assert went == [w for k, w in enumerate(t.split()) if k in want[i]]
    return rows


def test_lines_are_units_whatever_their_length():
    text = "Ab.\n\n  One two\tthree. \n!!\nx"
    assert [(a, n) for a, n, _ in line_units(text)] == [(0, 1), (1, 3), (4, 1), (5, 1)]
    key = line_units("one two three")[0][2]
    assert line_units(text)[1][2] == key == line_units("ONE  two three...")[0][2]
    assert line_units("!!")[0][2] != line_units("!")[0][2]
    assert line_units("") == line_units(" \n ") == []


def test_remove():
    assert remove("ab cd.\nxy", [(0, 2)]) == ("xy", [(0, 6)])
    assert remove("ab  cd ef\n\nxy", [(1, 1)]) == ("ab ef\n\nxy", [(4, 6)])
    assert remove("ab cd\nef gh", [(1, 2), (2, 1)]) == ("ab\ngh", [(3, 8)])
    assert remove("ab", []) == ("ab", []) and remove("ab", [(0, 1)]) == ("", [(0, 2)])


def test_lines_and_passages_equal_brute_force(spark):
    docs = [(i, prose(i, 40) + (" " + PASSAGE + " " if i % 3 == 0 else "\nShort line.\n") + prose(100 + i, 30)) for i in range(30)]
    docs += [(40, PASSAGE), (41, PASSAGE + "\n" + PASSAGE), (42, "short LINE\n" + prose(42, 60))]
    rows = check(spark, docs)
    assert rows[0].text == docs[0][1] and rows[1].text == docs[1][1] and rows[40].text == ""
    assert rows[42].text == prose(42, 60)


def test_passages_that_start_and_end_inside_sentences(spark):
    plain = prose(500, 75).replace(".", "")
    near = prose(501, 200).split()
    docs = [(i, prose(i, 20 + i) + " x" + str(i) + " " + plain + " y" + str(i) + " " + prose(50 + i, 30)) for i in range(1, 6)]
    docs += [(10, " ".join(near)), (11, " ".join([*near[:90], "other", *near[91:]])), (12, " ".join(near[20:69])), (13, " ".join(near[100:150]))]
    docs += [(20, "Er " * 300), (21, prose(21, 40) + "\n" + " ".join(plain.split()[3:60]) + "\n" + prose(22, 20)), (22, prose(60, 10))]
    rows = check(spark, docs)
    assert rows[2].text == docs[1][1].replace(plain + " ", "")
    assert rows[13].text == "" and rows[12].text == docs[7][1]


def test_few_words_make_many_equal_and_overlapping_passages(spark):
    rng = random.Random(3)
    base = [rng.choice("ab") for _ in range(400)]
    docs = [(i, " ".join(base[rng.randrange(200) :][: rng.randrange(40, 200)])) for i in range(40)]
    docs += [(50, "a " * 49), (51, "a " * 130), (52, "a " * 99 + "b"), (53, "a b " * 80)]
    check(spark, docs)


def test_a_line_and_a_passage_that_a_third_of_all_documents_have(spark):
    docs = [(i, prose(i, 30) + ("\nOne line everywhere\n" + prose(900 + i, 6) + " " + PASSAGE + " " if i % 3 == 0 else " ") + prose(300 + i, 25)) for i in range(150)]
    check(spark, docs)


def test_row_order_and_partitions_do_not_matter(spark):
    docs = [(i, prose(i % 7, 70) + "\n" + prose(i, 20)) for i in range(40)] + [(5, prose(99, 60)), (5, prose(98, 60))]
    df = frame(spark, docs)
    a = sorted((r.doc_id, r.text) for r in deduplicate(df).collect())
    assert a == sorted((r.doc_id, r.text) for r in deduplicate(df.orderBy("text").repartition(7)).collect())


def test_odd_rows(odd, empty):
    got = deduplicate(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    # The copies of document 1 go, and rows that they are; rows of no id stay.
    ids = [r.doc_id for r in rows]
    assert ids.count(None) == 2 and ids.count(1) == 1 and 2 not in ids and {3, 4, 5, 6, 7, 9, 10} <= set(ids)
    ten = next(r for r in rows if r.doc_id == 10)
    assert ten.text == prose(10, 80) and ten.n_chars == len(ten.text)
    # 3,000 times one word: all that does not overlap the first passage goes.
    assert next(r for r in rows if r.doc_id == 8).text == " ".join(["Er"] * 50)
    assert repeats(empty).count() == with_offsets(empty).count() == deduplicate(empty).count() == 0


def test_columns_may_have_the_names_used_inside(spark):
    docs = spark.createDataFrame(
        [(1, PASSAGE, 1, 2, "a", 3, 4), (2, "x " + PASSAGE, 1, 2, "a", 3, 4)],
        "doc_id int, text string, __id int, __tag int, __spans string, row int, spans int",
    )
    got = deduplicate(docs)
    assert got.schema == docs.schema
    assert sorted((r.doc_id, r.text, r["__spans"], r.row) for r in got.collect()) == [(1, PASSAGE, "a", 3), (2, "x", "a", 3)]


def test_query_takes_odd_rows(odd, spark, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_line_dedup(spark, str(tmp_path))
    assert rows.columns == ["doc_id", "text", "n_chars", "removed"]
    got = rows.collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is None or r.doc_id in (3, 4, 5, 6, 7, 9):
            assert (r.doc_id, r.text) in ODD and r.removed == ""
    assert {(r.text, r.removed) for r in got if r.doc_id == 2} == {("", f"0-{len(prose(1, 120))}")}

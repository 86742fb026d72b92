import corpus_pipeline
from credence.llm import decontam, packing, quality, simhash, token_counts
from credence.llm.queries import QUERIES
from tests.llm.conftest import ODD, prose
from tests.llm.test_line_dedup import lost_words, without

DIR = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage against a plain version of its decision on its own input."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    first = corpus_pipeline.quality_stage(spark, docs, DIR)
    accepted = quality.classify(docs, spark.read.parquet(f"{DIR}/labels.parquet")).where("predicted = 1").select("doc_id")
    assert first.columns == columns
    first_ids = {r.doc_id for r in first.select("doc_id").collect()}
    assert first_ids == {r.doc_id for r in accepted.collect()} and 0 < len(first_ids) < docs.count()

    second = corpus_pipeline.near_dedup_stage(spark, first, DIR)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in first.collect()}
    kept = {r.doc_id for r in second.collect()}
    least = dict.fromkeys(prints)
    for i in least:
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            more = {j for j in prints if j not in group and (prints[a] ^ prints[j]).bit_count() <= 3}
            group |= more
            todo += more
        least[i] = min(group)
    assert kept == {i for i, m in least.items() if i == m}

    third = corpus_pipeline.substring_dedup_stage(spark, second, DIR)
    assert third.columns == columns
    before = sorted((r.doc_id, r.text) for r in second.collect())
    lost, want = lost_words(before), {}
    for i, t in before:
        rest = without(t, lost.get(i, set()))
        if rest.strip() or not lost.get(i):
            want[i] = rest
    assert {r.doc_id: r.text for r in third.collect()} == want

    fourth = corpus_pipeline.decontamination_stage(spark, third, DIR)
    bad = {r.doc_id for r in decontam.contaminated(third, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in fourth.collect()} == want.keys() - bad

    last = corpus_pipeline.packing_stage(spark, fourth, DIR)
    tokens = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(fourth).collect()}
    packed = {}
    for r in last.collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == tokens


def test_names():
    assert [n for n in QUERIES] == sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) and len(QUERIES) == 13
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert packing.CAPACITIES == tuple(sorted(packing.CAPACITIES))


def test_odd_rows_through_the_whole_chain(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns whose names operators use; then no rows at all."""
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (9, 1, None), (10, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, prose(10, 80)), (2, None), (None, "")], "item_id long, text string")
    for name, docs in (("odd", odd.unionByName(odd)), ("empty", empty)):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        rest = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES[:-1]:
            rest = stage(spark, rest, folder)
            assert rest.columns == docs.columns, step
            rest.write.parquet(f"{folder}/{step}")
            rest = spark.read.parquet(f"{folder}/{step}")
        last = corpus_pipeline.run(spark, folder).collect()
        kept = {(r.doc_id, r.text) for r in rest.collect()}
        assert {r.doc_id for r in last} == {i for i, _ in kept}
        if name == "empty":
            assert not last
        else:
            assert all(i != 10 and (i is None or t == dict(ODD)[i]) for i, t in kept) and (2, prose(1, 120)) not in kept


def test_near_dedup_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, prose(1, 60), "a"), (1, prose(2, 60), "b"), (1, prose(1, 60), "c"), (2, prose(1, 60), "d"), (3, prose(2, 60), "e"), (None, prose(1, 60), "f")]
    got = [
        sorted(map(str, simhash.keep_one(spark.createDataFrame(x, "doc_id long, text string, source string").repartition(n)).collect()))
        for x, n in ((rows, 1), (rows[::-1], 3), (rows[2:] + rows[:2], 2))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 3
    assert {t for r in got[0] for t in (prose(1, 60), prose(2, 60)) if t in r} == {prose(1, 60), prose(2, 60)}

import corpus_pipeline
from driftline.llm import minhash, quality, secrets, substring

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        path = corpus_pipeline.materialize(docs, "test")
        seen.append((before, path))
        docs = path
        if k < 4:
            assert docs.columns == names
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for _, d in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and ids[0] and ids[-1] == ids[-2]
    # quality: exactly the rows that fail no rule
    assert ids[0] == {r["doc_id"] for r in quality.passing(seen[0][0], quality.RULES).collect()}
    # near duplicates: the smallest of each group
    assert ids[1] == {r["doc_id"] for r in minhash.near_duplicates(seen[1][0]).where("kept").collect()}
    # passages: nothing of fifty words repeats afterwards but by a cut that joins two ends
    spans = substring.repeated_passages(seen[2][0]).collect()
    words = lambda d: {r["doc_id"]: len(r["text"].encode().split()) for r in d.collect()}
    was, now = words(seen[2][0]), words(seen[2][1])
    assert {i for i in now if now[i] < was[i]} == {r["doc_id"] for r in spans} & set(now)
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2][1].collect())
    # secrets: none are left
    assert all(secrets.mask(r["text"]) == r["text"] for r in seen[3][1].collect())


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in __spark_entry__.oracle_sql()


def test_rows_without_an_id_and_repeated_ones_stay(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(70))
    rows = [(None, text(1)), (None, text(2)), (None, None), (1, text(3)), (2, text(4)), (2, text(4)), (3, text(3))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        d = stage(spark, d, "")
    got = sorted(((r["doc_id"], r["text"]) for r in d.collect()), key=str)
    assert got == sorted(rows[:6], key=str)

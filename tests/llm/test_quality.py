import random

import duckdb
import pytest

from driftline.llm import quality

SCHEMA = "doc_id long, text string, n_words string, _row int, _text double"


def brute(text):
    t = text or ""
    words = [w for w in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = random.Random(5)
    some = ["", None, " ", "\n\n", "one", "a b", "a b c a b c", "x " * 3000, "a a a a", "é ü\t\x0b\x0c\rz", "l\nl\n \nl x\n", "#*$%&|<>" * 9, "WORD! " * 80]
    some += [" ".join(rng.choice("abcd") + rng.choice("xyz") for _ in range(n)) for n in (3, 10, 60, 400)]
    some += ["A plain sentence about the river and the town, one of many.\n" * 2 + " ".join(f"word{i}" for i in range(n)) for n in (10, 60, 5000)]
    rows = [(i, t, "clash", 1, 0.5) for i, t in enumerate(some)] + [(100, "a b c", "again", 1, 0.5), (100, "a b c", "again", 1, 0.5)]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_counts_and_sql(spark, docs):
    path, rows = docs
    got = quality.op1_quality(spark, path).collect()
    want = sorted((r[0], *brute(r[1])) for r in rows)
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    sql = con.execute(quality.OP1_SQL).fetchall()
    names = [c[0] for c in con.description]
    assert sorted(sql) == sorted(tuple(r[n] for n in names) for r in got)


def test_order_does_not_change_the_verdict(spark, docs):
    d = spark.read.parquet(f"{docs[0]}/documents.parquet")
    one = {r["doc_id"] for r in quality.passing(d, quality.RULES).collect()}
    two = {r["doc_id"] for r in quality.passing(d, quality.RULES[::-1]).collect()}
    kept = quality.apply_rules(d)
    assert one == two == {r["doc_id"] for r in kept.collect()}
    assert kept.columns == d.columns
    assert quality.apply_rules(d.limit(0)).count() == 0


def test_cascade_order():
    measured = [{"rule": "a", "cost": 1.0, "selectivity": 0.1}, {"rule": "b", "cost": 0.1, "selectivity": 0.05}, {"rule": "c", "cost": 1.0, "selectivity": 0.0}]
    assert quality.cascade_order(measured) == ["b", "a", "c"]


def test_plan_has_no_python(spark, docs):
    plan = quality.op1_quality(spark, docs[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

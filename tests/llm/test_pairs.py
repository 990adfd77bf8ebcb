import random

import numpy as np
import pytest

from driftline.llm import ann, minhash, substring


def brute_components(texts, width=2):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    out = [None, "", "  ", "one", "One", "two words", "TWO\twords", "two words extra"]
    base = make(200)
    for k in range(80):  # a large group of near copies, few of which are near to all others
        w = list(base)
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    chain = make(120)
    for k in range(12):  # a chain: only neighbours are linked
        out.append(" ".join(chain))
        for _ in range(5):
            chain[rng.randrange(len(chain))] = rng.choice(words)
    shared = make(60)
    out += [" ".join(shared + make(60)) for _ in range(40)]  # a passage in common, no near copies
    out += [" ".join(make(5000))] * 3 + [" ".join(make(rng.randrange(1, 90))) for _ in range(60)]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(i, out[k]) for i, k in enumerate(order)]


def test_near_duplicates_against_brute_force(spark):
    texts = corpus()
    d = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, label string").repartition(3)
    got = minhash.near_duplicates(d, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)
    assert len(got) == len(texts) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    kept = minhash.deduplicate(d, 2)
    assert kept.columns == d.columns and kept.count() == len({c for _, c in brute_components(texts).values()})


def test_repeated_rows_and_rows_without_an_id(spark):
    rng = random.Random(21)
    text = " ".join(f"n{rng.randrange(9999)}" for _ in range(80))
    other = " ".join(f"m{rng.randrange(9999)}" for _ in range(60))
    rows = [(5, text), (5, text), (7, text + " end"), (9, other), (9, other), (None, text), (None, None), (3, "x " + other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(d, 2).where("doc_id IS NOT NULL").collect()))
    assert got == [(3, 3, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 3, False), (9, 3, False)]
    found = {(r["doc_id"], r["source_doc_id"], r["n_words"]) for r in substring.repeated_passages(d).collect()}
    assert found == {(7, 5, 80), (9, 3, 60)}
    v = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.1]), (1, [0.5, 0.1]), (2, [0.2, 0.2]), (None, [9.0, 9.0])]
    near = ann.search(spark.createDataFrame(v, "vec_id long, embedding array<double>"), "vec_id % 20 = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in near) == [(1, 1), (2, 2)]


def test_near_duplicates_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(d).count() == 0
    one = spark.createDataFrame([(3, None)], "doc_id long, text string")
    assert [tuple(r) for r in minhash.near_duplicates(one).collect()] == [(3, 0, 3, True)]


def test_pruning_spares_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4000, minhash.HASHES), dtype=np.uint8)
    near = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    far = np.where(rng.random(a.shape) < 0.4, a, rng.integers(0, 256, a.shape, dtype=np.uint8)).astype(np.uint8)
    assert len(minhash.survive(a, near, 0.8)) == len(a)
    assert len(minhash.survive(a, far, 0.8)) == 0
    assert minhash.expected_miss(0.8) < 1e-5


def near_group(n, words_in, changed, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(words_in)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words_in), changed + i % 2):
            w[k] = rng.choice(words)
        out.append((i, " ".join(w)))
    return out


def test_loose_groups_make_few_links(spark, monkeypatch):
    """Near copies around and just below the threshold: the links that leave the tasks stay below the members."""
    emitted = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: emitted.append(across(*a)) or emitted[-1])
    for n in (200, 400):
        texts = near_group(n, 200, 5, n)  # of 2-word shingles about 0.78 to 0.83
        d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, 2).collect()}
        assert got == brute_components(texts)
        assert not emitted or emitted.pop().count() < n


def test_blocks_and_buckets_give_the_same(spark, monkeypatch):
    texts = near_group(120, 80, 4, 5) + [(1000 + i, t) for i, t in near_group(60, 120, 6, 6)]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    want = brute_components(texts)
    for block, group in ((7, 10_000), (11, 5)):
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "GROUP", group)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(d, 2).collect()}
        assert got == want


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))).astype(np.uint64) for _ in range(60)]
    for at, to in ((np.arange(30), np.arange(30, 60)), [x.ravel() for x in np.indices((60, 60))]):
        want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(at, to)]
        assert minhash.common_counts(sets, sets, at, to).tolist() == want


def test_hot_keys_join_as_any_other(spark, monkeypatch):
    from driftline.llm import common

    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.createDataFrame([(k, i) for i in range(300) for k in ("hot", f"k{i % 40}", None)], "key string, id long")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "key string, v long")
    for how in ("inner", "left"):
        assert sorted(map(str, common.spread_join(rows, few, "key", "id", how).collect())) == sorted(map(str, rows.join(few, "key", how).collect()))


# ---- passages


def brute_windows(values, span):
    """All (l, c, r): c is the least of every stretch from l..c to c..r, and it can't be widened."""
    out = []
    for c, v in enumerate(values):
        l = r = c
        while l and values[l - 1] > v:
            l -= 1
        while r + 1 < len(values) and values[r + 1] > v:
            r += 1
        if r - l + 1 >= span:
            out.append((l, c, r))
    return out


def test_compact_windows():
    rng = np.random.default_rng(5)
    for n, span in ((0, 3), (2, 3), (3, 3), (50, 4), (300, 7)):
        order = (rng.permutation(n).astype(np.uint64) + np.uint64(1)) << np.uint64(24) | np.arange(n, dtype=np.uint64)
        got = list(zip(*(x.tolist() for x in substring.compact_windows(order, np.empty(0, np.int64), span))))
        assert got == brute_windows(order.tolist(), span)


def test_windows_cover_every_stretch():
    rng = np.random.default_rng(6)
    order = (rng.permutation(60).astype(np.uint64) + np.uint64(1)) << np.uint64(24) | np.arange(60, dtype=np.uint64)
    windows = list(zip(*(x.tolist() for x in substring.compact_windows(order, np.empty(0, np.int64), 5))))
    for i in range(60):
        for j in range(i + 4, 60):
            assert sum(l <= i <= c <= j <= r for l, c, r in windows) == 1


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    p, long = make(60), make(90)
    near = list(long)
    near[30] = "other"
    docs = [make(80) + p + make(40), p + make(70), make(10) + p, make(200), make(30) + long + make(30), near + make(50), make(49)]
    docs += [docs[3], docs[6], make(100)[:60] + p[:40], ["x"] * 300]
    docs += [make(20) + p + make(20) + p]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(docs)] + [(90, None, "s"), (91, "", "s")]
    return docs, spark.createDataFrame(rows, "doc_id long, text string, similarity string").repartition(3)


def test_repeated_passages(spark, passages):
    docs, d = passages
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["source_doc_id"], r["source_start"]) for r in substring.repeated_passages(d).collect()}
    assert {(1, 0, 60, 0, 80), (2, 10, 70, 0, 80), (7, 0, 200, 3, 0), (11, 20, 80, 0, 80), (11, 100, 160, 0, 80)} <= got
    near = [g for g in got if g[0] == 5]
    assert len(near) == 1 and near[0][1] == 0 and near[0][2] == 90 and near[0][3] == 4
    assert {g[0] for g in got} == {1, 2, 5, 7, 11}


def uncovered(rows, found):
    """Runs of 50 words that an earlier document holds too, but no passage found covers: (runs, of how many)."""
    covered, seen, lost, n = {}, {}, [], 0
    for r in found:
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    for i, text in sorted(rows):
        w = (text or "").encode().lower().split()
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k : k + 50]), i)
            if first != i:
                n += 1
                if not set(range(k, k + 50)) <= covered.get(i, set()):
                    lost.append((i, k))
    return lost, n


def test_exact_repeats_are_all_covered(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lost, n = uncovered([tuple(r) for r in d.collect()], substring.repeated_passages(d).collect())
    assert n and not lost


def sharing_triples(parts, seed, times):
    """A holds two parts of a passage that B and C hold whole; other documents hold edited variants of it."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(6000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    docs = []
    for _ in range(times):
        p = make(sum(parts))
        cut = parts[0]
        edited = list(p)
        for k in range(7, len(p), 14):
            edited[k] = "other"
        for x in (p[:cut], p[cut:] if parts[1] > 5 else p[-parts[0] :], edited, p, p):
            docs.append(make(rng.randrange(5, 40)) + x + make(rng.randrange(5, 40)))
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("hot", [1000, 0])
def test_parts_in_earlier_documents_hide_no_repeat(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_KEY", hot)
    rows = []
    for k, parts in enumerate([(40, 20), (47, 8), (30, 30), (49, 11)]):
        rows += [(10_000 * k + i, t) for i, t in sharing_triples(parts, k, 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lost, n = uncovered(rows, substring.repeated_passages(d).collect())
    assert n >= 50 * (11 + 6 + 11 + 11) and not lost


def test_texts_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(substring, "SEGMENT", 300)
    rng = random.Random(12)
    words = [f"s{i}" for i in range(9000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    a = make(1500)
    rows = [(1, " ".join(a)), (2, " ".join(make(100) + a[200:1300] + make(30))), (3, " ".join(make(77) + a[560:640]))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lost, n = uncovered(rows, found)
    assert n and not lost and {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} >= {(2, 100, 1200)}


def test_a_paragraph_repeated_in_a_row(spark):
    rng = random.Random(13)
    p = [f"r{i}" for i in range(60)]
    rows = [(1, " ".join(p * 7)), (2, " ".join(["x"] * 400)), (4, " ".join([f"q{i}" for i in range(12)] * 20)), (3, " ".join([f"y{rng.randrange(99999)}" for _ in range(90)]))]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {k for r in found if r["doc_id"] == 1 for k in range(r["start_word"], r["end_word"])}
    assert covered == set(range(60, 420)) and {r["doc_id"] for r in found} == {1, 4}
    assert {k for r in found if r["doc_id"] == 4 for k in range(r["start_word"], r["end_word"])} == set(range(60, 240))
    assert all(r["source_end"] <= r["start_word"] and r["end_word"] - r["start_word"] >= 50 for r in found)


def test_runs_and_clusters():
    from driftline.llm.common import word_hashes

    rng = np.random.default_rng(4)
    w = [b"u%d" % x for x in rng.integers(0, 9000, 200)]
    other = [b"v%d" % x for x in rng.integers(0, 9000, 200)]
    for i, n in ((0, 60), (30, 49), (90, 110)):  # words i..i+n agree
        two = other[:i] + w[i : i + n] + other[i + n :]
        a, b = (substring.run_marks(word_hashes(x), np.arange(196)) for x in (w, two))
        for k, (length, before, _) in enumerate(substring._SLOTS):
            for c in range(196):
                inside = i <= c - before and c - before + length <= i + n
                whole = c - before >= 0 and c - before + length <= 200
                assert (a[c, k] != 0) == whole and (a[c, k] == b[c, k]) == (inside or not whole)
    spans = [(s, 40 * s, 40 * s + 60) for s in range(0, 100_000, 25)]
    assert len(substring.clusters(spans)) == len(spans)
    assert substring.clusters([(5, 0, 60), (9, 50, 120), (40, 55, 130), (7, 400, 460)]) == [(0, 120, 5, 9), (55, 130, 40, 40), (400, 460, 7, 7)]


def test_sources_cover_all_sure_words():
    rng = np.random.default_rng(14)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        c = rng.integers(50, 400, n)
        x = [rng.integers(0, 4, n), rng.integers(-3, 3, n), c, c - 45, c + 45, c - rng.integers(0, 42, n), c + rng.integers(6, 47, n)]
        kept = substring.sources(*x)
        sure = [k for k in range(n) if x[6][k] - x[5][k] >= 50]
        covered = {w for k in sure if any((f, s) == (x[0][k], x[1][k]) for f, s, _, _ in kept) for w in range(x[5][k], x[6][k])}
        assert covered == {w for k in sure for w in range(x[5][k], x[6][k])}
        for k in set(range(n)) - set(sure):
            assert x[2][k] in covered or any((f, s) == (x[0][k], x[1][k]) and a <= x[3][k] and b >= x[4][k] for f, s, a, b in kept)


def test_windows_of_one_key_meet_as_run_by_run(spark, passages):
    """Both ways of linking give the same passages."""
    _, d = passages
    want = sorted(map(str, substring.repeated_passages(d).collect()))
    hot = substring.HOT_KEY
    try:
        substring.HOT_KEY = 0
        assert sorted(map(str, substring.repeated_passages(d).collect())) == want
    finally:
        substring.HOT_KEY = hot


def test_cutting(spark, passages):
    docs, d = passages
    assert substring.without_spans("a b\n c  d e", [(1, 3)]) == "a d e"
    assert substring.without_spans("a b c", [(0, 2), (1, 3)]) == ""
    table = d.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    out = {r["doc_id"]: r for r in substring.remove_repeats(table, substring.repeated_passages(table)).collect()}
    assert 7 not in out and 3 in out and 90 in out  # nothing was left of a whole copy
    assert out[1]["text"].split() == docs[1][60:] and out[1]["n_chars"] == len(out[1]["text"])
    assert out[0]["text"].split() == docs[0]
    assert substring.repeated_passages(d.limit(0)).count() == 0


# ---- nearest neighbours


def brute_nearest(rows, k=20):
    good = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            score = {}
            for i, v in good.items():
                s = 0.0
                for x, y in zip(good[q], v):
                    s += x * y
                score[i] = s
            out[q] = sorted((-s, i) for i, s in score.items() if i != q)[:k]
    return out


def test_search_is_exact_on_few_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200 + i, x[0].tolist()) for i in range(40)]  # copies of a query
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (306, [1.0])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in ann.search(d, "vec_id % 20 = 0").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest([r for r in rows if r[0] != 306])
    assert {q: [(k + 1, i, -s) for k, (s, i) in enumerate(v)] for q, v in want.items()} == {q: sorted(v) for q, v in got.items()}
    few = d.where("vec_id < 3")
    assert ann.search(few, "vec_id % 20 = 0").count() == 2
    assert ann.search(d.limit(0), "vec_id % 20 = 0").count() == 0


def test_recall_and_norms(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {}
    for r in ann.op3_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    assert np.mean([len(got[q] & {i for _, i in v}) / 20 for q, v in want.items()]) >= 0.9
    x = np.random.default_rng(0).normal(size=(500, 16)).astype(np.float32)
    books = ann.fit(x, books=4, words=16)
    assert ((x - books.decode(books.encode(x, 8))) ** 2).sum() <= ((x - books.decode(books.encode(x, 1))) ** 2).sum()
    near = {q: set(b.tolist()) for q, b, _ in ann._scored(books, x[:20], books.encode(x), (books.decode(books.encode(x)) ** 2).sum(1), np.ones(500), 100, "l2")}
    assert np.mean([int(np.argsort(((x - x[i]) ** 2).sum(1))[1]) in near[i] for i in range(20)]) > 0.7


def test_recall_on_many_vectors(spark):
    x = np.random.default_rng(5).normal(size=(20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in ann.search(d, "vec_id % 200 = 0").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    best = {q: set(np.argsort(-(x[q] @ x.T))[1:21].tolist()) for q in range(0, 20_000, 200)}
    assert np.mean([len(got[q] & best[q]) / 20 for q in best]) >= 0.97
    assert ann.probes_of(ann.fit(x[:4000]), x[:4000]) > 64  # no clusters, so most cells are probed
    centres = np.random.default_rng(6).normal(size=(40, 64)).astype(np.float32)
    y = centres[np.arange(4000) % 40] + np.random.default_rng(7).normal(size=(4000, 64)).astype(np.float32) * 0.1
    books = ann.fit(y)
    probes = ann.probes_of(books, y)
    assert probes < 40
    codes = books.encode(y)
    z = books.decode(codes)
    norm = (z**2).sum(1)
    found = {q: set(b.tolist()) for q, b, _ in ann._scored(books, y[:100], codes, norm, (y * z).sum(1) / norm, 300, "ip", probes)}
    assert np.mean([len(found[q] & set(np.argsort(-(y[q] @ y.T))[:20].tolist())) / 20 for q in range(100)]) >= 0.97
    assert ann.depth_of(100) == ann.DEPTH and ann.depth_of(100 * ann.MANY) == 10 * ann.DEPTH

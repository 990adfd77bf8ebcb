import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import bpe, packing

PATH, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "\n\n", "x\x1cy", "it's We'LL", "é́​", "日本語 テキスト", "a" * 3000, "　 x y", " lead", "trail \n", "12345 67", "\U0001f600\U0001f600", "a\r\nb", "<|endoftext|>", "don't\n'tis"]


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(PATH, P.PATTERN)


def test_odd_texts(encoder, reference):
    for t in ODD:
        assert encoder.encode(t) == reference.encode_ordinary(t), t
        assert bpe.decode(encoder.v, encoder.encode(t)) == t.encode()
    assert encoder.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcé' \n\t 日Z1.,!-")), max_size=60))
def test_any_text(encoder, reference, text):
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_table_append_and_edit(encoder):
    rng = random.Random(3)
    v = encoder.v
    for _ in range(60):
        data = bytes(rng.choice(b"abcdething ") for _ in range(rng.randrange(0, 400)))
        whole = bpe.PrefixTable(v, data)
        cut = rng.randrange(len(data) + 1)
        grown = bpe.PrefixTable(v, data[:cut])
        grown.append(data[cut:])
        assert grown.last == whole.last
        assert whole.ids(cut) == bpe.PrefixTable(v, data[:cut]).ids()
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, min(len(data), a + 9) + 1)
        new = bytes(rng.choice(b"xyz the") for _ in range(rng.randrange(6)))
        whole.edit(a, b, new)
        fresh = bpe.PrefixTable(v, data[:a] + new + data[b:])
        assert whole.data == fresh.data and whole.last == fresh.last


def test_edit_is_local(encoder):
    table = bpe.PrefixTable(encoder.v, b"the thing that ended " * 500)
    assert table.edit(100, 101, b"z") < 1500


def test_bpe_query(spark, tmp_path, reference):
    texts = [*ODD, None, "again", "again"]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.op2_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    encoded = bpe.encode_documents(d, PATH, P.PATTERN)
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode_documents(encoded, PATH, P.PATTERN).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_documents(d.limit(0), PATH, P.PATTERN).count() == 0
    d.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert bpe.op2_bpe(spark, f"{tmp_path}/none").count() == 0


def test_differencing():
    rng = random.Random(1)
    for n, m in ((1, 1), (3, 5), (40, 7), (200, 9)):
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        found = packing.differencing(sizes, m)
        assert sorted(i for w in found for i in w) == list(range(n)) and len(found) <= m
        if n >= 40:
            sums = [sum(sizes[i] for i in w) for w in found]
            assert max(sums) - min(sums) < 60
    assert all(sum(w) <= 10 for w in [[[6, 6, 6][i] for i in w] for w in packing.windows([6, 6, 6], 10)])
    assert packing.windows([], 10) == []


def test_words_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    own = packing.word_tokens(WORDS)
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    texts = [x for a in special for x in (a, f"one {a} two", f"one{a}two  {a}{a}", f" {a}\n", a.upper(), f"É {a[:-1]}", "word " * 50 + a)]
    texts += [*ODD, "a|b | c || |x", "J̌ T̈ K", "İstanbul ΣΑΣ", "Word, word. WORD!"]
    for text in texts:
        assert np.frombuffer(own.packed([text], b"")[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    texts = [None, "", "one two", "one <|endoftext|> two", "same", "same", "w " * 9000] + [" ".join(rng.choice(["river", "town", "xyzzy"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    spark.createDataFrame([(i, x, 7) for i, x in enumerate(texts)], "doc_id long, text string, length int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op9_packing(spark, str(tmp_path)).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, own in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert packing.op9_packing(spark, f"{tmp_path}/none").count() == 0

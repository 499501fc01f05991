"""Token ids, packing, token files and the separator scan, against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from fieldsieve.llm import coder, packing as P, separator_scan as S, token_output as O
from fieldsieve.llm.files import put
from fieldsieve.llm.tokens import Encoder, vocabulary

from .conftest import prose


@pytest.fixture(scope="module", params=[("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)], ids=["spaced", "words"])
def encoder(request):
    return Encoder(vocabulary(request.param[0]), request.param[1])


def plain(encoder, text, end):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def test_ids(encoder):
    rng = random.Random(0)
    letters = list("ab'sß9 \n\t\r\x0b\x0c!.é́Σ\x1c\x85\xa0İ​　﻿漢👍#")
    texts = [None, "", " ", "\n\n", "it's  we'll 12345 <|endoftext|>", "ΑΣ ΣΑΣ."] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    for end in (None, 7):
        ids, starts = encoder(texts, end)
        for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == plain(encoder, t, end), repr(t)


def test_ids_where_letters_meet_other_characters(encoder):
    assert encoder.model is not None
    parts = ["a", "B", "re", "I", "'s", "'LL", "don't", "'", "é", "É", "ß", "×", "e\u0301", "a\u0338", "<", "\u0338", "\u212a", "İ", "Σ", "ς", "1", "²", "½", "ª", "_", "###", " ", "  ", "\n", "\t", "\xa0", "\u200b", "漢", "ﬁ", "<|endoftext|>", "</s>", "~", "\x7f", "\x00"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    ids, starts = encoder(texts)
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == plain(encoder, text, None), repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000) | st.integers(0, 5), max_size=1500))
def test_coder_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert coder.decode(coder.encode(ids)).tolist() == ids.tolist()


def test_coder_sizes():
    rng = np.random.default_rng(4)
    for n in (1, 255, 256, 257, 5000):
        for most in (1, 2, 50_257, 1 << 24):
            ids = rng.integers(0, most, n)
            assert (coder.decode(coder.encode(ids)) == ids).all()
    with pytest.raises(ValueError):
        coder.encode(np.array([1 << 24]))


def test_coder_learns():
    rng = np.random.default_rng(0)
    assert len(coder.encode(np.tile(rng.integers(0, 50_000, 50), 80))) < 400  # 4000 ids of 16 bits
    skewed = np.minimum(rng.geometric(0.02, 200_000), 50_000)  # no order but frequencies
    _, count = np.unique(skewed, return_counts=True)
    entropy = -(count / len(skewed) * np.log2(count / len(skewed))).sum()
    assert 8 * len(coder.encode(skewed)) / len(skewed) < entropy * 1.1 + 0.2


def test_mixture_is_inverted():
    """Every value of the mixture's range leads back to the id in whose share it lies."""
    model = coder._Model(40)
    model.seen = np.random.default_rng(1).integers(0, 50, 40)
    model.tables()
    for a, b, c, d in ((3, 3, 100, 5000), (0, 39, 9000, 1), (20, 4, 0, 70_000), (39, 0, 5, 0)):
        g1, g2, p1, p2 = (np.full(40, v) for v in (a, b, c, d))
        rest = model.total - p1 - p2
        start, size = model.interval(np.arange(40), g1, g2, p1, p2, rest)
        assert start[0] == 0 and (start[1:] == start[:-1] + size[:-1]).all() and start[-1] + size[-1] == model.total
        for v in (start, start + size - 1, start + size // 2):
            assert model.invert(v, g1, g2, p1, p2, rest).tolist() == list(range(40))


def test_file_and_checksums():
    ids = np.random.default_rng(1).integers(0, 50_257, 10_000).astype(np.uint32)
    lengths = np.array([0, 9_000, 1_000, 0])
    data = O.to_bytes([None, -5, 2**40, 2**40], lengths, ids)
    doc_ids, n, back = O.from_bytes(data)
    assert doc_ids == [None, -5, 2**40, 2**40] and n.tolist() == lengths.tolist() and (back == ids).all()
    broken = bytearray(data)
    broken[-2000] ^= 1
    with pytest.raises((ValueError, IndexError)):
        O.from_bytes(bytes(broken))
    with pytest.raises(ValueError, match="format"):
        O.from_bytes(b"XXXX" + data[4:])
    assert O.from_bytes(O.to_bytes([], np.zeros(0), np.zeros(0, np.uint32)))[0] == []


def expected(df, end):
    from pyspark.sql import functions as F

    e = Encoder(vocabulary("byte_bpe_50k.json"), True)
    rows = []
    for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").collect():
        ids = plain(e, r["text"], end)
        rows.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return rows


def test_token_files(spark, odd, empty, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    for ids_a_file, block in ((1 << 24, 1 << 20), (1, 500)):  # one file a task; one for each slice, in many blocks
        monkeypatch.setattr(O, "FILE_IDS", ids_a_file), monkeypatch.setattr(O, "BLOCK", block), monkeypatch.setattr(O, "SLICE", 2_000)
        rows = O.read(spark, O.write(odd, path), with_ids=True).orderBy("start").collect()
        assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows] == expected(odd, 0)  # the order of repeated ids as well
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
    assert O.read(spark, O.write(empty, path)).count() == 0


def test_separator_scan(spark, tmp_path, monkeypatch, odd, empty):
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(2)
    files = [[rng.choice([1, 2, 3, 9]) for _ in range(n)] for n in (0, 5, 64, 8, 1)] + [[1] * 30, [2, 9], [5] * 3]
    for i, f in enumerate(files):
        put(f"file://{tmp_path}", f"part-{i:08d}.bin", np.array(f, "<u4").tobytes())
    documents, at, start = [], 0, 0
    for x in [x for f in files for x in f]:
        at += 1
        if x == 9:
            documents.append((len(documents), start, at - start))
            start = at
    documents.append((len(documents), start, at - start))
    assert sorted(tuple(r) for r in S.scan(spark, str(tmp_path), 9).collect()) == documents
    path = vocabulary("byte_bpe_50k.json")
    assert S.width(path, True) == "<u2"
    folder, places = S.write_flat(odd, path)
    lengths = [r["n_tokens"] for r in S.scan(spark, folder, kind="<u2").orderBy("ordinal").collect()]
    assert sorted(lengths) == sorted(n for _, n, _ in expected(odd, S.END))
    assert places.count() == odd.count()
    assert S.scan(spark, S.write_flat(empty, path)[0]).count() == 0


def test_separator_scan_names_documents(spark, tmp_path, monkeypatch):
    """Ids near both ends of 64 bits, none, and several files a task."""
    monkeypatch.setattr(S, "FILE_IDS", 40)
    rows = [(-(2**63), "a b c"), (2**63 - 1, "d " * 50), (None, None), (0, "e"), (2**62, "f g"), (-5, ""), (2**62, "f g")] * 3
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = S.op2_separator_scan(spark, str(tmp_path)).collect()
    e = Encoder(vocabulary("byte_bpe_50k.json"), True)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found), key=str) == sorted(((i, len(plain(e, t, S.END))) for i, t in rows), key=str)
    at = 0
    for k, r in enumerate(sorted(found, key=lambda r: r["ordinal"])):
        assert (r["ordinal"], r["start"]) == (k, at)
        at += r["n_tokens"]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert S.op2_separator_scan(spark, f"{tmp_path}/none").count() == 0


def check_packing(rows, df, length):
    e = Encoder(vocabulary("word_bpe_49k.json"), False)
    texts = sorted((plain(e, r["text"], 1) for r in df.collect()), key=lambda x: (len(x), x))
    pieces, sequences = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    whole = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append(np.frombuffer(r["ids"], "<u4"))
    # every id once: repeated and null doc_ids share an entry here, so the ids are compared as a multiset
    found = np.sort(np.concatenate([x for v in whole.values() for x in v]))
    assert found.tolist() == sorted(i for t in texts for i in t)
    return sequences


def test_packing(spark, odd, empty):
    rows = P.packed(odd, vocabulary("word_bpe_49k.json"), False, length=256, with_ids=True).collect()
    check_packing(rows, odd, 256)
    assert P.packed(empty, vocabulary("word_bpe_49k.json"), False).count() == 0
    many = spark.createDataFrame([(i, prose(random.Random(i), 10 + i % 90)) for i in range(300)], "doc_id long, text string").coalesce(1)
    rows = P.packed(many, vocabulary("word_bpe_49k.json"), False, length=256, with_ids=True).collect()
    sequences = check_packing(rows, many, 256)
    assert sum(1 for s in sequences.values() if sum(n for _, n in s) < 256) == 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    e = Encoder(vocabulary("word_bpe_49k.json"), False)
    for doc_id, text in ((r["doc_id"], r["text"]) for r in many.collect()):
        parts = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in parts) == np.array(plain(e, text, 1), "<u4").tobytes()
        assert all(p["doc_tokens"] == len(plain(e, text, 1)) for p in parts)


def test_limits_hold_at_once():
    rng = np.random.default_rng(3)
    demand = np.stack([rng.integers(1, 100, 200), np.ones(200), rng.integers(0, 40, 200)], axis=1).astype(float)
    limits = np.array([256.0, 6.0, 64.0])
    bins = P.place(demand, limits)
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert all((demand[b].sum(axis=0) <= limits).all() for b in bins)
    best = max(np.ceil(demand.sum(axis=0) / limits))
    assert len(bins) <= 1.15 * best + 1
    with pytest.raises(ValueError):
        P.place(np.array([[300.0, 1, 1]]), limits)
    loss = [min(n, 20) for n in range(1, 300)]
    out = P.cut_and_place(list(range(1, 300)), loss, 256, 6, 64)
    covered = {}
    for s in out:
        assert sum(n for *_, n in s) <= 256 and len(s) <= 6
        for i, at, n in s:
            covered.setdefault(i, []).append((at, n))
    for i, parts in covered.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == i + 1


def test_many_tiny_texts_are_quick():
    import time

    began = time.process_time()
    bins = P.place(np.tile([[1.0, 1, 1]], (200_000, 1)), np.array([2048.0, 256, 2048]))
    assert len(bins) == -(-200_000 // 256) and sorted(i for b in bins for i in b) == list(range(200_000))
    assert time.process_time() - began < 20


@pytest.mark.parametrize(("limits", "binds"), [((64, 1000, 1000), 0), ((1000, 3, 1000), 1), ((1000, 1000, 20), 2)])
def test_each_limit_binds_in_turn(spark, limits, binds):
    """Instruction data: prompts bear no loss."""
    turns = [(c, t, "assistant" if t % 2 else "user", f"{'question ' * (1 + c % 5) if t % 2 == 0 else 'answer ' * (1 + c % 7)}") for c in range(60) for t in range(4)]
    conversations = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1)
    examples = P.exchanges(conversations)
    assert examples.count() == 120
    rows = P.packed(examples, vocabulary("word_bpe_49k.json"), False, length=limits[0], most_segments=limits[1], most_loss=limits[2], prompt="prompt", with_ids=True).collect()
    answer = Encoder(vocabulary("word_bpe_49k.json"), False).tokenizer.encode("answer", add_special_tokens=False).ids
    used = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        own = used.setdefault(r["sequence_id"], [0, 0, 0])
        own[0] += len(ids)
        own[1] += 1
        own[2] += int(np.isin(ids, [*answer, P.END]).sum())
    assert all(u[k] <= limits[k] for u in used.values() for k in range(3))
    assert sum(u[binds] >= 0.9 * limits[binds] for u in used.values()) >= 0.8 * len(used)

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from fieldsieve.llm import token_alignment as T
from fieldsieve.llm.tokens import byte_letters, vocabulary

from .conftest import frame, prose

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as their libraries give them, text by text: [(id, bytes)] of each, or nothing."""
    one, two = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {c: n for n, c in byte_letters().items()}

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(rows, tokens):
    """The contract by comparing every two tokens of a text."""
    found, count = [], Counter()
    for doc, text in rows:
        a, b = map(spans, tokens(text))
        links = [(y[0], x[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])] if len(a) < 3000 else _merge(a, b)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [",".join(str(x[0]) for x in a if s < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if s < y[2] <= e) for s, e in zip([0, *ends], ends, strict=False)] if len(a) < 3000 else _groups(a, b)
        count.update(links)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = Counter()
    for (b, _), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((d, a, b, g, len(x), sum(count[k] == best[k[0]] for k in x), sum(count[k] for k in x), s) for d, a, b, g, x, s in found), key=str)


def _merge(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((b[j][0], a[i][0]))
        i, j = i + (a[i][2] <= b[j][2]), j + (b[j][2] <= a[i][2])
    return out


def _groups(a, b):
    out, x, y, i, j = [], [], [], 0, 0
    while i < len(a):
        x.append(str(a[i][0]))
        while j < len(b) and b[j][2] <= a[i][2]:
            y.append(str(b[j][0]))
            j += 1
        if j and b[j - 1][2] == a[i][2]:
            out.append(",".join(x) + "|" + ",".join(y))
            x, y = [], []
        elif j < len(b):
            # the B token that crosses this end belongs to the group that goes on
            pass
        i += 1
    return out


def got(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in T.aligned(df, A, B).select(*columns).collect()), key=str)


def test_odd_rows(spark, odd, plain):
    assert got(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], plain)


def test_empty(spark, empty):
    assert T.aligned(empty, A, B).count() == 0


def test_odd_texts(spark, plain):
    """Runs of spaces, specials as text, the space mark, bytes and scripts that the vocabularies lack."""
    rng = random.Random(1)
    texts = ["  two spaces  after   ", " ", "   ", "\n\n a\tb ", "<s> </s> <unk> <|endoftext|> <0x41>", "a▁b", "▁", "𝔘𝔫𝔦 漢字かな 🙂👍🏽", "a b　c  d", "\x00\x01", "é é", "x" * 2000, "word, word; word.", "don't we'll 12345 3.14", "I'm <|endoftext|>"]
    texts += ["".join(rng.choice(" ab\n.▁é漢🙂\t1") for _ in range(40)) for _ in range(200)]
    texts += [prose(rng, 50) for _ in range(20)]
    assert got(frame(spark, texts)) == brute(list(enumerate(texts)), plain)


@pytest.mark.parametrize("most,shard", [(1 << 20, 1 << 22), (300, 64)])
def test_documents(spark, sf, plain, monkeypatch, most, shard):
    """Many partial counts and shards give what one of each gives."""
    for name, value in {"MOST_KEYS": most, "SHARD": shard, "HELD": 20_000}.items():
        monkeypatch.setattr(T, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000")
    assert got(docs.repartition(3)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], plain)


def test_whole_documents(spark, plain):
    """Encoding units apart is encoding whole texts, on every document."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    align = T.aligner(A, B)
    for at in range(0, len(rows), 100):
        texts = [r["text"] for r in rows[at : at + 100]]
        for t, a, b in zip(texts, *align(texts), strict=True):
            x, y = plain(t)
            assert np.frombuffer(a, "<u2").tolist() == [i for i, _ in x] and np.frombuffer(b, "<u2").tolist() == [i for i, _ in y]


def test_shards(tmp_path):
    """Counts are looked up across shards, in files of this machine and elsewhere."""
    keys, counts = np.arange(0, 3000, 3, dtype=np.int64), np.arange(1000, dtype=np.int64) + 1
    names, least = [], []
    for i, at in enumerate(range(0, 1000, 90)):
        names.append(f"s{i}")
        least.append(int(keys[at]))
        (tmp_path / names[-1]).write_bytes(keys[at : at + 90].tobytes() + counts[at : at + 90].tobytes())
    shards = T.Shards(f"file://{tmp_path}", names, least)
    assert isinstance(shards._open("s0"), np.memmap)
    wanted = keys[[0, 1, 89, 90, 91, 500, 999]]
    assert shards.counts(wanted).tolist() == [1, 2, 90, 91, 92, 501, 1000] and len(shards.counts(keys[:0])) == 0

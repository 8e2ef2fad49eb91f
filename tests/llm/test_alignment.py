"""Token alignment against byte positions compared one by one."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from leafvoice.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, segment string, a int, b int, n_a string"


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_table():
    """The usual table of byte-level vocabularies, as its rule says."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, more = {chr(b): b for b in kept}, 256
    for b in range(256):
        if b not in kept:
            out[chr(more)] = b
            more += 1
    return out


def plain(rows, tokenizers):
    a_model, b_model = tokenizers
    table = byte_table()

    def tokens(text):
        whole = b" " + (text or "").encode()
        if not text:
            return None
        a = [(i, bytes(table[c] for c in a_model.id_to_token(i))) for i in a_model.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()) for i in b_model.encode(text) for p in [b_model.id_to_piece(i)]]
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else None

    def spans(x):
        at, out = 0, []
        for i, t in x:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    found = []
    for doc_id, text in rows:
        x = tokens(text)
        if x is None:
            found.append((doc_id, [], [], "", []))
            continue
        a, b = map(spans, x)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links = [], []
        for low, high in zip([0, *cuts], cuts):
            ga, gb = ([y for y in z if low <= y[1] and y[2] <= high] for z in (a, b))
            groups.append(",".join(str(y[0]) for y in ga) + "|" + ",".join(str(y[0]) for y in gb))
            links += [(y[0], z[0]) for y in ga for z in gb if y[1] < z[2] and z[1] < y[2]]
        found.append((doc_id, a, b, ";".join(groups), links))
    counts = Counter(p for f in found for p in f[4])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((doc_id, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == most[p[1]] for p in links),
                   sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
                  for doc_id, a, b, groups, links in found)


def rows_of():
    rng = np.random.default_rng(5)
    syllables = ["tion", "er", "ñez", "the", "ly", "Über", "können", "12", "x"]
    prose = lambda n: " ".join("".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(n))
    texts = [None, "", " ", "a", "  two  spaces   and\ttabs\n\nlines ", "漢字とかな", "emoji 👩‍👩‍👧 end", "<s> </s> <|endoftext|> <0x41>", "U+2581 ▁ here", "naïve café ﬁne x",
             "\x00null byte", "é combining", "don't I'll 3.14 1,000,000 http://a.b/c?d=e&f", "x" * 3000, "a" * 17 + " " + "b" * 40]
    texts += [prose(int(n)) for n in rng.integers(1, 300, 40)] + [prose(50)] * 3
    return list(enumerate(texts)) + [(3, "again"), (3, "again")]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.mark.parametrize("segment", [4 << 20, 400])
def test_alignment(spark, tokenizers, rows, monkeypatch, segment):
    """In one segment per part, and in many, where sums of pairs cross segments."""
    monkeypatch.setattr(alignment, "SEGMENT_BYTES", segment)
    docs = spark.createDataFrame([(i, t, "s", 1, 2, "n") for i, t in rows], DOC).repartition(3)
    got = alignment.align_documents(docs, A, B)
    assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())) == plain(rows, tokenizers)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, None)], "doc_id long, text string")
    got = sorted((r["n_a"], r["n_links"]) for r in alignment.align_documents(docs, A, B).collect())
    assert got[0] == (0, 0) and got[1][0] > 0
    assert alignment.align_documents(docs.limit(0), A, B).collect() == []


def test_pieces_give_the_ids_of_whole_texts(rows, tokenizers, spark, sf, monkeypatch):
    """Also where pieces are encoded a few at a time, and where one of them holds what the pieces' tokenizer loses."""
    e = alignment.Encoder(A, B)
    texts = [t or "" for _, t in rows] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["lost a▁b here", "a b c d", "x 1 y", "a  b", "A B", "é a b é", "a b\n", " a b "]
    for some in (1 << 18, 50, 3):
        monkeypatch.setattr(alignment, "ENCODED_BYTES", some)
        monkeypatch.setattr(alignment, "PIECE_BYTES", max(1, min(some // 10, 128)))
        a, b, n_a, n_b = e.encode([t.encode() for t in texts])
        at_a = at_b = 0
        for t, x, y in zip(texts, n_a.tolist(), n_b.tolist()):
            if x:
                assert a[at_a: at_a + x].tolist() == tokenizers[0].encode(" " + t, add_special_tokens=False).ids
                assert b[at_b: at_b + y].tolist() == tokenizers[1].encode(t)
            else:
                assert not t or "▁" in t
            at_a, at_b = at_a + x, at_b + y
        assert at_a == len(a) and at_b == len(b)


def test_windows_cut_at_shared_ends_before_spaces(spark):
    got = alignment.token_windows(spark.createDataFrame([(1, "the house  and gardens")], "doc_id long, text string"), A, B).first()
    e = alignment.Encoder(A, B)
    begin_a = begin_b = 0
    for w in got["windows"]:
        a, b = (b"".join(t[i] for i in ids[x:y]) for t, ids, x, y in ((e.a_bytes, got["a_ids"], begin_a, w["a"]), (e.b_bytes, got["b_ids"], begin_b, w["b"])))
        assert a == b and a.startswith(b" ")
        begin_a, begin_b = w["a"], w["b"]
    assert (begin_a, begin_b) == (len(got["a_ids"]), len(got["b_ids"])) and len(got["windows"]) >= 4


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_WINDOWS", 5)
    e = alignment.Encoder(A, B)
    memo, fresh = alignment.Windows(e), lambda *w: alignment.Windows(e).get(*w)
    for text in ["one two", "two three one", "four five six seven", "one eight nine ten eleven"] * 3:
        a, b, _, _ = e.encode([text.encode()])
        to_a, to_b, _ = alignment.anchors(e, a, b)
        wanted = np.arange(len(to_a))
        assert memo.get(a, b, to_a, to_b, wanted, wanted % 2 == 0) == fresh(a, b, to_a, to_b, wanted, wanted < 0)
        assert len(memo.young) <= 9 and len(memo.old) <= 9


def test_byte_level_ids_are_the_tokenizers(spark, tokenizers, rows, sf):
    """Also on whole documents, and with the strings of special tokens as ordinary text."""
    _, encode = alignment.byte_level(A)
    texts = [t or "" for _, t in rows] + [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["  \n\n  a b　c  ", "it's I'LL we'd", "١٢٣ ½ ⅷ x²", "áë", "​zero", "🏳️‍🌈🏳️‍🌈 ok", "﻿bom", "<|endoftext|>" * 3]
    assert encode(texts) == [tokenizers[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_fingerprints_dont_decide(monkeypatch):
    monkeypatch.setattr(alignment, "mix", lambda x: x * 0)
    a, b = np.array([1, 2, 3, 1, 2, 9], np.int32), np.array([5, 6, 5, 7], np.int32)
    first, kind = alignment.kinds_of([(a, np.array([0, 2, 3, 5]), np.array([2, 3, 5, 6])), (b, np.arange(4), np.arange(1, 5))])
    assert first.tolist() == [0, 1, 3] and kind.tolist() == [0, 1, 0, 2]

"""Alignment against a plain reading, token by token, with both libraries' own encoders."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from cases import SCHEMA, clashing, empty, hard
from tokenizers import Tokenizer

from tallyframe.llm import align

ODD = [
    (100, "a\x00b ▁c\t\n  d  �😀 <s> </s><unk> <0x41> <|endoftext|>"), (101, "ok ▁x"), (102, " "), (103, "  two"),
    (104, "ééé 漢字 العربية 🏳️‍🌈 \r\n"), (105, "<|endoftext|>"), (106, "x" * 5000 + " " * 5000 + "!" * 500), (106, "one"), (None, "one"),
]


@pytest.fixture(scope="module")
def plain():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    first = Tokenizer.from_file(f"{align.FOLDER}/{align.A_FILE}")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.B_FILE}")

    def bytes_b(i):
        s = second.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if second.is_byte(i) else s.replace("▁", " ").encode()

    def of(rows):
        out, count = [], Counter()
        for doc_id, text in rows:
            a = first.encode(" " + text, add_special_tokens=False).ids if text else []
            b = second.encode(text) if text else []
            bytes_a = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
            want = (" " + text).encode() if text else b""
            if b"".join(bytes_a) != want or b"".join(map(bytes_b, b)) != want:
                a, b, bytes_a = [], [], []
            groups, links, i, j, at_a, at_b = [], [], 0, 0, 0, 0
            group_a, group_b = [], []
            while i < len(a) or j < len(b):
                if at_a <= at_b:
                    at_a += len(bytes_a[i])
                    group_a.append(a[i])
                    i += 1
                else:
                    at_b += len(bytes_b(b[j]))
                    group_b.append(b[j])
                    j += 1
                if at_a == at_b:
                    groups.append(f"{','.join(map(str, group_a))}|{','.join(map(str, group_b))}")
                    links.append((group_a[-1], group_b[-1]))
                    group_a, group_b = [], []
            count.update(links)
            out.append((doc_id, len(a), len(b), links, groups))
        best = Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        return sorted(
            [(i, na, nb, len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
              hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, links, g in out], key=str)

    return of


def found(docs, **more):
    return sorted((tuple(r) for r in align.alignment(docs, **more).collect()), key=str)


@pytest.mark.parametrize("share", [align.SHARE, 4, 0])
def test_hard_rows(spark, plain, share, monkeypatch):
    """Common pairs by array, the others by shuffle; with 0, all by array."""
    monkeypatch.setattr(align, "SHARE", share)
    docs = hard(spark).union(spark.createDataFrame([(i, t, None, None, 1) for i, t in ODD], SCHEMA))
    assert found(clashing(docs)) == plain((r["doc_id"], r["text"]) for r in docs.collect())


def test_documents(spark, folder, plain, monkeypatch):
    monkeypatch.setattr(align, "SHARE", 300)
    monkeypatch.setattr(align, "PIECE", 5000)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found(docs.repartition(5)) == plain((r["doc_id"], r["text"]) for r in docs.collect())


def test_empty_table(spark):
    assert found(empty(spark)) == []
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)
    assert found(blank) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_written_groups(spark):
    docs = spark.createDataFrame([(1, "one word"), (2, None)], "doc_id string, text string")
    rows = {r["doc_id"]: r for r in align.alignment(docs, written=True).collect()}
    assert hashlib.sha256(rows["1"]["groups"].encode()).hexdigest() == rows["1"]["groups_sha256"]
    assert rows["2"]["groups"] == ""


def test_merges_equal_those_of_the_file():
    """Every code point between letters, digits and blanks, and long runs."""
    p = align.pair(f"{align.FOLDER}/{align.A_FILE}", f"{align.FOLDER}/{align.B_FILE}")
    own = Tokenizer.from_file(f"{align.FOLDER}/{align.A_FILE}")
    own.encode_special_tokens = True
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}1 {c}{c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["  x", " " * 20000, "a" * 20000, "it's I'LL 'd", "\n\n \t"]
    for text, want in zip(texts, own.encode_batch(texts, add_special_tokens=False)):
        assert p.a.encode_ordinary(text) == want.ids


def test_identity_map():
    p = align.pair(f"{align.FOLDER}/{align.A_FILE}", f"{align.FOLDER}/{align.B_FILE}")
    mapped = np.flatnonzero(p.same >= 0)
    assert len(mapped) > 10000
    for a in mapped[::97]:
        b = p.same[a]
        joined = p.b.id_to_piece(int(b)).replace("▁", " ").encode()
        assert not p.b.is_byte(int(b)) or len(p.of_a.joined(np.array([a]))) == 1
        assert p.b.is_byte(int(b)) or joined == p.of_a.joined(np.array([a])).tobytes()

import random

import pytest

from claimloom.llm import split


def run(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, piece_no int").drop("piece_no")
    got = {}
    for r in split.pieces(df, ["id"], "t", size, overlap).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r)
    return got


@pytest.mark.parametrize("size, overlap", [(50, 10), (30, 0), (7, 3), (2, 1)])
def test_round_trip(spark, size, overlap):
    rng = random.Random(size)
    alphabet = "abc  .。\n,é😀溶\r\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["x" * 500, "", None, " " * 300, "😀" * 200, "\n" * 120]
    got = run(spark, texts, size, overlap)
    for i, t in enumerate(texts):
        if t is None or len(t) <= size:
            assert i not in got
            continue
        end = 0
        for n, p in enumerate(got[i]):
            assert p.piece_no == n and p.n_pieces == len(got[i]) and 0 < len(p.piece) <= size
            assert p.start == (end - overlap if n else 0) and t[p.start : p.start + len(p.piece)] == p.piece
            end = p.start + len(p.piece)
        assert end == len(t)


def test_natural_places(spark):
    para = "One sentence here. Another one, longer than that. " * 12
    text = "\n\n".join([para] * 6)
    pieces = run(spark, [text], 1000, 100)[0]
    assert all(p.piece.endswith("\n\n") for p in pieces[:-1])
    sentences = run(spark, ["A few words make it. " * 200], 500, 50)[0]
    assert all(p.piece.endswith(". ") for p in sentences[:-1])
    chinese = run(spark, ["这是一个句子。" * 300], 500, 50)[0]
    assert all(p.piece.endswith("。") for p in chinese[:-1])
    blanks = run(spark, ["word " * 300], 499, 50)[0]
    assert all(p.piece.endswith(" ") for p in blanks[:-1])


def test_long_text(spark):
    pieces = run(spark, ["some words and more, " * 50_000], 3000, 200)[0]
    assert len(pieces) > 350 and max(len(p.piece) for p in pieces) <= 3000


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        split.pattern(10, 6)

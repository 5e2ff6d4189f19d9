import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm.splitting import LIMIT, OVERLAP, oversized, split_pieces, split_text

SENTENCES = ["The cat sat on the mat.", "A dog ran far away!", "Nobody knew the reason why it happened at all.", "Prices rose; wages fell, and banks closed."]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(60, 400), st.integers(0, 60), st.randoms(use_true_random=False))
def test_nothing_is_lost(n, limit, overlap, rnd):
    text = "".join(rnd.choice([rnd.choice(SENTENCES) + " ", rnd.choice(SENTENCES) + "\n", "x" * rnd.randrange(1, 90), "  "]) for _ in range(n))
    parts = split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d


def test_cuts_at_the_valley():
    one = "The river carries water to the lake and the river water feeds the lake. " * 9
    two = "Banks lend money to firms and the money of banks pays the firms. " * 9
    text = one + two
    assert split_text(text, limit=900, overlap=0)[0][1] == len(one)


def test_overlap_is_near_the_wanted_one():
    rnd = random.Random(1)
    text = " ".join(rnd.choice(SENTENCES) for _ in range(400))
    parts = split_text(text)
    assert all(OVERLAP - 80 <= b - c <= OVERLAP + 80 for (_, b), (c, _) in zip(parts, parts[1:]))
    assert all(b - a <= LIMIT for a, b in parts)


def test_operator(spark):
    long = "We keep notes. " * 200
    rows = [("a", [" H "], long, 1), ("a", [" H "], long, 1), ("b", None, None, 2), ("c", None, " " * 5000, 3), ("d", None, "x" * 1400 + "\n \t", 4), ("e", None, "y" * 1401, 5)]
    df = spark.createDataFrame(rows, "chunk_id string, heading_path array<string>, text string, piece int")
    got = split_pieces(oversized(df, "chunk", F.col("chunk_id"), F.col("heading_path"))).collect()
    assert {r.item_key for r in got} == {"a", "e"}
    a = sorted((r for r in got if r.item_key == "a"), key=lambda r: r.piece_no)
    assert a[0].heading_path == [" H "] and len(a) == a[0].n_pieces and a[-1].end == len(long)
    assert all(r.piece == long[r.start : r.end] for r in a)
    assert split_pieces(oversized(df.limit(0), "chunk", F.col("chunk_id"))).count() == 0

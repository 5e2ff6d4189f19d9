import random

import pytest

from lectern.llm.leaks import LEAST, LeakIndex, Q, find_leaks, fold, index_of, plain_words

P1 = "Read the text below.\nIn 1862 the miller Orla Fentonson bought sixty-nine silver bowls near the sunken barn at Lindow because of a long strike in Parvale. None of the silver bowls reached Tarn."
P2 = "Read the text below.\nIn 1744 the weaver Edda Marloweson bought forty-one silver bowls near the sunken barn at Harrow because of a long strike in Dunmere. None of the silver bowls reached Keld."
Q1 = "How many painted oars had Orla Fentonson counted at the upper bridge at Lindow by the time the frost came to Parvale in 1869?"
ITEMS = [(1, P1, Q1), (2, P2, None), (3, "Read the text below.\n", " "), (4, None, None)]


@pytest.fixture(scope="module")
def index():
    return LeakIndex(ITEMS)


def found(spark, index, texts):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id) for r in find_leaks(df, index).collect()}


def test_leaks(spark, index):
    body = P1.split("\n")[1]
    noisy = body.replace("miller", "old miller").replace("silver", "si1ver").replace("because", "perhaps because").upper()
    other = body.replace("Orla Fentonson", "Ivo Garsonson").replace("1862", "1701").replace("sixty-nine", "twenty-two").replace("Lindow", "Selby").replace("Parvale", "Ripton").replace("Tarn", "Goole")
    texts = [
        "Some words before. " + body + " And some after.", noisy, "> " + body[:90] + "\n> " + body[90:], Q1, "<p>" + body.replace("barn", "<i>barn</i>") + "</p>", "filler " * 4000 + body + " filler" * 4000,
        "Read the text below. We keep the notes each day at home and then rest.", "Someone quoted \"Orla Fentonson bought sixty-nine silver bowls\" and no more.", other, None, "", "  ",
    ]
    got = found(spark, index, texts)
    assert got == {(i, 1) for i in range(6)}


def test_names_decide(spark, index):
    assert found(spark, index, [P2]) == {(0, 2)}


def test_names_are_asked_for_only_between_rivals(spark):
    own = "Long after dusk the keeper Orla Fentonson would carry wet lanterns along the narrow quay and count every lantern twice before the tide came back to Lindow"
    index = LeakIndex([*ITEMS, (5, own, None)])
    texts = [
        "He wrote that they carry wet lanterns along the narrow quay and count every lantern twice before going.",
        own.replace("Orla Fentonson", "Ivo Garsonson").replace("Lindow", "Selby"),
        own.replace("Orla Fentonson", "0r1a Fentomsom").replace("Lindow", "Limdow"),
        "It lay near the sunken barn at Lindow because of a long strike in the north.",
        "It lay near the sunken barn at Selby because of a long strike in the north.",
        "None of them would carry dry lanterns over the broad bridge or count a single lamp before the frost.",
    ]
    assert found(spark, index, texts) == {(0, 5), (1, 5), (2, 5), (3, 1)}


def test_empty(spark, index):
    assert found(spark, LeakIndex([]), [P1]) == set()
    df = spark.createDataFrame([], "doc_id long, text string")
    assert find_leaks(df, index).count() == 0
    ix = index_of(spark.createDataFrame([(1, P1, Q1), (1, P1, Q1)], "item_id long, passage string, question string"))
    assert len(ix.item_id) == 2


def test_items_that_share_a_passage(spark):
    nameless = "the keeper carries wet lanterns along the narrow quay and counts every lantern twice before the slow tide comes back to the old harbour wall again"
    for passage in (P1.split("\n")[1], nameless):
        items = [*((i, passage, f"What did they buy in the year number {i}?") for i in range(1, 5)), (9, P2, None)]
        assert found(spark, LeakIndex(items), ["He wrote: " + passage + " So it was."]) == {(0, 1), (0, 2), (0, 3), (0, 4)}


def test_instructions_do_not_count(spark):
    head = "Read the passage below with all due care and then answer the question that follows it in one or two words."
    bodies = [P1.split("\n")[1], P2.split("\n")[1], "The keeper carries wet lanterns along the narrow quay and counts every lantern twice before the tide."]
    index = LeakIndex([(i, head + "\n" + b, None) for i, b in enumerate(bodies)])
    assert found(spark, index, [head, head + "\n" + bodies[2]]) == {(1, 2)}


def test_shards_give_the_same(spark):
    items = spark.createDataFrame(ITEMS + [(7, P1.replace("Orla", "Ada"), None)], "item_id long, passage string, question string")
    body = P1.split("\n")[1]
    texts = [body, body.replace("Orla", "Ada"), P2, Q1, "None of them.", None, body.replace("Orla Fentonson", "Ivo Garsonson")]
    shards = index_of(items, most_chars=150)
    assert isinstance(shards, list) and len(shards) > 2
    assert found(spark, shards, texts) == found(spark, index_of(items), texts) != set()


def test_bound_keeps_stretches_within_the_budget():
    rnd = random.Random(3)
    words = [fold(w) for w in plain_words(" ".join((P1, P2, Q1)))]
    lost = n = 0
    for _ in range(2000):
        a = rnd.randrange(len(words) - 12)
        w = words[a : a + 12]
        grams = {x[i : i + Q] for x in [" ".join(w)] for i in range(len(x) - Q + 1)}
        for k, c in enumerate(rnd.sample(range(12), 4)):
            w[c] = rnd.choice(["", rnd.choice(words), w[c] + " " + rnd.choice(words)]) if k < 2 else w[c][:1] + "q" + w[c][2:]
        x = " ".join(y for y in w if y)
        lost += sum(x[i : i + Q] in grams for i in range(len(x) - Q + 1)) < LEAST
        n += 1
    assert lost <= 0.01 * n


def test_changed_words_and_signs_are_found(spark, index):
    """Recall on drawn stretches of the passage within the edit budget."""
    rnd, texts = random.Random(8), []
    words = P1.split("\n")[1].split()
    for _ in range(60):
        a = rnd.randrange(len(words) - 14)
        w = words[a : a + 14]
        c = rnd.randrange(2, 12)
        w[c] = rnd.choice(["other", ""])
        k = rnd.choice([i for i in range(14) if i != c and len(w[i]) > 5] or [0])
        w[k] = w[k].replace("o", "0").replace("l", "1") if rnd.random() < 0.7 else w[k][:2] + "x" + w[k][3:]
        texts.append("It said " + " ".join(x for x in w if x) + " in the end")
    got = found(spark, index, texts)
    assert len({i for i, item in got if item == 1}) >= 0.9 * len(texts)


def test_words():
    assert plain_words("<b>inter-\nvene</b> sixty-nine ­x") == ["intervene", "sixtynine", "x"]

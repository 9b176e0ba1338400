"""Decontamination of edited, re-parameterised, slot-rich and short items."""

import pytest

from svspark.llm.decontaminate import decontaminate

LONG = "every morning the baker near our bridge sells warm bread to people who walk along the river before work begins again"
SHORT = "which of these old rivers flows past more towns than any other one does"  # 14 words
APPLES = "Suppose that Anna buys 3 apples and then 4 pears from the old market near the river before she walks home"
PAIR = "Suppose that Anna buys 5 apples and then 5 pears from the old market near the river before she walks home"
TWO_WORDS = "Suppose that Mary Ann buys 3 apples and then 4 pears from the old market near the river before she walks home"
SLOTS = "List 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 now"
FEW = "who painted this ceiling first"


def edited(text, put=None):
    """One word in the middle replaced, or one put there."""
    w = text.split()
    m = len(w) // 2
    return " ".join([*w[:m], "zebra", *w[m + (put is None) :]])


@pytest.fixture(scope="module")
def found(spark):
    items = spark.createDataFrame(list(enumerate([LONG, SHORT, APPLES, SLOTS, FEW, "yes"])), "item_id long, text string")
    texts = [edited(LONG), edited(LONG, 1), edited(SHORT), edited(SHORT, 1), PAIR, TWO_WORDS, SLOTS, SLOTS.replace("1", "2"), f"he asked {FEW} and left", "yes", "yes it is", " ".join(LONG.split()[:9])]
    df = spark.createDataFrame([(i, t if i in (9, 10) else f"some words before {t} and some after") for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (tuple(r.item_ids), r.coverage) for r in decontaminate(df, items).collect()}


def test_edits_in_the_middle(found):
    assert [found[i][0] for i in range(4)] == [(0,), (0,), (1,), (1,)]


def test_slots_of_other_values(found):
    assert [found[i][0] for i in (4, 5)] == [(2,), (2,)]


def test_items_of_slots_and_short_items(found):
    assert found[6] == ((3,), 1.0) and found[7][0] == ()
    assert [found[i][0] for i in (8, 9, 10, 11)] == [(4,), (5,), (), ()]


def test_recall_of_reparameterised_items(spark):
    """Questions asked again with other numbers, names and a word put in, within other text; and other questions of the same words."""
    import random

    rng = random.Random(12)
    vocabulary = [a + b for a in "ba ce di fo gu la me ni po ru sa te".split() for b in "nd rk st lm pt".split()]
    names, filler = [n.capitalize() for n in "anna boris carla dmitri elena farid".split()], lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items, docs = [], []
    for i in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(18, 45))]
        for k in range(0, len(words), 9):
            words[k + 3 : k + 4] = [rng.choice(["{name}", "{n} km", "{n}"])]

        def asked(other, words=words, extra=False):
            text = " ".join(words)
            while "{name}" in text:
                text = text.replace("{name}", names[(other * 3 + text.count("{name}")) % 6], 1)
            while "{n}" in text:
                text = text.replace("{n}", str(17 + other * 31 + text.count("{n}")), 1)
            parts = text.split()
            return " ".join(parts[: len(parts) // 2] + ["really"] * extra + parts[len(parts) // 2 :])

        items.append((i, asked(0)))
        docs.append((i, f"{filler(60)}. {asked(1 + i % 4, extra=i % 2 == 0)}. {filler(30)}"))
        docs.append((1000 + i, filler(120)))
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    right = sum(r.doc_id in r.item_ids for r in got if r.doc_id < 1000)
    print("decontamination: recall", right / 80)
    assert right / 80 >= 0.9 and not any(r.contaminated for r in got if r.doc_id >= 1000)
    assert all(r.item_ids == [r.doc_id] for r in got if r.doc_id < 1000 and r.contaminated)


def test_templates_equal_a_plain_reading(spark):
    import re

    import numpy as np
    import pyarrow as pa

    from svspark.llm import decontaminate as d
    from svspark.llm.words import blocks

    texts = ["Anna ran 5 km. Then Boris ran 12.5 miles, (quickly)!", "the Price is $30 per kg of Tea", "", "10 apples", "Élan vital: 7 days Later"]
    kinds = {d._NUM: "N", d._NAME: "A", d._UNIT: "U"}
    for text in texts:
        ((_, _, block),) = list(blocks(pa.array([text])))
        plain, body, _ = d.templates(block, d._unit_hashes())
        got = [kinds.get(np.uint64(h), "w") for h in body]
        want, before, words = [], ".", text.split()
        for k, w in enumerate(words):
            number = bool(re.search("[0-9]", w.strip("([{\"'").rstrip(".,;:!?)]}\"'")))
            bare = w.strip("([{\"'.,;:!?)]}").lower()
            after = k and bool(re.search("[0-9]", words[k - 1]))
            name = bool(re.match("[A-ZÀ-Þ]", w.lstrip("([{\"'"))) and k and before[-1] not in ".!?:"
            want.append("N" if number else "U" if bare in d.UNITS and after else "A" if name else "w")
            before = w
        assert got == want, text

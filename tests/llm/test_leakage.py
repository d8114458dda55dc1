import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chainweft.llm import leakage
from chainweft.llm.leakage import ItemIndex, RADIUS, leaked_items
from chainweft.llm.wording import tokens, weighted_tokens

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randrange(2, 9))) for _ in range(700)]
INSTRUCTION = "Read the passage below with care and then answer the one question at its end in a single short sentence please"


def passage(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = {k: INSTRUCTION + ". " + " ".join(passage(60)) + "?" for k in range(1, 9)}
ITEMS[9] = ITEMS[8].upper()


def altered(words, every):
    return [w if i % every else "altered" + str(i) for i, w in enumerate(words, 1)]


def cases():
    """Documents and the items that each carries."""
    out = {}
    body = {k: tokens(v)[20:] for k, v in ITEMS.items()}
    out["verbatim"] = (" ".join(passage(30) + body[1] + passage(30)), {1})
    out["fifteen"] = (" ".join(passage(30) + body[2][5:20] + passage(30)), {2})
    out["fourteen"] = (" ".join(passage(30) + body[2][5:19] + passage(30)), set())
    out["two_short"] = (" ".join(passage(9) + body[2][0:8] + passage(40) + body[2][30:38] + passage(9)), set())
    out["altered"] = (" ".join(passage(3) + altered(body[3][4:40], 10)), {3})
    out["two_items"] = ("<p>" + "</b>  ".join(body[4]) + "​" + " ".join(body[5]).upper(), {4, 5})
    out["instruction"] = (INSTRUCTION + " " + " ".join(passage(50)), set())
    out["same_text"] = ("\\n".join(body[8]), {8, 9})
    out["long"] = (" ".join(passage(50_000) + body[6] + passage(20_000)), {6})
    out["empty"], out["null"] = ("", set()), (None, set())
    return out


def test_cases(spark):
    docs = cases()
    df = spark.createDataFrame([(k, t, 0) for k, (t, _) in docs.items()] + [("copy", docs["verbatim"][0], 0)], "item_id string, text string, item int")
    items = spark.createDataFrame(list(ITEMS.items()) + [(1, ITEMS[1]), (50, None), (51, ""), (None, ITEMS[1])], "item_id int, text string")
    found = {tuple(r) for r in leaked_items(df, "item_id", "text", items, "item_id", "text").collect()}
    want = {(k, i) for k, (_, own) in docs.items() for i in own} | {("copy", 1)}
    assert found == want


def test_one_and_two_altered_words_at_every_place():
    item = [f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    index = ItemIndex([(1, item, [1.0] * 60)], set(), set())

    def carries(*altered):
        words = [w if k not in altered else "altered" for k, w in enumerate(item[20:35])]
        words = ["before"] * 20 + words + ["after"] * 20
        places, _, _ = index.near(words, [1.0] * len(words))
        return bool(len(places)) and index.carries(words, 0, set(places.tolist()))

    for a in range(1, 14):
        assert carries(a), a
        assert all(carries(a, b) for b in range(a + 1, 14)), a
    assert not any(carries(a, 7) for a in (0, 14)) and not carries(3, 7, 11)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases().items()], "doc string, text string")
    items = spark.createDataFrame(list(ITEMS.items()), "item_id int, text string")
    whole = {tuple(r) for r in leaked_items(df, "doc", "text", items, "item_id", "text").collect()}
    monkeypatch.setattr(leakage, "BLOCK_TOKENS", 200)
    assert {tuple(r) for r in leaked_items(df, "doc", "text", items, "item_id", "text").collect()} == whole


def test_nothing(spark):
    none = spark.createDataFrame([], "a long, text string")
    items = spark.createDataFrame(list(ITEMS.items()), "item_id int, text string")
    assert leaked_items(none, "a", "text", items, "item_id", "text").count() == 0
    assert leaked_items(items, "item_id", "text", none, "a", "text").columns == ["item_id", "a"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.data())
def test_blocks_find_all_within_the_radius(prints, data):
    index = ItemIndex([], set(), set())
    index._add(leakage.WINDOW, np.array(prints, np.uint64), np.arange(len(prints), dtype=np.int32))
    bits = data.draw(st.lists(st.integers(0, 63), max_size=RADIUS))
    asked = prints[0]
    for b in bits:
        asked ^= 1 << b
    index._windows = lambda sums, size, step: np.array([asked], np.uint64)
    found = set(index.near(["w"] * leakage.WINDOW, [1.0] * leakage.WINDOW)[2].tolist())
    assert found == {k for k, p in enumerate(prints) if (p ^ asked).bit_count() <= RADIUS}


def with_numbers(seed, changed):
    """Two words and a number of five parts in turn; of each number the first and last part may change."""
    rng, words = random.Random(seed), []
    for _ in range(6):
        words += [rng.choice(VOCABULARY) for _ in range(2)]
        first, *middle, last = (rng.randrange(100, 999) for _ in range(5))
        words.append(f"{first + changed},{middle[0]},{middle[1]},{middle[2]}.{last + changed}")
    return words


def test_small_changes_throughout_are_found_within_the_radius_only(spark):
    texts = {k: " ".join(["before"] * 20 + with_numbers(k, 1) + ["after"] * 20) for k in range(60)}
    items = {k: " ".join(with_numbers(k, 0)) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    found = {tuple(r) for r in leaked_items(df, "doc", "text", spark.createDataFrame(list(items.items()), "item long, text string"), "item", "text").collect()}
    assert found == {(k, k) for k in range(60)}
    exact = 0
    for k in range(60):  # the same with equal fingerprints only
        index = ItemIndex([(k, *weighted_tokens(items[k]))], set(), set())
        words, weights = weighted_tokens(texts[k])
        assert leakage.WINDOW not in set(index.near(words, weights, 0)[1].tolist())
        exact += any(index.carries(words, 0, set(range(p, p + n, leakage.WINDOW))) for p, n, _ in zip(*map(list, index.near(words, weights, 0))))
    assert exact <= 40


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 ,.'\n-é<&­", max_size=40))
def test_weights_follow_the_tokens(text):
    words, weights = weighted_tokens(text)
    assert words == tokens(text) and len(weights) == len(words)


def test_disguises():
    want = tokens("The pool reached 2,088.30 ether; Denden's café paid")
    for text in ("THE <b>pool</b> re­ached 2&#44;088.30 ether; Denden’s café paid", "> The pооl​ reached\\n2 088 30 ether Dendens CAFÉ paid", "the pool rea-\nched 2.088,30 ether dendens cafe paid"):
        assert tokens(text) == want
    assert sum(weighted_tokens("2,088.30 ether")[1]) == 2

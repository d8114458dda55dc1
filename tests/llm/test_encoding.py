import pytest

from chainweft.llm import codecs as codings
from chainweft.llm.encoding import align, garbled_documents, restored_documents

CLEAN = ["Die höchste Gebühr lag bei {} Gwei.", "La comisión más alta fue de {} gwei.", "После перезапуска осталось {} записей.", "The café tab of the Malmö shift – {} paid.", "Limits: {} × 3 calls — enough."]
QUOTES = ["open the csv and ü turns into Ã¼ in column {}.", "Test row {} holds √ß√£o on purpose; ção has its own row.", "Fonts without a glyph draw � here {}.", "ATENCIÓN: AÑO {} SIN VERIFICAR."]


def corpus(n=60):
    texts = [t.format(i) + " Nothing else.\nDone." for i in range(n) for t in CLEAN] + [q.format(i) for i in range(3) for q in QUOTES]
    return [(k, t, 0, "x") for k, t in enumerate(texts)] + [(5001, None, 0, ""), (5002, "", 0, ""), (5003, "plain ascii", 0, "")]


def test_garble_and_restore_are_inverse():
    for chain in codings.chains():
        for text in ("é", "öß", "После", "—", "ção"):
            odd = codings.garble(text, chain)
            if odd is not None and all(ord(c) >= 0xA0 for c in text):
                assert codings.restore(odd, chain) in (text, None) or len(chain) == 1


def garbled(chains, n=4):
    out, clean = [], {}
    for c, chain in enumerate(chains):
        for k, t in enumerate(CLEAN):
            for i in range(n):
                text = t.format(100 + i)
                odd = "".join(codings.garble(x, chain) or x if not x.isascii() else x for x in text)
                if odd != text and all(codings.garble(x, chain) is not None for x in text if not x.isascii()):
                    key = 10_000 + 1000 * c + 10 * k + i
                    out.append((key, "All fine here.\n" + odd, 0, "x"))
                    clean[key] = "All fine here.\n" + text
    return out, clean


CHAINS = [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp437"),), (("utf-8", "cp1251"),), (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("cp1251", "cp1252"),), (("cp1252", "mac_roman"),)]


@pytest.fixture(scope="module")
def result(spark):
    odd, clean = garbled(CHAINS)
    df = spark.createDataFrame(corpus() + odd, "doc_id long, text string, place int, state string").repartition(4)
    found = {r[0] for r in garbled_documents(df, "doc_id", "text").collect()}
    restored = {r.doc_id: r for r in restored_documents(df, "doc_id", "text").collect()}
    return found, restored, clean


def test_every_garbled_text_and_no_quotation_is_found(result):
    found, _, clean = result
    assert found == set(clean)


def test_texts_are_restored(result):
    _, restored, clean = result
    assert set(restored) == set(clean)
    assert all(restored[k].text == t for k, t in clean.items() if restored[k].complete)
    assert sum(r.complete for r in restored.values()) >= 0.95 * len(restored)


def test_lost_characters(spark):
    rows = corpus(20) + [(9001, "The caf� tab of the Malm� shift � 7 paid.", 0, ""), (9002, "Unique na��ve words only.", 0, ""), (9003, "x" * 300_000 + " caf�s", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, state string")
    out = {r.doc_id: r for r in restored_documents(df, "doc_id", "text").collect()}
    assert set(out) == {9001, 9002, 9003}
    assert out[9001].complete and out[9001].text == "The café tab of the Malmö shift – 7 paid."
    assert not out[9002].complete


def test_copies_of_a_garbled_text_on_a_third_of_the_rows(spark, result):
    rows = corpus()
    odd = {chain: " ".join("".join(codings.garble(x, chain) or x if not x.isascii() else x for x in t.format(7)) for t in CLEAN[:2]) for chain in CHAINS[:2]}
    for chain, text in odd.items():
        copies = [(20_000 + k, text if k % 2 else f"<p>{text.replace(' ', '  ')}</p>", 0, "x") for k in range(len(rows) // 2)]
        df = spark.createDataFrame(rows + garbled(CHAINS)[0] + copies, "doc_id long, text string, place int, state string").repartition(4)
        assert {r[0] for r in garbled_documents(df, "doc_id", "text").collect()} == result[0] | {r[0] for r in copies}, chain


def test_a_clean_twin_is_preferred_to_copies_of_its_garbled_form(spark):
    odd = "".join(codings.garble(x, CHAINS[0]) if not x.isascii() else x for x in "Limits: 9 × 3 calls — enough.")
    rows = corpus(20) + garbled(CHAINS[:1], 1)[0] + [(8000 + k, odd, 0, "") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int, state string")
    out = {r.doc_id: r for r in restored_documents(df, "doc_id", "text").collect()}
    assert {8000 + k for k in range(60)} <= set(out)
    assert all(out[8000 + k].complete and out[8000 + k].text == "Limits: 9 × 3 calls — enough." for k in range(60))


def test_hot_passages_find_the_same(spark, result, monkeypatch):
    from chainweft.llm import encoding
    from chainweft.operators import skew

    monkeypatch.setattr(encoding, "lookup", lambda left, right, key, rows: skew.lookup(left, right, key, rows, 2))
    odd, clean = garbled(CHAINS)
    df = spark.createDataFrame(corpus() + odd, "doc_id long, text string, place int, state string").repartition(3)
    assert {r[0] for r in garbled_documents(df, "doc_id", "text").collect()} == result[0]


SENTENCES = [
    "La señora Ibáñez revisó {} pagos después de la pausa de mañana.",
    "Les dépôts étaient bloqués à {} heures, très tôt et sans règle précise.",
    "A comissão não pôde abrir {} operações até à manhã.",
    "Für {} Einträge fehlt die Prüfung, größere Beträge wären auffällig.",
]
#: pairs of encodings that are not among the usual ones
UNUSUAL = [("cp1252", "cp737"), ("cp1252", "cp1257"), ("cp1252", "iso8859_7"), ("cp1252", "cp1255"), ("utf-8", "gbk")]


def planted(change, first, texts=SENTENCES, n=24):
    """Near-twins of the sentences after a change of their characters, and what they were; those unchanged are left out."""
    out, clean = [], {}
    for k in range(n):
        whole = texts[k % len(texts)].format(700 + k)
        odd = change(whole)
        if odd is not None and odd != whole:
            out.append((first + k, "Row of the log.\n" + odd, 0, "x"))
            clean[first + k] = "Row of the log.\n" + whole
    return out, clean


def compared(spark, rows, clean):
    base = [(10 * k + j, t.format(k) + "\nAll else is well.", 0, "x") for k in range(80) for j, t in enumerate(SENTENCES)]
    df = spark.createDataFrame(base + rows, "doc_id long, text string, place int, state string").repartition(4)
    out = {r.doc_id: r for r in restored_documents(df, "doc_id", "text").collect()}
    assert set(out) == set(clean)
    assert all(out[k].complete and out[k].text == t for k, t in clean.items())


@pytest.mark.parametrize("chain", UNUSUAL, ids="-".join)
def test_unusual_encodings_are_learned_from_twins(spark, chain):
    def change(text):
        pieces = ["".join(codings.garble(x, (chain,)) or "?" if not x.isascii() else x for x in text)]
        return None if "?" in pieces[0] else pieces[0]

    rows, clean = planted(change, 100_000)
    assert len(clean) >= 12
    compared(spark, rows, clean)


def test_a_mapping_of_no_encoding_is_learned_from_twins(spark):
    secret = dict(zip("áñóéôàèãõçüöäß", ["Ա", "ԲԲ", "Գ", "Դ", "ԵԶ", "Է", "Ը", "Թ", "Ժ", "Ի", "Լ", "Խ", "Ծ", "Կ"]))
    rows, clean = planted(lambda text: "".join(secret.get(x, x) for x in text), 100_000)
    compared(spark, rows, clean)


def test_alignment():
    assert align(["é", "öß"], ["├⌐", "├Â├ƒ"]) == {"é": "├⌐", "ö": "├Â", "ß": "├ƒ"}
    assert align(["é", "à", "éà"], ["xxx", "y", "xxxy"]) == {"é": "xxx", "à": "y"}
    assert align(["é", "é"], ["a", "b"]) is None and align(["é"], ["a", "b"]) is None and align(["é"], ["é"]) is None


def test_an_odd_twin_is_no_twin(spark):
    rows = corpus() + garbled(CHAINS)[0]
    quotes = [(50_000 + k, f"Row {k} holds {q} on purpose and must stay.", 0, "x") for k, q in enumerate(["Ð¶"] * 9 + ["╨╢", "–∂"] * 2 + ["Ã§Ã£o"] * 12 + ["√ß√£o"] * 3)]
    df = spark.createDataFrame(rows + quotes, "doc_id long, text string, place int, state string")
    assert not {r[0] for r in garbled_documents(df, "doc_id", "text").collect()} & {q[0] for q in quotes}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert garbled_documents(df, "doc_id", "text").count() == 0
    assert restored_documents(df, "doc_id", "text").columns == ["doc_id", "text", "complete"]

import pytest

from passagekg.llm import stuffing

PROSE = "The crystals were heated at 120 degrees for two days and were then washed with water. It is not clear why the yield fell in the second run, but we think that the solvent was not dry. "
STUFFED = {
    "repeated": "cheap powder, best powder, buy powder online, cheap sorbent, " * 20,
    "permuted": "\n".join("silica gel cheap lab chemicals nano powder" if i % 2 else "nano powder silica gel lab chemicals cheap" for i in range(12)),
    "hashtags": "#CheapPowder\n#BuyNow\n#SilicaGel\n#LabChemicals\n#BuyNow\n#Desiccant\n#SilicaGel",
    "links": "More on silica gel at https://a.example and shop.example\n[desiccant](http://b.test/desiccant)\nVisit c.example/gel for gel.\n" * 6,
    "navigation": " › ".join(["Home", "Silica gel", "Privacy", "Cart (0)", "Desiccant", "Back to top", "Home", "Wish list", "Terms", "Silica gel"] * 5),
    "products": "\n".join(f"Compound {i} | SKU {4000 + i} | {i}.00 | in stock | silica gel" for i in range(12)),
    "chinese": "现货供应 厂家直销 批发 沸石 " * 30,
    "for sale": "powder for sale. gel for sale. POWDER FOR SALE. " * 20,
    "mostly": PROSE + "\n\n" + "silica gel lab chemicals nano powder desiccant " * 30,
}
HONEST = {
    "prose": PROSE * 6,
    "short": "Please label the vial.",
    "bibliography": "References\n" + "\n".join(f"[{i}] Group X{i}, Porous films for sensing, J. Invented Mater. 20{i:02d}, {i}, 1{i}. https://doi.example/10.9999/x{i}" for i in range(10, 30)),
    "table": "2theta\td\tI\n" + "\n".join(f"{i}.1{i}\t{i}.02\t{i}" for i in range(40)),
    "glossary": "Abbreviations\nDMF: dimethylformamide\nTHF: tetrahydrofuran\nEtOH: ethanol\nPy: pyridine\nDCM: dichloromethane",
    "contents": "Contents\n" + "\n".join(f"{i}.1 Films for sensing {i} .... {i}0" for i in range(1, 12)),
    "protocol": "Procedure\n" + "\n".join(f"{i}. Stir until clear." for i in range(1, 9)),
    "inventory": "Reagent\tPurity\tAmount\n" + "\n".join(f"acid {i}\t9{i % 10}.1%\t{i} g" for i in range(20)),
    "chinese": "该材料经过40次循环后仍保持稳定。将258毫克样品与配体溶于水中，搅拌48分钟。" * 4,
    "keywords": PROSE * 3 + "\nKeywords: silica gel; desiccant; nano powder; lab chemicals; graphene",
    "mostly prose": PROSE * 8 + "\n\nsilica gel nano powder desiccant silica gel nano powder desiccant",
}


@pytest.mark.parametrize("kind", STUFFED)
def test_stuffed(kind):
    assert stuffing.stuffing_share(STUFFED[kind]) > stuffing.SHARE


@pytest.mark.parametrize("kind", HONEST)
def test_honest(kind):
    assert stuffing.stuffing_share(HONEST[kind]) <= stuffing.SHARE


def brute_autocorrelation(found):
    return max(sum(found[i] == found[i - lag] for i in range(lag, len(found))) for lag in range(1, len(found))) / len(found)


def test_recurrence():
    assert stuffing.recurrence(["a", "b"] * 10) == (0.9, 0.9)
    assert stuffing.recurrence([str(i) for i in range(50)]) == (0.0, 0.0)
    # recurs inside its period: the gaps alone would say 0.5
    assert stuffing.recurrence(list("abac") * 20) == (77 / 80, 76 / 80)
    # a period longer than the window
    cycle = [str(i) for i in range(90)] * 6
    assert stuffing.recurrence(cycle) == (0.0, brute_autocorrelation(cycle))
    import random

    rng = random.Random(4)
    for _ in range(20):
        found = [rng.choice("abcdefgh") for _ in range(rng.randint(2, stuffing.LAG))]
        assert stuffing.recurrence(found)[1] == brute_autocorrelation(found)


@pytest.mark.parametrize("mark", [", ", " "])
def test_different_nouns_without_function_words(mark):
    assert stuffing.stuffing_share(mark.join(_names(59))) == 1.0


def test_documents(spark):
    rows = [(1, STUFFED["repeated"], "x"), (1, STUFFED["repeated"], "x"), (2, HONEST["prose"], None), (3, None, "x"), (4, "", "x"), (5, "  \n ", "x"), (6, "a" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, stuffing string")
    assert [r.doc_id for r in stuffing.flagged(docs).collect()] == [1]
    assert stuffing.flagged(docs.limit(0)).count() == 0


def _names(n):
    return ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17)) + chr(97 + i // 26) for i in range(n)]


@pytest.mark.parametrize("text", [", ".join(_names(300)), "\n".join(_names(40)), " | ".join(_names(60) * 5), ". ".join(" ".join(_names(60)[i : i + 3]) for i in range(0, 60, 3)) + ". ", " ".join(_names(300))])
def test_lists_of_different_terms(text):
    assert stuffing.stuffing_share(text) > stuffing.SHARE


@pytest.mark.parametrize("text", [", ".join(_names(20)), "\n".join(f"{x} 9{i % 10}" for i, x in enumerate(_names(40))), "\n".join(f"{x}: {y}" for x, y in zip(_names(40), _names(80)[40:])), "Кристаллы были нагреты до кипения двое суток. " + "Затем раствор охладили и промыли чистой водой. Выход второго опыта оказался ниже первого. Растворитель вероятно содержал немного влаги."])
def test_honest_lists_of_different_terms(text):
    assert stuffing.stuffing_share(text) <= stuffing.SHARE

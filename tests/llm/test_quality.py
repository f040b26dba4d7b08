import numpy as np
import pytest

from corpusloom.llm import quality as Q

DOCS = "doc_id bigint, text string, lang string, is_prose string"
EN = "the of and to a in is it for that with as was be by on not or are at from this".split()
DE = "der die das und ist nicht mit dem den von zu ein eine für auf".split()
PROSE = "The cache is rebuilt before the release. It was not clear to the team that a restart of the node is needed for it."


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("en", w) for w in EN] + [("de", w) for w in DE] + [(None, "x"), ("en", None)], "lang string, word string")


def judge(spark, words, texts, labels=None):
    docs = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r for r in Q.text_statistics(docs, words, labels).collect()}


def test_forms(spark, words):
    listing = "Modules\n" + "\n".join(f"- merged part {i}" for i in range(12))
    rows = "\n".join("| a | 1.5 | yes |" for _ in range(8))
    texts = [
        PROSE,
        "\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)),
        "\n".join("# " + x for x in PROSE.split(". ")),
        "Done.",
        PROSE + "\n\n- item one\n- item two\n",
        listing,
        rows,
        "a.b\tc\t1\n" * 8,
        "\n".join('  File "x/y.py", line 3, in z' for _ in range(6)),
        "lbEJ18nA8u/RK9VhuqGaD4bjli6rmD4SF6IGalI7nemdnTvAo0PVZj1ujqnsOXi1ar8mknke\n" * 5,
        "marker journal query proxy anchor ticket shard rule " * 9,
        "======\n------\n" * 5,
        "Der Lauf ist nicht mit dem alten Stand zu vergleichen. Die Werte sind für das Haus und den Hof von Belang.",
        "It is so.\n" + listing,
        "qneaibpg the uqydj we lplkexlv a jpuskh of tiasou to zxcvb in qwert is asdfg " * 5,
    ]
    got = judge(spark, words, texts)
    assert [got[i]["text_form"] for i in range(len(texts))] == ["prose"] * 5 + ["list", "table", "table", "junk", got[9]["text_form"], "junk", "junk", "prose", "list", "junk"]
    assert not got[9]["is_prose"] and got[12]["language"] == "de" and got[0]["language"] == "en"


def test_statistics(spark, words):
    r = judge(spark, words, ["The cat is here.\nNo end here\n"])[0]
    assert (r["n_chars"], r["n_words"], r["n_lines"], r["terminal_line_share"]) == (29, 7, 2, 0.5)
    assert abs(r["mean_word_length"] - 3) < 1e-9 and abs(r["symbol_ratio"] - 1 / 29) < 1e-9 and abs(r["common_word_share"] - 2 / 7) < 1e-9


def test_labels_move_the_profiles(spark, words):
    labels = spark.createDataFrame([(0, "prose"), (1, "list"), (9, "table"), (1, "other"), (None, "junk")], "doc_id bigint, text_form string")
    got = judge(spark, words, [PROSE, "- a b\n" * 9], labels)
    assert got[0]["is_prose"] and got[1]["text_form"] == "list"


def test_divergence():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert Q.divergence(p, q) == 1.0 and Q.divergence(p, 5 * p) == 0.0 and Q.divergence(p, 0 * p) == 1.0
    assert Q.divergence(p, p + q) == Q.divergence(p + q, p)


def test_edges(spark, words):
    got = judge(spark, words, ["", None, " \n\t", "x" * 200_000, PROSE * 2_000, ", ".join(["a"] * 60_000)])
    assert [got[i]["text_form"] for i in (0, 1, 2)] == ["junk"] * 3 and got[0]["prose_share"] == 0 and got[4]["is_prose"] and not got[3]["is_prose"] and not got[5]["is_prose"]
    docs = spark.createDataFrame([(None, PROSE, None, None), (1, PROSE, None, None), (1, PROSE, None, None)], DOCS)
    assert Q.text_statistics(docs, words).count() == 2
    assert Q.text_statistics(docs.where("false"), words).count() == 0
    assert not Q.text_statistics(docs, words.where("false")).first()["is_prose"]


def test_labelled_documents(spark, data):
    from corpusloom.llm.queries import p9_statistics

    labels = spark.read.parquet(f"{data}/doc_labels.parquet")
    got = p9_statistics(spark, data).join(labels.withColumnRenamed("text_form", "label"), "doc_id").collect()
    assert got and all((r["label"] == "prose") == r["is_prose"] for r in got)


def test_the_divergences_alone_make_prose():
    import pandas as pd

    common = {"en": EN}
    garbled = "qneaibpg the uqydj we lplkexlv a jpuskh of tiasou to zxcvb in qwert is asdfg " * 5
    bare = "Marker journal query proxy anchor ticket shard rule window horizon. Ledger stamp catalog prefix batch unit role phase wave graph kernel. " * 3
    texts = [PROSE * 3, garbled, bare, "- " + PROSE, "\n".join(f"part{i};{i * 7};x" for i in range(20))]
    counted = next(Q._count_batches(common)(iter([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})])))
    language = Q._Language(common)
    b, first = Q._Batch(counted), Q._Batch(counted.iloc[:1])
    profiles = Q.Profiles(*first.sums(np.ones(len(first.kind), dtype=bool), language))
    limits = (Q.WORD_LIMIT, Q.CHAR_LIMIT)
    assert Q._judged(b, profiles, limits).tolist() == [0, 3, 3, 0, 2]
    assert Q._judged(b, profiles, (np.inf, Q.CHAR_LIMIT)).tolist()[2] == 0  # without the words
    assert Q._judged(b, profiles, (Q.WORD_LIMIT, np.inf)).tolist()[1] == 0  # without the classes
    assert set(Q._judged(b, profiles, (np.inf, np.inf))) == {0}


def test_limits_are_fitted():
    assert 0.01 < Q.fit_limit([0.001, 0.01], [0.1, 0.4], 9.0) < 0.1
    assert 0.01 < Q.fit_limit([0.001, 0.01, 0.5], [0.1, 0.4], 9.0) < 0.1
    assert Q.fit_limit([], [0.1], 9.0) == Q.fit_limit([0.1], [], 9.0) == 9.0


def test_slices_change_nothing(monkeypatch):
    c, texts = Q._Characters(), ["The end. ", "", "a.b" * 50, "x", "AB CD\nEF"] * 7
    kinds = np.arange(len(texts)) % 3
    whole = c.runs(texts, kinds), c.symbol_counts(texts)
    for size in (1, 10, 160):
        monkeypatch.setattr(Q, "SLICE", size)
        assert list(Q._slices(texts))[0][0] == 0 and list(Q._slices(texts))[-1][1] == len(texts)
        assert (c.runs(texts, kinds) == whole[0]).all() and (c.symbol_counts(texts) == whole[1]).all()
    assert c.runs([], np.array([])).shape == (0, 9) and list(Q._slices([])) == []


def test_character_runs():
    c = Q._Characters()
    runs = dict(zip(Q.CLASSES, c.runs(["The end.  a.b"], np.array([1]))[0]))
    assert runs == {"lower": 4, "upper": 1, "digit": 0, "space": 1, "stop": 1, "mark": 0, "symbol": 1, "other": 0, "gap": 1}
    assert c.runs(["", "AB CD"], np.array([0, 0])).tolist() == [[0] * 9, [2, 0, 0, 1, 0, 0, 0, 0, 0]]
    assert c.symbol_counts(["a-b \U0001f600", "é"]).tolist() == [2, 0]

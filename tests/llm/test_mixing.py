import math
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file")
DOCS = "doc_id bigint, text string, source string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("rate, most", [(0.1, 1), (0.9, 1), (0.5, 4), (2.7, 4), (3.99, 4), (1.0, 10)])
def test_cut_poisson_has_the_mean(rate, most):
    t = M.cut_poisson(rate, most)
    assert len(t) == most and all(0 <= a <= b <= 1 for a, b in zip(t, t[1:] + [1.0]))
    assert abs(sum(1 - x for x in t) - rate) < 1e-6
    assert M.cut_poisson(4.0, 4) == [0.0] * 4 and M.cut_poisson(0.0, 2) == [1.0, 1.0]


def test_cut_poisson_is_poisson_where_nothing_is_cut():
    t = M.cut_poisson(0.5, 12)
    assert all(abs(x - sum(math.exp(-0.5) * 0.5**j / math.factorial(j) for j in range(k + 1))) < 1e-6 for k, x in enumerate(t))


def test_mixture(spark):
    rows = [(i, "some words of a text " * (1 + i % 5), ["Big", " big ", "BIG"][i % 3], None) for i in range(3000)] + [(10_000 + i, "other short words " * 3, "small-one", None) for i in range(200)] + [(20_000, "x", None, None), (20_001, "x", "unlisted", None), (None, "x", "big", None), (20_002, None, "big", None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small_one", 0.3, 3), ("absent", 0.0, 2), (None, 0.5, 1), ("nothing", 1e-9, 1)], TARGETS)
    mixed, report = M.mix_sources(docs, targets)
    by = {r["source"]: r for r in report.collect()}
    assert abs(by["big"]["actual_share"] - 0.7) < 0.01 and abs(by["small_one"]["actual_share"] - 0.3) < 0.01
    assert by["small_one"]["max_copies"] == 3 and by["big"]["max_copies"] == 1 and by["nothing"]["tokens_mixed"] == 0
    copies = mixed.collect()
    assert len(copies) == sum(r["copies"] for r in by.values()) and len({(r["doc_id"], r["copy_no"]) for r in copies}) == len(copies)
    assert {r["source"] for r in copies} == {"big", "small_one"}
    keys = [r["shuffle_key"] for r in copies]
    assert keys == sorted(keys) and [r["source"] for r in copies[: len(copies) // 2]].count("small_one") > 100
    again, _ = M.mix_sources(docs.repartition(7), targets)
    assert again.collect() == copies


def test_budget(spark):
    docs = spark.createDataFrame([(i, "one two three four", "a", None) for i in range(2000)], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    _, report = M.mix_sources(docs, targets, budget=2000)
    assert abs(report.first()["tokens_mixed"] - 2000) < 100


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world <|endoftext|>", " A-b c ", None), (2, None, "  ", None)], DOCS)
    got = {r["doc_id"]: r for r in M.count_tokens(docs).collect()}
    assert got[1]["source"] == "a_b_c" and got[1]["n_tokens"] > 4 and got[2]["source"] is None and got[2]["n_tokens"] == 0


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed, report = M.mix_sources(docs, targets)
    assert mixed.count() == 0 and report.first()["actual_share"] == 0
    mixed, report = M.mix_sources(docs, targets.where("false"))
    assert mixed.count() == 0 and report.count() == 0
    assert docs.select(F.lit(1)).count() == 0

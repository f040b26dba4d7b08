import fnmatch
import random
import re
import uuid

from pyspark.sql import functions as F

from corpusloom.config import EXCLUDE_GLOBS, INCLUDE_GLOBS
from corpusloom.functions import hashing, paths, text, vectors

ODD = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2009\u2028\u2029\u202f\u205f\u3000"


def strings(n=400):
    r = random.Random(7)
    alphabet = list("abZ9_./:-") + list(ODD) + list("яЁёéÜ日😀İKıſ\"'#")
    return ["", *("".join(r.choices(alphabet, k=r.randrange(0, 60))) for _ in range(n)), "x" * 281, "x" * 280, ("a " * 200)]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in rows.select("i", expression(F.col("t"))).orderBy("i").collect()]


def python_snippet(t):
    flat = " ".join(t.split())
    return flat if len(flat) <= 280 else flat[:277].rstrip() + "..."


def test_text_agrees_with_python(spark):
    values = strings()
    assert column(spark, values, text.lines) == [v.splitlines() for v in values]
    assert column(spark, values, text.strip) == [v.strip() for v in values]
    assert column(spark, values, text.snippet) == [python_snippet(v) for v in values]
    assert column(spark, values, text.tokens) == [[t.lower() for t in re.findall(text.TOKEN, v)] for v in values]
    assert column(spark, values, text.is_blank) == [not v.strip() for v in values]


def test_snippet_limits(spark):
    assert column(spark, ["x" * 280, "x" * 281], text.snippet) == ["x" * 280, "x" * 277 + "..."]


def test_scope_tags_language(spark):
    given = ["docs/a.py", "Docs/a.py", "apps/X.MD", "apps/user-api/observability/x.py", "docs\\x\\y.rst", "tools/testing/load/reports/a.json", "a/Makefile", "a/.md"]
    assert column(spark, given, paths.scope) == ["docs", "code", "docs", "code", "docs", "code", "code", "code"]
    assert column(spark, given, paths.domain_tags) == [["docs"], ["general"], ["general"], ["flow01", "observability"], ["docs"], ["load_reports"], ["general"], ["general"]]
    assert column(spark, given, paths.language) == ["python", "python", "markdown", "python", "text", "json", "text", "text"]
    assert column(spark, ["a/x.PY", "a/Dockerfile", "a/b.png", "README", ".py"], paths.is_text_like) == [True, True, False, True, False]


def test_globs_agree_with_fnmatch(spark):
    r = random.Random(3)
    names = ["apps", "docs", "node_modules", ".venv", "x y", "a\nb", "__pycache__", ".env", ".envx", "k.pem", "i.png", "m.py", "AGENTS.md", "services", "tmp"]
    given = ["/".join(r.choices(names, k=r.randrange(1, 5))) for _ in range(300)]
    for globs in (INCLUDE_GLOBS, EXCLUDE_GLOBS):
        got = column(spark, given, lambda c: paths.matches_any(c, globs))
        assert got == [any(fnmatch.fnmatchcase(p, g) for g in globs) for p in given]


def test_confined(spark):
    given = ["apps/../../x", "/etc/x", "C:\\x", "apps/a..b/x", "..", "apps/x.py"]
    assert column(spark, given, paths.is_confined) == [False, False, False, True, False, True]


def test_identities(spark):
    ids = ["abc", "", "ключ", "f" * 64 + ":part12"]
    assert column(spark, ids, hashing.storage_uuid) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ids]


def test_prompts(spark):
    assert column(spark, ["a{query}"], lambda c: text.query_prompt(c, "q: {query}!")) == ["q: a{query}!"]
    assert column(spark, ["a"], lambda c: text.document_prompt(c, "")) == ["a"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in rows.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None, None, None]

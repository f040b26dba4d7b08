from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators import chunkers as C

PY = """import os

@dec
def f():
    return 1

class C:
    \"\"\"doc\"\"\"
    x = 1
    @property
    def m(self): return 2
    class N: pass
y = 3
"""


def test_python_example():
    got = [(s.chunk_type, s.symbol_path, s.start_line, s.end_line, s.text.split("\n")[0]) for s in C.definitions(PY)]
    assert got == [
        ("module_preamble", None, 1, 3, "import os"),
        ("python_function", "f", 4, 5, "def f():"),
        ("class_summary", "C", 7, 7, "class C:"),
        ("python_method", "C/m", 11, 11, "def m(self): return 2"),
    ]


def test_python_edges():
    one = list(C.definitions("class A: pass"))
    assert [(s.locator, s.start_line, s.end_line) for s in one] == [("class:A:summary:1:0", 1, 1)]
    assert [s.chunk_type for s in C.definitions("x = 1\n")] == ["generic_window"]
    assert [s.chunk_type for s in C.definitions("def f(:\n")] == ["generic_window"]
    assert [s.chunk_type for s in C.definitions("\ufeffdef f(): pass\n")] == ["generic_window"]
    kinds = [(s.chunk_type, s.symbol_path) for s in C.definitions("async def g():\n    pass\nclass K:\n    async def h(self):\n        pass\n")]
    assert kinds == [("python_async_function", "g"), ("class_summary", "K"), ("python_method", "K/h")]


def test_markdown_example():
    text = "intro\n# A\na\n### B\n```sh\n# not a heading\n```\n## C"
    assert [(s.heading_path, s.start_line, s.end_line) for s in C.sections(text)] == [("A", 2, 3), ("A / B", 4, 5), ("not a heading", 6, 7), ("not a heading / C", 8, 8)]
    assert [s.chunk_type for s in C.sections("no headings here")] == ["generic_window"]


def test_long_section_is_cut_at_blank_lines():
    body = "# H\n" + ("x" * 99 + "\n") * 26 + "\n" + "tail"
    parts = list(C.sections(body))
    assert len(parts) == 2 and parts[1].text == "tail" and {(p.start_line, p.end_line) for p in parts} == {(1, 29)}
    assert [p.locator.split(":")[1] for p in parts] == ["1", "2"]
    assert len(list(C.sections("# H\n" + ("x" * 99 + "\n") * 60))) == 1


def test_windows():
    assert [(s.start_line, s.end_line) for s in C.windows("x\n" * 81)] == [(1, 80), (81, 81)]
    long = list(C.windows("\n".join(["y" * 100] * 80)))
    assert all(len(s.text) <= 2400 for s in long) and [s.start_line for s in long][1] == long[0].end_line + 1
    assert list(C.windows("\n" * 85 + "z"))[0].locator.startswith("generic:2:")
    assert [s.end_line for s in C.windows("\n".join(["w" * 1000] * 6))] == [1, 6]


def test_parts_example():
    text = "1234567\n" * 12
    assert [(p.start_line, p.end_line) for p in C.parts(text, 1, 12, 24)] == [(1, 3), (4, 6), (7, 9), (10, 12)]
    assert [(p.start_line, p.end_line) for p in C.parts(text, 1, 12, 24, legacy_lines=True)] == [(1, 4), (5, 8), (9, 12), (13, 16)]
    assert C.parts("short", 3, 3) == [C.Part(0, "short", 3, 3)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\r\x0bé😀", max_size=300), st.integers(1, 40))
def test_parts_concatenate(text, most):
    got = C.parts(text, 1, 1, most)
    assert "".join(p.text for p in got) == text
    assert all(len(p.text) <= most for p in got)
    if len(text) > most:
        for p in got:
            at = "".join(q.text for q in got[: p.number - 1])
            assert p.start_line == 1 + at.count("\n")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "### c", "#### d", "text", ""]), max_size=20))
def test_sections_cover_from_first_heading(lines):
    text = "\n".join(lines)
    got = list(C.sections(text))
    if any(x.startswith("#") for x in lines):
        seen = [n for s in got for n in range(s.start_line, s.end_line + 1)]
        assert seen == sorted(set(seen)) and len(got) == sum(x.startswith("#") for x in lines)


def test_read_text():
    assert C.read_text(b"a\xff\r\nb\rc") == "a\nb\nc" and C.read_text(None) == "" and C.read_text(b"\xef\xbb\xbfx") == "\ufeffx"


FILE = "relative_path string, content binary, mtime_ns bigint, text string"


def test_chunk_files_edges(spark):
    rows = [
        ("apps\\a.py", b"def f(): pass\n", 1234567890123456789, "clash"),
        ("apps/blank.md", b" \n\t", 1, None),
        ("apps/none.md", None, None, None),
        ("apps/../x.py", b"x", 1, None),
        ("other/x.py", b"x", 1, None),
        (None, b"x", 1, None),
        ("apps/no_time.txt", b"hello", None, None),
    ]
    got = {r["relative_path"]: r for r in C.chunk_files(spark.createDataFrame(rows, FILE)).collect()}
    assert set(got) == {"apps/a.py", "apps/no_time.txt"}
    assert got["apps/a.py"]["mtime_ns"] == 1234567890123456789 and got["apps/no_time.txt"]["mtime_ns"] is None
    assert C.chunk_files(spark.createDataFrame([], FILE)).count() == 0


def test_chunks_equal_the_given_index(spark, data):
    from corpusloom.plans import queries

    made = queries.chunk_current_files(spark, data)
    files = queries.current_files(spark, data)
    given_rows = spark.read.parquet(f"{data}/chunks.parquet").join(files, ["repo_key", "relative_path"]).where(F.abs(F.col("source_mtime") - F.col("mtime_ns") / 1e9) < 1e-6)
    columns = ["repo_key", "chunk_id", "chunk_type", "language", "text", "start_line", "end_line", "content_hash", "symbol_path", "heading_path"]
    a, b = made.select(*columns), given_rows.select(*columns).distinct()
    assert a.count() > 50 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_settings_change_sizes(spark):
    rows = spark.createDataFrame([("apps/a.txt", ("line\n" * 30).encode(), 1, None)], FILE)
    assert C.chunk_files(rows, Settings(max_chunk_chars=50)).count() == 3

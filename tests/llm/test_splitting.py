import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import splitting as S


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#é😀\r,", max_size=600), st.integers(4, 60), st.integers(0, 25))
def test_pieces(text, limit, overlap):
    if overlap >= limit / 2:
        with pytest.raises(ValueError):
            S.bisect_text(text, limit, overlap)
        return
    got = S.bisect_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in got) == text
    assert all(e - s <= limit for s, _, e in got)
    if len(text) > limit:
        assert len(got) > 1 and got[0][0] == got[0][1] == 0
        assert all(c - s == min(overlap, c) for s, c, _ in got)
    else:
        assert got == [(0, 0, len(text))]


def test_natural_boundaries():
    text = ("word " * 30).strip() + "\n\n" + ("other " * 30).strip()
    first, second = S.bisect_text(text, 250)
    assert text[first[1] : first[2]].endswith("\n\n") and text[second[1] :].startswith("other")
    code = "def a():\n" + "    x = 1\n" * 20 + "def b():\n" + "    y = 2\n" * 20
    assert code[S.bisect_text(code, 300)[1][1] :].startswith("def b")
    assert [e - c for _, c, e in S.bisect_text("x" * 100, 30)] == [25, 25, 25, 25]


ROWS = "chunk_id string, text string, start_line int, end_line int, heading_path string, piece_no string"


def test_split_oversized(spark):
    text = "".join(f"line {i}\n" for i in range(40))
    rows = [("a", text, 11, 50, "H / K", "clash"), ("a", text, 11, 50, "H / K", None), ("b", "short", 1, 1, None, None), ("c", None, 1, 1, None, None), ("d", "z" * 200_000, None, None, None, None), ("e", "", 1, 1, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    got = S.split_oversized(df, 100, 20)
    a = sorted(got.where("chunk_id = 'a'").collect(), key=lambda r: r["piece_no"])
    assert [r["piece_no"] for r in a] == list(range(a[0]["n_pieces"])) and "".join(r["text"][r["overlap_chars"] :] for r in a) == text
    lines = text.split("\n")
    for r in a:
        assert r["heading_path"] == "H / K" and len(r["text"]) <= 100
        inside = "\n".join(lines[r["start_line"] - 11 : r["end_line"] - 11 + 1])
        assert r["text"].strip("\n") in inside
    d = got.where("chunk_id = 'd'").collect()
    assert sum(len(r["text"]) - r["overlap_chars"] for r in d) == 200_000 and {r["start_line"] for r in d} == {None}
    assert {r["chunk_id"] for r in got.collect()} == {"a", "d"}
    assert S.split_oversized(df.where("false")).count() == 0


def test_found_is_everything_over_the_limit(spark, data):
    from corpusloom.llm.queries import p3_found

    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    assert {r[0] for r in p3_found(spark, data).collect()} == {r["chunk_id"] for r in chunks.select("chunk_id", "text").collect() if len(r["text"]) > 800}

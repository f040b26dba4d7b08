import shutil

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import parsing as P

FILES = "repo_key string, relative_path string, content binary, mtime_ns bigint, verdict string"


def test_grammars():
    good = {"python": "def f():\r\n    return 1\r\n", "json": '{"a": [1, 2]}', "toml": 'a = 1\n[b]\nc = "x"\n', "yaml": "a: 1\nb:\n  - c\n", "bash": "if true; then\n  echo x\nfi\n"}
    bad = {"python": "def f(:\n", "json": '{"a": 1,}', "toml": "a = \n", "yaml": "a: [1, 2\nb: 3\n", "bash": "if true; then\n  echo x\n"}
    for name in P.GRAMMARS:
        assert P.examine(good[name], name)[0], name
        assert not P.examine(bad[name], name)[0], name
    assert P.examine("", "python")[0] and not P.examine("", "json")[0] and P.examine("", "yaml")[0]


def test_wrong_extension_and_corruption():
    assert P.examine("#!/usr/bin/env bash\nset -eu\nif [ -d x ]; then\n  echo $HOME\nfi\n", "python")[1:3] == ("wrong_extension", "bash")
    assert P.examine("[package]\nname = \"x\"\n\n[deps]\na = \"1\"\n", "json")[1:3] == ("wrong_extension", "toml")
    assert P.examine("import os\n\n\ndef f(x):\n    return os.name\n", "bash")[1:3] == ("wrong_extension", "python")
    verdict = P.examine("def f():\n    return 1\n<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> other\n", "python")
    assert verdict[1] == "corrupt" and verdict[3] == [] and set(verdict[4]) == set(P.GRAMMARS)
    assert P.examine("Some prose that is no program, at all.\n(", "json")[1] == "corrupt"


def test_deep_nesting_ends():
    assert not P.examine("(" * 5000, "python")[0]
    assert not P.examine("[" * 200_000, "json")[0]


@pytest.mark.skipif(shutil.which("bash") is None, reason="no bash")
def test_bash_takes_carriage_returns_as_characters():
    assert not P.examine("for x in a b; do\r\n  echo $x\r\ndone\r\n", "bash")[0]


def test_a_worker_without_the_grammars_fails(monkeypatch):
    monkeypatch.setattr(P, "yaml", None)
    with pytest.raises(RuntimeError):
        P.examine("a: 1\n", "yaml")
    monkeypatch.undo()
    monkeypatch.setattr(P, "_BASH", None)
    with pytest.raises(RuntimeError):
        P.examine("true\n", "bash")


def test_bash_in_one_process_agrees_with_one_each():
    texts = ["", "if", "fi", "if true; then :; fi", "cat <<E\nx", "a\\", "'", "$(", "}", "echo }; echo )", "set +n; exit 9", "trap 'exit 3' EXIT\nfalse", "return 4", "exit 3", "x() { ", "a=(1 2", "\0if", "case x in a) ;; esac", "for ((;;)); do :; done", "echo ${x", "echo $((1+", "if true; then\r\n:\r\nfi\r\n", "# é\n'"] * 12

    def alone(text):
        try:
            P._bash(text)
            return True
        except ValueError:
            return False

    assert P.bash_accepts(texts) == [alone(t) for t in texts[: len(texts) // 12]] * 12


def test_bash_runs_nothing(tmp_path):
    mark = tmp_path / "mark"
    P.bash_accepts([f"echo x > {mark}", f"set +n\necho x > {mark}", f"}}\necho x > {mark}", f")\necho x > {mark}", f"trap 'echo x > {mark}' EXIT DEBUG ERR", f"$(echo x > {mark})", f"alias a='echo x > {mark}'\na"])
    assert not mark.exists()


def test_every_grammar_is_tried():
    for text, language in (("x = 1\n", "python"), ('{"a": 1}', "json"), ("a: 1\n", "yaml"), ("if\n", "bash")):
        got = P.examine(text, language)
        assert set(got[4]) == set(P.GRAMMARS) and got[4][0] == language
    assert P.examine('{"a": 1,\n "b": [1, 2]}', "json")[3][0] == "json"
    assert P.examine('{"a": 1,\n "b": [1, 2]}', "toml")[1:3] == ("wrong_extension", "json")


def test_rank_prefers_the_evidence():
    assert P.rank_languages('{\n  "a": 1,\n  "b": 2\n}\n')[0][0] == "json"
    assert P.rank_languages("def f():\n    return self.x\n")[0][0] == "python"


def test_current_version_decides(spark):
    t = 1759000000123456789
    rows = [
        ("r", "a\\x.py", b"def f(:", t, "clash"),
        ("r", "a/x.py", b"x = 1", t + 1, None),
        ("r", "a/y.json", b"\xef\xbb\xbf{}", 1, None),
        ("r", "a/y.json", b"\xef\xbb\xbf{}", 1, None),
        ("r", "a/z.toml", b"a = 1\xff", None, None),
        (None, "a/w.yml", b"a: 1", 1, None),
        ("r", None, b"x", 1, None),
        ("r", "a/n.json", None, 1, None),
        ("r", "a/skip.md", b"(", 1, None),
        ("r", "a/long.py", b"x = 1\n" * 100_000, 1, None),
        ("r", "a/crlf.sh", b"for x in a b; do\r\n  echo $x\r\ndone\r\n", 1, None),
    ]
    df = spark.createDataFrame(rows, FILES)
    got = {(r["repo_key"], r["relative_path"]): r["parses"] for r in P.parse_files(df).collect()}
    assert got == {("r", "a/x.py"): True, ("r", "a/y.json"): True, ("r", "a/z.toml"): True, (None, "a/w.yml"): True, ("r", "a/n.json"): False, ("r", "a/long.py"): True, ("r", "a/crlf.sh"): True}
    rates = {r["language"]: (r["n_files"], r["n_failed"], r["failure_rate"]) for r in P.parse_rates(df).where("repo_key is not null").collect()}
    assert rates["json"] == (2, 1, 0.5) and rates["python"] == (2, 0, 0.0)
    assert P.parse_files(df.where("false")).count() == 0 and P.parse_rates(df.where("false")).count() == 0


def test_all_tables(spark, data):
    files = spark.read.parquet(f"{data}/source_files.parquet")
    got = P.parse_files(files)
    assert got.where(F.col("verdict").isNull()).count() == 0 and got.count() == got.select("repo_key", "relative_path").distinct().count()

import json
import os
import time

import pytest

from corpusloom.config import Settings
from corpusloom.plans.engine import Engine
from corpusloom.sources.crawl import crawl, query_set
from corpusloom.streaming.watch import Watcher, difference, snapshot


def write(root, path, body):
    f = root / path
    f.parent.mkdir(parents=True, exist_ok=True)
    f.write_bytes(body if isinstance(body, bytes) else body.encode())
    return f


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    write(root, "apps/__init__.py", "def boot():\n    return 1\n")
    write(root, "apps/_u.py", "SLOT_CONFIG_MASTER_KEY = 1\n")
    write(root, "apps/.hidden/x.py", "x = 1\n")
    write(root, "apps/b.bin", b"\0\1")
    write(root, "apps/.env.py", "SECRET = 1\n")
    write(root, "apps/node_modules/m.json", "{}")
    write(root, "docs/a.md", "# Window\n\nThe merged window is rebuilt.\n\n## Part\n\nпосле перезапуска\n")
    write(root, "README.md", "# root\n")
    return root


@pytest.fixture
def engine(spark, tree, tmp_path):
    return Engine(spark, str(tmp_path / "store"), Settings(repo_root=str(tree), repo_key="demo", watch_debounce_sec=1))


def paths_of(engine):
    return {r["relative_path"] for r in engine.store.chunks().select("relative_path").collect()}


def test_crawl(spark, tree):
    settings = Settings(repo_root=str(tree))
    rows = {r["relative_path"]: r for r in crawl(spark, str(tree), settings).collect()}
    assert set(rows) == {"apps/__init__.py", "apps/_u.py", "apps/.hidden/x.py", "docs/a.md"}
    stat = os.stat(tree / "apps/_u.py")
    assert rows["apps/_u.py"]["mtime_ns"] == stat.st_mtime_ns and rows["apps/_u.py"]["size"] == stat.st_size and bytes(rows["apps/_u.py"]["content"]).startswith(b"SLOT")
    loose = Settings(repo_root=str(tree), safe_excludes=False)
    assert "apps/node_modules/m.json" in {r["relative_path"] for r in crawl(spark, str(tree), loose, content=False).collect()}


def test_rebuild_search_and_status(engine):
    assert engine.index_status()["collections"][0]["points"] == 0 and engine.semantic_search("x").count() == 0 and engine.hybrid_search("x").count() == 0
    done = engine.rebuild_index()
    assert done["rebuild"] == {"code": 3, "docs": 2}
    assert [r["relative_path"] for r in engine.hybrid_search("SLOT_CONFIG_MASTER_KEY", 1).collect()] == ["apps/_u.py"]
    top = engine.semantic_search_docs("merged window rebuilt", top_k=2).collect()
    assert top[0]["heading_path"] == "Window" and top[0]["score"] >= top[1]["score"] and "text" not in top[0].asDict()
    assert engine.semantic_search_code("window", path_prefix="docs/").count() == 0
    assert {r["scope"] for r in engine.hybrid_search_docs("window").collect()} == {"docs"}
    one = top[0]["chunk_id"]
    assert engine.read_chunk("docs", one).first()["text"].startswith("# Window")
    assert engine.read_chunk("code", one).count() == 0
    with pytest.raises(ValueError):
        engine.read_chunk("all", one)
    assert one not in {r["chunk_id"] for r in engine.find_similar_chunk("docs", one).collect()}
    assert engine.find_similar_chunk("docs", one, stored_vector=True).count() == 1
    assert engine.find_similar_chunk("docs", "missing").count() == 0
    assert json.loads(engine.resource("index://collections"))[0]["name"].endswith("_code_v1")
    assert engine.store.postings().where("term = 'window'").count() == 1
    with pytest.raises(KeyError):
        engine.resource("index://other")


def test_reindex_and_reconcile(engine, tree):
    engine.rebuild_index()
    before = {r["content_hash"] for r in engine.store.chunks().collect()}
    assert engine.reconcile_index() == {"touched": []}
    write(tree, "apps/_u.py", "SLOT = 2\n")
    write(tree, "apps/new.py", "def n(): pass\n")
    os.utime(tree / "apps/_u.py", ns=(1, 1759000000123456789))
    (tree / "docs/a.md").unlink()
    assert engine.reconcile_index()["touched"] == ["apps/_u.py", "apps/new.py", "docs/a.md"]
    assert paths_of(engine) == {"apps/__init__.py", "apps/_u.py", "apps/.hidden/x.py", "apps/new.py"} and engine.store.count("docs") == 0
    after = engine.store.chunks().collect()
    engine.rebuild_index()
    assert sorted((r["chunk_id"], r["text"]) for r in after) == sorted((r["chunk_id"], r["text"]) for r in engine.store.chunks().collect())
    assert {r["content_hash"] for r in after} != before
    assert engine.reconcile_index(by_hash=True) == {"touched": []}
    engine.reindex_paths(["apps\\new.py", "../outside.py"])
    assert "apps/new.py" in paths_of(engine)
    engine.store.delete_paths(["apps/new.py"])
    assert "apps/new.py" not in paths_of(engine)


def test_a_reader_keeps_its_version(engine, tree):
    engine.rebuild_index()
    held = engine.store.chunks()
    n = held.count()
    (tree / "docs/a.md").unlink()
    engine.rebuild_index()
    assert held.count() == n and engine.store.chunks().count() < n


def test_a_change_rewrites_its_bucket_alone(engine, tree, monkeypatch):
    for i in range(40):
        write(tree, f"apps/many/m{i}.py", f"def f{i}():\n    return {i}\n")
    engine.rebuild_index()
    old = engine.store.meta()
    write(tree, "apps/many/m7.py", "def changed():\n    return 0\n")
    os.chmod(tree / "apps/many/m8.py", 0)
    monkeypatch.setattr("corpusloom.plans.engine.crawl", None)  # the tree is not walked
    engine.reindex_paths(["apps/many/m7.py"])
    new = engine.store.meta()
    assert sum(new["parts"][b] != v for b, v in old["parts"].items()) == 1 and len(old["parts"]) > 1
    assert sum(new["file_parts"][b] != v for b, v in old["file_parts"].items()) == 1
    assert engine.store.chunks().where("text like '%changed%'").count() == 1 and engine.store.count("code") == old["counts"]["code"]
    assert engine.store.manifest().count() == 44


def test_old_versions_go(engine, tree):
    engine.rebuild_index()
    folders = lambda: {p for p in (tree.parent / "store").rglob("version=*") if p.is_dir()}
    first = folders()
    for i in range(3):
        write(tree, "docs/a.md", f"# Window {i}\n")
        engine.reindex_paths(["docs/a.md"])
    assert first - folders() and all(engine.store.chunks().where("relative_path = 'docs/a.md'").first()["text"].endswith(str(2)) for _ in "x")


def test_stored_bags_score_as_the_texts_do(engine, tree):
    from pyspark.sql import functions as F

    from corpusloom.operators import search

    for i in range(12):
        write(tree, f"apps/w{i}.py", f"def window_{i}():\n    return 'merged window' * {i}\n")
    engine.rebuild_index()
    write(tree, "docs/b.md", "# Other\n\nmerged window merged\n")
    engine.reindex_paths(["docs/b.md"])
    for keep in (None, search.chunk_filter(path_prefix="apps/"), search.chunk_filter(domain_tags=["docs"])):
        stored = {(r["scope"], r["chunk_id"]): round(r["lexical_raw"], 9) for r in engine.store.lexical_scores("the merged window merged", keep=keep).collect()}
        rows = engine.store.chunks().where(F.lit(True) if keep is None else keep)
        assert stored == {(r["scope"], r["chunk_id"]): round(r["lexical_raw"], 9) for r in search.bm25(rows, "the merged window merged", by=("scope",)).collect()}
    plan = engine.hybrid_search("merged window", 3)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "In(term" in plan.replace(" ", "")


def test_lookup_of_many(engine, spark):
    engine.rebuild_index()
    some = engine.store.chunks().select("scope", "chunk_id").limit(2).collect()
    wanted = spark.createDataFrame([*some, *some, ("code", "missing")], "scope string, chunk_id string")
    assert engine.store.lookup(wanted).count() == 2 and engine.store.chunk("code", "missing").count() == 0


def test_two_writers(engine):
    with engine.store.locked():
        with pytest.raises(TimeoutError):
            with engine.store.locked(wait_seconds=0.2):
                pass


def test_boot(engine):
    assert engine.boot()["rebuild"] == {"code": 3, "docs": 2}
    assert engine.boot() == {"touched": []}


def test_difference():
    assert difference({"a": 1, "b": 1, "c": 1}, {"a": 1, "b": 2, "d": 1}) == [("b", "changed"), ("c", "deleted"), ("d", "new")]


def test_watcher_sees_edits_and_survives_a_restart(engine, tree, tmp_path):
    engine.rebuild_index()
    watcher = Watcher(engine, str(tmp_path / "watch"))
    watcher.start()
    watcher.start()
    assert watcher.is_running() and engine.index_status()["watcher_running"]

    def wait_for(condition):
        until = time.time() + 60
        while not condition() and time.time() < until:
            time.sleep(0.5)
        assert condition()

    wait_for(lambda: (tmp_path / "watch/state/0.json").exists())
    write(tree, "apps/later.py", "def later(): pass\n")
    wait_for(lambda: "apps/later.py" in paths_of(engine))
    watcher.stop()
    assert not watcher.is_running()
    (tree / "apps/later.py").unlink()
    write(tree, "docs/a.md", "# Only\n")
    watcher.start()
    wait_for(lambda: "apps/later.py" not in paths_of(engine) and engine.store.count("docs") == 1)
    watcher.stop()
    assert snapshot(str(tree))


def test_query_set(spark, tmp_path):
    f = write(tmp_path, "q.json", json.dumps([{"name": "a", "query": "b", "expected_any": ["x"]}, {"name": "c", "query": "d"}]))
    assert [(r["name"], r["expected_any"]) for r in query_set(spark, str(f)).orderBy("name").collect()] == [("a", ["x"]), ("c", None)]

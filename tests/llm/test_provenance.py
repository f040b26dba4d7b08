import json
import random

from corpusloom.llm import provenance as P

FILES = "repo_key string, relative_path string, content binary, mtime_ns bigint, kind string, lines string"
HAND = '''"""Helpers for windows."""

import os

LIMIT = 20


def rebuild(window, force=False):
    """Rebuild a window by hand; do not edit the cache."""
    if force or window.stale:
        for part in window.parts:
            part.load(os.getcwd())
    return [p.name for p in window.parts if p.size > LIMIT]


class Reader:
    def read(self, path):
        with open(path) as f:
            return f.read().strip()
'''


def kind(path, text):
    return P.judge(path, text)[0]


def test_generated():
    fields = "".join(f"    field_{i} = Field(number={i}, kind=4, label='x', default={i * 97})\n" for i in range(1, 20))
    heads = [
        "# Code generated by rogodogen v6.12; DO NOT EDIT.\n",
        "# @generated by tool from meter.idl\n",
        "# AUTO-GENERATED FILE - see version.idl\n",
        "# Dieser Quelltext wird von pamelogen erzeugt.\n",
        "# Автоматически создано утилитой ledepegen, не править вручную\n",
        "# Machine written on every build from ring.idl; edit the template, not this.\n",
        "# This file was automatically created by mileragen. Changes will be lost.\n",
        '# <auto-generated tool="x" input="y.tmpl"/>\n',
    ]
    for h in heads:
        assert kind("apps/a.py", h + HAND) == "generated", h
    assert kind("apps/a.py", "from runtime import Field\n\nclass A:\n" + fields) in ("generated", "data")
    lock = '{\n  "packages": {\n' + "".join(f'    "p{i}": {{\n      "version": "1.2.{i}",\n      "integrity": "sha512-{"aB3" * 20}"\n    }},\n' for i in range(5)) + "  }\n}\n"
    assert kind("apps/package-lock.json", lock) == "generated" and kind("apps/x.json", lock) == "generated"


def test_notes_below_a_long_licence():
    licence = "".join(f"# The text may be used{' as it stands' * i}.\n" for i in range(20))
    assert kind("apps/a.py", licence + HAND) is None
    assert kind("apps/a.py", licence + "# Code generated by rogodogen v6.12; DO NOT EDIT.\n" + HAND) == "generated"
    assert P.judge("apps/a.py", licence + "# Upstream: https://x.example/lib\n" + HAND)[1]
    assert kind("apps/a.py", licence + HAND + "# Code generated by rogodogen v6.12; DO NOT EDIT.\n") is None


def test_hand_written():
    assert kind("services/report_generator-x/minify.py", HAND) is None
    assert kind("apps/generated_report_reader.py", HAND.replace("Helpers", "Reads the generated report")) is None
    assert kind("docs/generated_report_reader.md", "# Reader\n\nThe report is generated by a tool. Do not edit it.\n") is None
    assert kind("apps/vendor_terms.py", HAND) is None and not P.judge("services/vendor_portal-1/x.py", HAND)[1]
    assert kind("apps/s.sql", "CREATE TABLE t (\n" + "".join(f"  c{i} INT NOT NULL,\n" for i in range(15)) + "  z INT\n);\n") is None
    assert kind("apps/s.toml", "checksum_topic = \"" + "a1" * 32 + '"\n' + "".join(f'k{i} = "v-{i}"\n' for i in range(12))) is None
    assert kind("apps/c.py", "".join(f"{n.upper()}_LIMIT = {i * 997 + 1000}\n" for i, n in enumerate("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()))) is None
    assert kind("apps/e.py", "") is None


def test_minified_and_data():
    r = random.Random(1)
    mini = ";".join(f"{r.choice('abcdef')}_=[x_,y_,{i}];z_=lambda q_:q_*{i}" for i in range(120))
    assert kind("apps/a.py", mini) == "minified"
    assert kind("apps/a.json", "{" + ",".join(f'"k{i}":[{i},{i * 7},{i * 13}]' for i in range(200)) + "}") in ("minified", "data")
    blob = "".join(r.choices("ABCDEFGHabcdefgh0123456789+/", k=2000))
    assert kind("apps/d.py", 'X = """\n' + "\n".join(blob[i : i + 76] for i in range(0, 2000, 76)) + '\n"""\n') == "data"
    assert kind("apps/d.sql", "".join(f"INSERT INTO t VALUES ({r.randrange(10**6)}, 'ab', {r.random()}, '{r.randrange(10**12):x}');\n" for _ in range(30))) == "data"
    assert kind("apps/d.py", "X = [\n" + "".join("    [" + ", ".join(str(r.randrange(10**5)) for _ in range(8)) + "],\n" for _ in range(20)) + "]\n") == "data"


def library(seed):
    r = random.Random(seed)
    words = "load save open close merge split rank trim queue cache stage probe".split()
    w = lambda: r.choice(words) + "_" + "".join(r.choices("abcdefgh", k=6))
    forms = ["    {} = self.{}({})", "    if {} > {}.{}:", "        return {}.{}({}, {})", "    for {} in {}.{}():", "        {}.append({} + {})", "    with {}({}) as {}:", "    # {} {} {}", "    assert {} is not {}, {}"]
    return "\n".join(r.choice(forms).format(*(w() for _ in range(4))) for _ in range(60)) + "\n"


def test_vendored_copies_without_marks(spark):
    lib = library(1)
    edited = "import os\n" + lib.replace("load", "fetch", 6)
    rows = [
        ("r1", "apps\\u\\vendor\\lib\\a.py", "# Part of the lib library, upstream release 1.2\n" + lib),
        ("r2", "apps/x/copied.py", edited),
        ("r3", "apps/x/own.py", library(2)),
        ("r4", "apps/y/own_copy.py", library(2)),
        ("r1", "apps/x/near_it.py", library(3) + lib[:300]),
        ("r1", "services/vendor_portal/z.py", HAND),
        ("r5", "apps/z.md", "# Part of the lib library, upstream release 1.2\n"),
    ]
    df = spark.createDataFrame([(a, b, c.encode(), 1, "clash", None) for a, b, c in rows], FILES)
    got = {(r["repo_key"], r["relative_path"]): (r["kind"], r["containment"]) for r in P.classify_files(df).collect()}
    assert got[("r1", "apps/u/vendor/lib/a.py")][0] == "vendored"
    assert got[("r2", "apps/x/copied.py")][0] == "vendored" and 0.5 < got[("r2", "apps/x/copied.py")][1] < 1
    assert {k for k, v in got.items() if v[0]} == {("r1", "apps/u/vendor/lib/a.py"), ("r2", "apps/x/copied.py")}


def test_containment_is_measured_for_every_file(spark):
    mark = "# Part of the lib library, upstream release 1.2\n"
    everywhere = library(6)
    rows = [
        ("r1", "apps/vendor/one.py", mark + library(1)),
        ("r1", "apps/x/same_repository.py", library(1)),
        ("r2", "apps/y/alone.py", mark + library(4)),
        ("r3", "apps/y/twin.py", mark + library(5)),
        ("r4", "apps/y/twin.py", mark + library(5) + library(7)),
        *[(f"r{i}", "libs/spread.py", mark + everywhere) for i in range(1, 6)],
        ("r6", "libs/stripped.py", everywhere),
    ]
    df = spark.createDataFrame([(a, b, c.encode(), 1, "clash", None) for a, b, c in rows], FILES)
    got = {(r["repo_key"], r["relative_path"]): (r["kind"], r["containment"]) for r in P.classify_files(df).collect()}
    assert {k for k, _ in got.values()} == {"vendored"}
    assert got[("r1", "apps/x/same_repository.py")][1] == got[("r6", "libs/stripped.py")][1] == 1
    assert got[("r2", "apps/y/alone.py")][1] < 0.1 and got[("r3", "apps/y/twin.py")][1] == 1
    assert 0.4 < got[("r4", "apps/y/twin.py")][1] < 0.6


def test_edges(spark):
    t = 1759000000123456789
    rows = [
        ("r", "apps/a.py", b"# @generated by x\nx = 1\n", t),
        ("r", "apps\\a.py", HAND.encode(), t + 1),
        ("r", "apps/b.py", b"# @generated by x\nx = 1\n", None),
        (None, "apps/c.py", b"\xff\xfe", 1),
        ("r", None, b"# @generated", 1),
        ("r", "apps/d.py", None, 1),
        ("r", "apps/e.json", b"[1,2,3]," * 50_000, 1),
    ]
    df = spark.createDataFrame([(*x, "clash", None) for x in rows], FILES)
    got = {(r["repo_key"], r["relative_path"]): r["kind"] for r in P.classify_files(df).collect()}
    assert got == {("r", "apps/a.py"): None, ("r", "apps/b.py"): "generated", (None, "apps/c.py"): None, ("r", "apps/d.py"): None, ("r", "apps/e.json"): "minified"}
    assert P.classify_files(df.where("false")).count() == 0


def found(spark, rows):
    df = spark.createDataFrame([(a, b, c.encode(), 1, "clash", None) for a, b, c in rows], FILES)
    return {(r["repo_key"], r["relative_path"]): (r["kind"], r["evidence"], r["containment"]) for r in P.classify_files(df).collect()}


def test_families_without_any_mark(spark):
    lib, house, pair = library(11), library(12), library(13)
    rows = [
        ("r1", "apps/x/mekato/views.py", lib),
        ("r2", "libs/y/mekato/store.py", "import os\n" + lib.replace("load", "fetch", 4)),
        ("r3", "tools/z/parcel/core.py", lib),
        ("r1", "apps/a/one.py", house),
        ("r2", "libs/b/two.py", house),
        ("r3", "tools/c/three.py", house.replace("save", "keep", 3)),
        ("r1", "apps/d/same/one.py", pair),
        ("r2", "apps/e/same/one.py", pair),
        ("r1", "docs/same/a.md", library(14)),
        ("r2", "docs/same/a.md", library(14)),
        ("r3", "docs/same/a.md", library(14)),
    ]
    got = found(spark, rows)
    assert {k for k, v in got.items() if v[0]} == {x[:2] for x in rows[:3]}
    assert {got[x[:2]][1] for x in rows[:3]} == {"copies"} and got[("r3", "tools/z/parcel/core.py")][2] == 1
    assert got[("r1", "apps/d/same/one.py")] == (None, None, 1.0)


def test_a_folder_name_only_supports(spark):
    rows = [
        ("r1", "services/api/deps/wiring.py", "import os\nX = 1\nY = os.name\n"),
        ("r1", "services/api/deps/kimesa/broken.py", "some text that was put here\n"),
        ("r2", "services/up/kimesa/core.py", "# Part of the kimesa library, upstream release 1.2\n" + library(3)),
        ("r3", "apps/vendor/libx/a.py", library(4)),
        ("r4", "apps/copy/a.py", library(4)),
        ("r3", "apps/vendor/liby/a.py", library(5)),
    ]
    got = found(spark, rows)
    assert got[("r1", "services/api/deps/wiring.py")][0] is None and got[("r3", "apps/vendor/liby/a.py")][0] is None
    assert got[("r1", "services/api/deps/kimesa/broken.py")][1] == "package"
    assert got[("r3", "apps/vendor/libx/a.py")][1] == got[("r4", "apps/copy/a.py")][1] == "marked_copy"


def test_one_repository_may_hold_most_copies(spark):
    base = library(21).split("\n")
    near = ["\n".join([f"import part_{i}", *base[: 30 + i % 20]]) for i in range(60)]
    rows = [("big", f"apps/u{i}/a.py", t) for i, t in enumerate(near)] + [("r2", "libs/v/pack/a.py", "\n".join(base)), ("r3", "tools/w/pack/b.py", "\n".join(base[2:]))]
    got = found(spark, rows)
    assert got[("r2", "libs/v/pack/a.py")][1] == got[("r3", "tools/w/pack/b.py")][1] == "copies"
    assert {got[(a, b)][1] for a, b, _ in rows[:60]} == {"copies"}


def test_pair_counts_against_brute_force(spark):
    import itertools

    r = random.Random(5)
    pool = [f"    line_{i} = call({i})" for i in range(120)]
    rows = [(f"r{i % 7}", f"apps/u{i}/f.py", "\n".join(r.sample(pool, 30) + [f"own_{i} = {j}" for j in range(5)])) for i in range(40)]
    rows.append(("r3", "apps/again/f.py", rows[0][2]))
    got = found(spark, rows)
    sets = {x[:2]: {y.strip() for y in x[2].split("\n")} for x in rows}
    repos = {}
    for (repo, _), lines in sets.items():
        for x in lines:
            repos.setdefault(x, set()).add(repo)
    best = dict.fromkeys(sets, 0.0)
    for a, b in itertools.permutations(sets, 2):
        if a[0] != b[0]:
            rare = {x for x in sets[a] if len(repos[x]) <= 8}
            best[a] = max(best[a], len(rare & sets[b]) / len(rare))
    assert {k: round(v, 4) for k, v in best.items()} == {k: v[2] for k, v in got.items()}


def test_notebooks_and_lines_of_middle_length():
    cell = json.dumps("# zaro 1.2 - Copyright (c) the zaro authors.\nimport re\n")
    book = '{\n "cells": [\n  {\n   "kind": "code",\n   "source": ' + cell + ",\n   "
    assert P.has_marks("apps/a.py", P.notebook_source(book)) and P.notebook_source(HAND) == HAND
    mini = "\n".join(";".join(f"a{i}_=[b_,c_,{i * j}]" for i in range(18)) for j in range(1, 7))
    assert max(map(len, mini.split("\n"))) < 300 and kind("apps/a.py", mini) == "minified"

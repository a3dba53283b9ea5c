"""Projects, worktrees, quoted paths and survival, by cases whose answer is known."""

import re

import pytest
from pyspark.sql import functions as F

from meterloom.operators import repos, surfaces

ENTRIES = [
    ("/home/a/mono", None), ("/home/a/mono/vendor/inner", None), ("/home/a/sub", "gitdir: ../mono/.git/modules/sub\n"),
    ("/tmp/wt/feature", "gitdir: /home/a/mono/.git/worktrees/feature\n"), ("/home/a/rel", "# note\n gitdir:  ../mono/.git/worktrees/rel \n"),
    ("/home/a/mono/in", "gitdir: ../.git/worktrees/in"), ("/home/a/odd", "nothing here"), ("/srv/", None),
]
WANTED = {
    "/home/a/mono": ("mono", ""), "/home/a/mono/apps/mobile": ("mono", "apps/mobile"), "/home/a/mono/./apps//x/../mobile/": ("mono", "apps/mobile"),
    "/home/a/mono/vendor/inner/pkg": ("inner", "pkg"), "/home/a/sub/x": ("sub", "x"),
    "/tmp/wt/feature": ("mono", ""), "/tmp/wt/feature/deep": ("mono", ""), "/home/a/rel": ("mono", ""), "/home/a/mono/in/apps": ("mono", "in/apps"),
    "/home/a/odd/y": ("odd", "y"), "/nowhere/at/all": ("all", ""), "/": ("/", ""), "/home/a/monorail": ("monorail", ""), "/srv/api": ("srv", "api"),
}


def test_folders_resolve_to_repositories(spark):
    roots = repos.roots(spark.createDataFrame(ENTRIES, "dir string, pointer string"))
    found = repos.resolved(spark.createDataFrame([(c,) for c in [*WANTED, "", None, "/home/a/mono"]], "cwd string"), roots)
    assert {x.cwd: (x.project, x.subpath) for x in found.collect()} == WANTED
    records = spark.createDataFrame([(1, "/home/a/mono/apps", "apps", ""), (2, "", "kept", "s"), (3, None, "kept", "")], "n int, cwd string, project string, subpath string")
    got = repos.with_projects(records, roots).orderBy("n").collect()
    assert [(x.project, x.subpath) for x in got] == [("mono", "apps"), ("kept", "s"), ("kept", "")]


@pytest.mark.parametrize(("said", "path"), [
    ("plain.go", "plain.go"), ('"caf\\303\\251.go"', "café.go"), ('"a\\tb\\"c\\\\d.md"', 'a\tb"c\\d.md'), ('"', '"'), ('""', ""), ('"bad\\q"', '"bad\\q"'), ('"end\\"', '"end\\"'),
    ('"in"side"', '"in"side"'), ('"\\777"', '"\\777"'), ("old.go => new.go", "new.go"), ("src/{a => b}/x.go", "src/b/x.go"), ("src/{ => b}/x.go", "src/b/x.go"), ("src/{a => }/x.go", "src/x.go"),
    ('"caf\\303\\251.go" => "th\\303\\251.go"', "thé.go"), ("a{b => c", "c"),
])
def test_paths_of_numstat(spark, said, path):
    assert spark.createDataFrame([(said,)], "p string").select(repos.unquoted(repos.renamed_to(F.col("p")))).first()[0] == path


def test_quoted_paths_have_their_kind(spark):
    rows = spark.createDataFrame([('"docs/r\\303\\251sum\\303\\251.md"',), ('"t\\303\\251st.go"',)], "p string")
    assert [x[0] for x in rows.select(surfaces.path_kind(repos.unquoted(F.col("p")))).collect()] == ["docs", "source"]


A, B, M, R = ("a" * 40, "b" * 64, "c" * 40, "d" * 40)


def log_of(spark):
    lines = [f"commit:{A} parents:{R} subject:one", "", "3\t0\tx.go", "2\t1\told.md => new.md", "-\t-\timg.png", f"commit:{B} parents:{A} subject:Revert \"one\"", "", '1\t0\t"caf\\303\\251.go"', f"commit:{M} parents:{A} {B} subject:Merge"]
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, seq long, line string")


def test_survival_of_blame(spark):
    changes = repos.numstat(log_of(spark))
    block = lambda h, n: [f"{h} {n} {n} 1", "author x", f"summary {A} is no header", "filename x.go", f"\t{B} 1 1 content"]
    text = [("x.go", x) for n, h in enumerate([A, A, M, R]) for x in block(h, n)] + [("café.go", x) for x in [f"{B} 1 1 2", "author y", "\tl", f"{B} 2 2", "\tl"]] + [("other.go", f"{A} 1 1 1")]
    blame = repos.blamed(spark.createDataFrame(text, "path string, line string"))
    read = spark.createDataFrame([("x.go",), ("café.go",), ("other.go",)], "path string")
    got = repos.survival(changes, blame, read).first().asDict()
    assert got == {
        "commits": 3, "merges": 1, "reverts": 1, "added": 6, "files": 2, "unreadable": 1, "surviving": 4, "merge_lines": 1,
        "source": 2, "test": 0, "docs": 1, "config": 0, "generated": 0, "other": 1, "rate": round(4 / 6, 6),
    }


def test_no_task_holds_a_whole_log(spark, monkeypatch):
    wanted = sorted(map(str, repos.numstat(log_of(spark)).collect()))
    for bits in (0, 1, 2):
        monkeypatch.setattr(repos, "STRETCH", bits)
        told = repos.numstat(log_of(spark))
        assert sorted(map(str, told.collect())) == wanted
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "[file#" in plan and not re.search(r"Window [^\n]*\], \[file#\d+\], \[seq#", plan)


def test_conditions_on_paths_do_not_read_them_again(spark):
    told = repos.numstat(log_of(spark)).where("path <> ''")
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_survival_of_nothing(spark):
    none = repos.numstat(log_of(spark).limit(0))
    got = repos.survival(none, repos.blamed(spark.createDataFrame([], "path string, line string")), spark.createDataFrame([], "path string")).first()
    assert (got.commits, got.added, got.surviving, got.unreadable, got.rate) == (0, 0, 0, 0, -1.0)

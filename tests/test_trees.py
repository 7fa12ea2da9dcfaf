"""Tree source and guarded sink: what is entered, what is refused, and what a lost task leaves."""

import os
import subprocess
import sys
import textwrap

import pytest

from tessera.sources import trees

FILES = {
    "a.ts": "a", "deep/x/y/z.md": "z", "deep/.hidden/h.md": "h", ".memory/m.md": "m", "node_modules/n.js": "n", "logs/keep.log": "k", "logs/b.log": "b", "other/gen/g.ts": "g", "other/gen2/g.ts": "g",
    ".gitignore": "# all\n*.log\n!keep.log\n/other/gen/\n", "deep/.gitignore": "x/y/z.md\n!a.ts\n", ".DS_Store": "d", "nul.bin": "a\0b", "wide/1": "1", "wide/2": "2", "wide/3": "3",
}
KEPT = {"a.ts", ".memory/m.md", "logs/keep.log", "other/gen2/g.ts", ".gitignore", "deep/.gitignore", "nul.bin", "wide/1", "wide/2", "wide/3"}


def lay(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.mark.parametrize("splits", [1, 3, 1000])
def test_tree_enters_what_it_should_once(spark, tmp_path, splits):
    root, away = tmp_path / "root", tmp_path / "away"
    lay(root, FILES)
    lay(away, {"secret.md": "s"})
    (root / "out.md").symlink_to(away / "secret.md")
    (root / "outdir").symlink_to(away)
    (root / "in.md").symlink_to(root / "a.ts")
    rows = trees.read_tree(spark, str(root), splits=splits).collect()
    got = {r.path: r for r in rows if r.reason is None}
    assert set(got) == KEPT | {"in.md"} and len(rows) == len({r.path for r in rows})
    assert {r.path: r.reason for r in rows if r.reason} == {"deep/.hidden": "excluded-folder", "node_modules": "excluded-folder", "logs/b.log": "ignored", "other/gen": "ignored", "deep/x/y/z.md": "ignored", "out.md": "symlink-escape", "outdir": "symlink-escape"}
    assert got["in.md"].text == "a" and got["a.ts"].size == 1 and got["nul.bin"].has_nul and got["nul.bin"].text is None


def test_tree_options(spark, tmp_path, monkeypatch):
    lay(tmp_path, FILES)
    monkeypatch.setattr(trees, "NAMES", 2)  # the wide folder is read in shares
    walk = trees.Walk(str(tmp_path), trees.SKIP_FOLDERS, trees.HIDDEN_KEPT, trees.IGNORE_FILE)
    planned = walk.folders(1000)
    assert [f.parts for f in planned if f.path == "wide"] == [2, 2]
    assert {path for f in planned for path, _, reason in walk.files(f) if reason is None} == KEPT
    assert sum(1 for f in planned for _ in walk.files(f)) == len({p for f in planned for p, _, _ in walk.files(f)})
    all_in = trees.read_tree(spark, f"file://{tmp_path}", ignore="", keep=".hidden\n.memory", skip="logs", max_bytes=3)
    got = {r.path: r.text for r in all_in.where("reason IS NULL").collect()}
    assert "node_modules/n.js" in got and "deep/.hidden/h.md" in got and "logs/b.log" not in got and got[".gitignore"] is None
    assert trees.read_tree(spark, str(tmp_path / "gone")).count() == 0
    with pytest.raises(ValueError):
        trees.local_path("s3://bucket/root")


def write(spark, root, rows, job=None, parts=2):
    trees.write_files(spark.createDataFrame(rows, "path string, text string").repartition(parts), str(root), "gen/memory", job)


def below(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if "/.jobs" not in d}


def test_guarded_sink(spark, tmp_path):
    write(spark, tmp_path, [("gen/memory/a.md", "one\n<!-- human:start -->\nmine\n<!-- human:end -->\n"), ("gen/memory/b/c.md", None)], "j1")
    write(spark, tmp_path, [("gen/memory/a.md", "two\n")], "j2")
    write(spark, tmp_path, [("gen/memory/a.md", "three\n")], "j2")  # a replay
    assert (tmp_path / "gen/memory/a.md").read_text() == "two\n\n<!-- human:start -->\nmine\n<!-- human:end -->\n"
    assert below(tmp_path) == {"gen/memory/a.md", "gen/memory/b/c.md"} and (tmp_path / "gen/memory/b/c.md").read_text() == ""
    assert trees.delete_folder(str(tmp_path), "gen/memory") and not trees.delete_folder(str(tmp_path), "gen/memory") and below(tmp_path) == set()


@pytest.mark.parametrize("path", ["gen/other.md", "gen/memory", "gen/memory/../x.md", "/gen/memory/x.md", "gen\\memory\\..\\x.md", None, "gen/memory//x.md", "gen/memory/link/x.md"])
def test_guarded_sink_refuses(spark, tmp_path, path):
    (tmp_path / "gen/memory").mkdir(parents=True)
    (tmp_path / "gen/memory/link").symlink_to(tmp_path)
    with pytest.raises(Exception, match="isn't below|leads out"):
        write(spark, tmp_path, [("gen/memory/good.md", "g"), (path, "bad")])
    assert not (tmp_path / "gen/memory/good.md").exists() and not (tmp_path / "x.md").exists()  # all or nothing
    assert not list((tmp_path / "gen/memory/.drafts").glob("*"))


def test_guarded_sink_writes_a_path_once(spark, tmp_path):
    with pytest.raises(Exception, match="written twice"):
        write(spark, tmp_path, [("gen/memory/a.md", "x"), ("gen/memory/a.md", "y")])
    assert below(tmp_path) == set()


def test_a_killed_task_is_run_again(tmp_path):
    """A task's process dies midway once; the job ends well, with one draft of each file and nothing left over."""
    script = f"""
        import os, sys
        from pyspark.sql import SparkSession
        from tessera.sources import trees
        spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.local.dir", "{tmp_path}/local").getOrCreate()
        def die(batches):
            for b in batches:
                for i in b["id"]:
                    if i == 7 and not os.path.exists("{tmp_path}/died"):
                        open("{tmp_path}/died", "w").close()
                        os._exit(1)
                yield b
        rows = spark.range(0, 20, 1, 4).mapInPandas(die, "id long").selectExpr("concat('gen/memory/', id, '.md') AS path", "cast(id AS string) AS text")
        trees.write_files(rows, "{tmp_path}", "gen/memory", "job")
    """
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "died").exists()
    assert {p.name: p.read_text() for p in (tmp_path / "gen/memory").glob("*.md")} == {f"{i}.md": str(i) for i in range(20)}
    assert not list((tmp_path / "gen/memory/.drafts").glob("*"))


def test_a_replay_drafts_nothing_and_naming_goes_on_where_it_was_cut_off(spark, tmp_path, monkeypatch):
    block = "<!-- human:start -->\nmine\n<!-- human:end -->"
    write(spark, tmp_path, [(f"gen/memory/{i}.md", f"{i}\n{block}\n") for i in range(9)], "j1")
    options = {"root": str(tmp_path), "within": "gen/memory"}
    replay = trees.GuardedWriter(options | {"job": "j1"})
    assert replay.done and os.listdir(replay.write(iter([{"path": "gen/memory/0.md", "text": "x"}])).folder) == ["names"]
    with pytest.raises(trees.OutsideFolder):
        replay.write(iter([{"path": "gen/x.md", "text": "x"}]))
    replay.commit([])
    second = trees.GuardedWriter(options | {"job": "j2"})
    drafts = second.write(iter([{"path": f"gen/memory/{i}.md", "text": f"new {i}\n"} for i in range(9)])).folder
    assert trees.name_drafts(str(tmp_path), drafts) == trees.name_drafts(str(tmp_path), drafts) == 9  # the second run finds all named
    assert (tmp_path / "gen/memory/8.md").read_text() == f"new 8\n\n{block}\n"
    second.abort([])
    monkeypatch.setattr(trees, "name_drafts", None)  # the driver names nothing
    trees.GuardedWriter(options | {"job": "j3", "attempt": "a"}).commit([])
    assert (tmp_path / "gen/memory/.drafts/a/folders").exists()


def test_wide_folders_have_shares_of_a_fixed_number(tmp_path, monkeypatch):
    lay(tmp_path, {f"wide/{i}.ts": "x" for i in range(60)})
    monkeypatch.setattr(trees, "NAMES", 1)
    planned = trees.Walk(str(tmp_path), (), (), "").folders(1000)
    wide = [f for f in planned if f.path == "wide"]
    assert len(wide) == trees.SHARES and sum(len(list(trees.Walk(str(tmp_path), (), (), "").files(f))) for f in wide) == 60


@pytest.mark.parametrize("without", ["nothing", "exchange", "leases", "links"])
def test_drafts_are_packed_and_replaced_files_stay_as_they_were_for_others(tmp_path, monkeypatch, without):
    def refused(*args, **kwargs):
        raise OSError

    monkeypatch.setattr(trees, "PACK", 4)
    if without == "exchange":
        monkeypatch.setattr(trees, "renameat2", lambda: None)
    if without == "leases":
        monkeypatch.setattr(trees.fcntl, "fcntl", refused)
    root, link = tmp_path / "gen/memory", os.link
    if without == "links":
        monkeypatch.setattr(trees.os, "link", refused)

    def job(name, texts):
        writer = trees.GuardedWriter({"root": str(tmp_path), "within": "gen/memory", "job": name, "attempt": name})
        folder = writer.write(iter([{"path": f"gen/memory/{path}", "text": text} for path, text in texts.items()])).folder
        assert sorted(os.listdir(folder)) == ["0", "1", "2", "names"]  # few files, however many drafts
        assert trees.name_drafts(str(tmp_path), folder) == len(texts)
        writer.abort([])

    block = "<!-- human:start -->\nmïne {}\n<!-- human:end -->"
    names = [f"{i}.md" for i in range(10)] + ["two\nlines.md", "wide/x.md"]
    job("first", {n: f"first {n}\n" + block.format(n) * (i % 2) for i, n in enumerate(names)})
    assert (root / "two\nlines.md").read_text() == "first two\nlines.md\n"
    link(root / "1.md", tmp_path / "kept")
    (root / "5.md").chmod(0o600)
    (root / "two\nlines.md").unlink()
    mode = (root / "0.md").stat().st_mode
    with open(root / "4.md") as reader:
        job("second", {n: f"second {n}{'x' * i}\n" for i, n in enumerate(names)})
        assert reader.read() == "first 4.md\n"
    assert (tmp_path / "kept").read_text() == "first 1.md\n" + block.format("1.md")
    for i, n in enumerate(names):
        assert (root / n).read_text() == f"second {n}{'x' * i}\n" + f"\n{block.format(n)}\n" * (i % 2) and (root / n).stat().st_mode == mode
    assert sorted(os.listdir(root)) == sorted([".drafts", *names[:-1], "wide"]) and not os.listdir(root / ".drafts")


def test_naming_is_dealt_out_whatever_the_input_is_dealt_in(spark, tmp_path):
    rows = spark.range(0, 2 * trees.PACK + 1, 1, 1).selectExpr("concat('gen/memory/', id % 3, '/', id, '.md') AS path", "concat('t', id) AS text")
    for job in ("j1", "j2"):
        before = {s for s in spark.sparkContext.statusTracker().getJobIdsForGroup(None)}
        trees.write_files(rows, str(tmp_path), "gen/memory", job)
        stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) >= 3
    assert {p.name: p.read_text() for p in (tmp_path / "gen/memory").glob("?/*.md")} == {f"{i}.md": f"t{i}" for i in range(2 * trees.PACK + 1)}
    assert not list((tmp_path / "gen/memory/.drafts").glob("*"))

import base64
import json
import subprocess

import pytest

from tidemark.sources import dumps, git, sinks


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=ann@x", *a], cwd=at, check=True, capture_output=True)
    run("init", "-q")
    (at / "src").mkdir()
    (at / "src" / "a.py").write_text("x = 1\ny = 2\n")
    run("add", "."), run("commit", "-qm", "first\n\nbody é")
    run("mv", "src/a.py", "src/b.py")
    (at / "c.bin").write_bytes(b"\x00\xff")
    run("add", "."), run("commit", "-qm", "Rename")
    (at / "src" / "b.py").write_text("x = 1\n")
    run("rm", "-q", "c.bin"), run("add", "."), run("commit", "-qm", "fix: shrink")
    return at


def test_git(spark, repository):
    c = {r["message"].split("\n")[0]: r for r in git.read_commits(spark, str(repository), "r").collect()}
    assert c["first"]["message"] == "first\n\nbody é" and c["first"]["author"]["email"] == "ann@x" and c["first"]["timestamp"] > 0
    assert [(f["filename"], f["additions"], f["status"]) for f in c["first"]["files"]] == [("src/a.py", 2, "added")]
    assert {(f["filename"], f["status"]) for f in c["Rename"]["files"]} == {("src/b.py", "renamed"), ("c.bin", "added")}
    assert {(f["filename"], f["deletions"], f["status"]) for f in c["fix: shrink"]["files"]} == {("src/b.py", 1, "modified"), ("c.bin", 0, "removed")} and c["fix: shrink"]["stats"]["deletions"] == 1
    assert [r["path"] for r in git.read_tree(spark, str(repository)).collect()] == ["src/b.py"]
    assert [(r["path"], r["content"]) for r in git.read_sources(spark, str(repository), "r").collect()] == [("src/b.py", "x = 1\n")]


def test_log_files(spark, repository, tmp_path):
    for name, text in zip(("n", "s"), git.log_text(str(repository))):
        (tmp_path / name).write_text(text)
    got = git.read_log_files(spark, str(tmp_path / "n"), str(tmp_path / "s"), "r")
    assert sorted(map(str, got.collect())) == sorted(map(str, git.read_commits(spark, str(repository), "r").collect()))


def test_bad_paths(tmp_path):
    (tmp_path / "f").write_text("")
    for p, word in ((tmp_path / "none", "not found"), (tmp_path / "f", "not a directory"), (tmp_path, "not a git")):
        with pytest.raises(git.RepositoryError, match=word):
            git.check(str(p))


def row(**changes):
    nested = {"structural": {"file_path": "a"}, "historical": {"previous_change_count": 1}, "temporal": {}}
    return json.dumps({"commit_sha": "s", "timestamp": 1, "file_path": "a", "label": 1, **nested, **changes})


def test_rows(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text(row() + "\n\n" + row(label=0) + "\n")
    got = dumps.read_rows(spark, str(p))
    assert got.count() == 2 and got.where("label = 1").collect()[0]["historical"]["previous_change_count"] == 1
    assert sinks.write_rows(got, str(tmp_path / "out")) == 2 and dumps.read_rows(spark, str(tmp_path / "out")).count() == 2
    for bad in (row(label=7), "{", row(label=None), ""):
        p.write_text(bad + "\n")
        with pytest.raises(dumps.BadInput):
            dumps.read_rows(spark, str(p))


def test_labels(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("previous_sha,current_sha,actual_rework\n a , b ,TRUE\n\nc,d,false\n")
    assert sorted(map(tuple, dumps.read_labels(spark, str(p)).collect())) == [("a", "b", True), ("c", "d", False)]
    p.write_text("a,b,maybe\n")
    with pytest.raises(dumps.BadInput, match="line 1"):
        dumps.read_labels(spark, str(p))


def test_forge(spark, tmp_path):
    (tmp_path / "tree.json").write_text(json.dumps({"truncated": False, "tree": [{"path": "a.py", "type": "blob", "size": 3, "sha": "1"}]}))
    assert dumps.read_tree(spark, str(tmp_path / "tree.json"), "r").collect()[0]["path"] == "a.py"
    page = [{"sha": "1", "html_url": "u", "commit": {"message": "m", "author": {"name": "n", "email": "e", "date": "2024-01-01T00:00:00Z"}}, "stats": {"additions": 1, "deletions": 0, "total": 1}, "files": [{"filename": "a.py", "additions": 1, "deletions": 0, "changes": 1, "status": "added"}]}, {"sha": "2", "commit": {"message": "x", "author": {"date": "no date"}}}]
    (tmp_path / "page.json").write_text(json.dumps(page))
    got = {r["sha"]: r for r in dumps.read_commits(spark, str(tmp_path / "page.json"), "r").collect()}
    assert got["1"]["timestamp"] == 1704067200 and got["2"]["timestamp"] is None and got["2"]["files"] == []
    blobs = [{"path": "a.py", "encoding": "base64", "content": base64.b64encode("é".encode()).decode(), "size": 2}, {"path": "b.py", "encoding": "base64", "content": base64.b64encode(b"\xff").decode(), "size": 1}, {"path": "c.png", "encoding": "base64", "content": "AAAA", "size": 3}]
    (tmp_path / "blobs.json").write_text("\n".join(map(json.dumps, blobs)))
    assert [(r["path"], r["content"]) for r in dumps.read_blobs(spark, str(tmp_path / "blobs.json"), "r").collect()] == [("a.py", "é")]


def test_kept(spark):
    now = [0.0]
    kept = sinks.Kept(most=2, seconds=10, clock=lambda: now[0])
    a = kept.get("a", lambda: spark.range(1))
    assert kept.get("a", lambda: spark.range(2)) is a
    kept.get("b", lambda: spark.range(1)), kept.get("c", lambda: spark.range(1))
    assert list(kept.held) == ["b", "c"]
    now[0] = 11.0
    kept.get("d", lambda: spark.range(1))
    assert list(kept.held) == ["d"]

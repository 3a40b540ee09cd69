"""The command: two files, two folders, a working copy, and its options."""

import io
import json
import subprocess

import pytest

from palimpsest import cli


def told(spark, *args):
    out = io.StringIO()
    cli.run(spark, args, out)
    return out.getvalue().splitlines()


def test_two_files_and_options(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1  # some note\n")
    (tmp_path / "b.py").write_text("x = 2  # some other note\n")
    (tmp_path / "c.xyz").write_text("x = 1\n\n")
    a, b, c = (str(tmp_path / n) for n in ("a.py", "b.py", "c.xyz"))
    plain = json.loads(told(spark, "files", a, b)[0])
    assert set(plain) == {"version", "actions"} and {x["action"] for x in plain["actions"]} == {"update"} and len(plain["actions"]) == 2
    assert set(json.loads(told(spark, "files", a, b, "--ui")[0])) == {"version", "line_alignment", "left_highlights", "right_highlights"}
    assert set(json.loads(told(spark, "files", a, b, "--full", "-C")[0])) == {"version", "actions", "line_alignment", "left_highlights", "right_highlights"}
    assert len(json.loads(told(spark, "files", a, b, "-C")[0])["actions"]) == 1
    assert any(line.strip().startswith("UPDATE number") for line in told(spark, "files", a, b, "-f", "actions"))
    assert json.loads(told(spark, "files", c, c + "")[0]) == {"version": "v1"}
    assert json.loads(told(spark, "files", str(tmp_path / "c.xyz"), a, "-e", "3")[0])["version"] == "v1"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["files", a, b, "-f", "picture"])


def test_a_working_copy(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 2\n")
    git("add", "a.py")
    (tmp_path / "b.py").write_text("y = 2\n")
    folder = ("--folder", str(tmp_path))
    assert len(told(spark, "git", *folder)) == 2 and len(told(spark, "git", "--cached", *folder)) == 1
    assert len(told(spark, "git", "main", *folder)) == 2 and len(told(spark, "git", "main", "a.py", *folder)) == 1
    with pytest.raises(SystemExit):
        told(spark, "git", "--folder", str(tmp_path / "none"))

"""Programs as adapters, git history, colours and shape guides."""

import hashlib
import subprocess
import sys

import pytest

from folioscope.functions import drawing
from folioscope.operators import processes, roundtrip
from folioscope.models import xlsx
from folioscope.sources.gitblobs import GitBlobs

COLD = """import sys, json, shutil, time
print("noise"); print(json.dumps({"event": "opened"}))
if "slow" in sys.argv[3]: time.sleep(60)
if "fail" in sys.argv[3]: sys.exit(4)
shutil.copy(sys.argv[1], sys.argv[2]); print("{broken"); print(json.dumps({"event": "saved"}))
"""
WARM = """import sys, json, base64, time
n = 0
for line in sys.stdin:
    kind, data, edit = line.rstrip("\\n").split("\\t")
    edit, n = base64.b64decode(edit).decode(), n + 1
    say = lambda **x: print(json.dumps(x), flush=True)
    say(event="opened")
    if edit == "die": sys.exit(1)
    if edit == "slow": time.sleep(60)
    if edit == "fail":
        say(event="error", message="no"); say(event="done"); continue
    say(event="saved"); say(event="done", output=base64.b64encode(base64.b64decode(data) + str(n).encode()).decode())
"""


def test_cold_children(tmp_path, spark):
    script = tmp_path / "a.py"
    script.write_text(COLD)
    command = [sys.executable, str(script)]
    assert processes.cold(command, "xlsx", b"x", "{}", 30)[1:] == (b"x", None)
    assert processes.cold(command, "xlsx", b"x", "fail", 30)[1:] == (None, "exit 4")
    assert processes.cold(command, "xlsx", b"x", "slow", 1)[1:] == (None, "timeout")
    files = spark.createDataFrame([("p", "xlsx", bytearray(xlsx.write({"S": []})))], "pkg string, format string, content binary")
    todo = files.join(roundtrip.targets(files), "pkg")
    row = processes.run_program(todo, command).first()
    assert row.opened and row.saved and row.error is None and row.output


def test_warm_sessions_start_again(tmp_path):
    script = tmp_path / "b.py"
    script.write_text(WARM)
    session = processes.Session([sys.executable, str(script)])
    assert session.request("x", b"a", "", 30)[1:] == (b"a1", None) and session.request("x", b"a", "", 30)[1:] == (b"a2", None)
    assert session.request("x", b"a", "fail", 30)[1:] == (None, "no") and session.request("x", b"a", "", 30)[1] == b"a4"
    assert session.request("x", b"a", "die", 30)[2] == "ended" and session.request("x", b"a", "", 30)[1] == b"a1"
    assert session.request("x", b"a", "slow", 1)[2] == "timeout" and session.request("x", b"a", "", 30)[1] == b"a1"
    session.close()


def test_blobs_of_the_whole_history(tmp_path, spark):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("first", "second!"):
        (tmp_path / "f.txt").write_text(text)
        git("add", "f.txt")
        git("commit", "-qm", text)
    spark.dataSource.register(GitBlobs)
    rows = spark.read.format("git_blobs").load(str(tmp_path)).collect()
    assert {(r.path, r.digest) for r in rows} == {("f.txt", hashlib.sha256(t).hexdigest()) for t in (b"first", b"second!")}
    assert [r.size for r in spark.read.format("git_blobs").option("sizes", "5,99").load(str(tmp_path)).collect()] == [5]


@pytest.mark.parametrize(
    "rgb, steps, want",
    [("4472C4", [], "4472C4"), ("000000", [("lumOff", 50000)], "808080~"), ("FFFFFF", [("lumMod", 50000)], "808080~"), ("FF0000", [("comp", 0)], "00FFFF~"), ("102030", [("alpha", 40000)], "102030~/a40"), ("FF0000", [("shade", 100000), ("odd", 3)], "FF0000~+odd=3"), ("204060", [("inv", 0)], "DFBF9F~"), ("FF0000", [("gray", 0)], "4C4C4C~"), ("0000FF", [("gray", 0)], "1C1C1C~")],
)
def test_colours(rgb, steps, want):
    assert drawing.modified(rgb, steps) == want


def test_guides():
    out = drawing.guides([("adj", "val 25000"), ("a", "pin 0 adj 50000"), ("x", "*/ ss a 100000"), ("y", "+- r 0 x"), ("z", "at2 1 1"), ("c", "cos 10 cd2"), ("q", "?: -1 3 4")], 200, 100, {"adj": 60000})
    assert (out["a"], out["x"], out["y"], out["z"], out["q"]) == (50000, 50, 150, drawing.TURN / 8, 4) and round(out["c"], 9) == -10


def test_guides_without_a_definition_are_zero():
    out = drawing.guides([("x", "+- nowhere 5 0"), ("y", "odd 1 2"), ("z", "+- wd16 hd16 ssd12")], 160, 320)
    assert (out["x"], out["y"]) == (5, 0) and out["z"] == 10 + 20 - 160 / 12


def test_programs_as_adapters(tmp_path, spark):
    copy, slow = tmp_path / "copy.py", tmp_path / "slow.py"
    copy.write_text('import json, shutil, sys\nprint(json.dumps({"event": "opened"}))\nshutil.copy(sys.argv[1], sys.argv[2])\nprint(json.dumps({"event": "saved"}))')
    slow.write_text('import json, time\nprint(json.dumps({"event": "opened"}), flush=True)\ntime.sleep(60)')
    files = spark.createDataFrame([("p", "xlsx", bytearray(xlsx.write({"S": []})))], "pkg string, format string, content binary")
    trial = roundtrip.Trial(files, ["patch"], {"copy": [sys.executable, str(copy)], "slow": [sys.executable, str(slow)], "gone": ["/no/such/program"]}, 3)
    rows = {r.adapter: (r.outcome, r.reason) for r in roundtrip.results(trial).collect()}
    assert rows == {"patch": ("success", None), "copy": ("failure", "failed: edit-applied, content-preserved"), "slow": ("timeout", "the adapter took too long")}
    assert trial.unavailable == {"gone": "/no/such/program: not found"}
    summary = {r.adapter: (r.success, r.failure, r.timeout) for r in roundtrip.summary(trial).collect()}
    assert summary == {"patch": (1, 0, 0), "copy": (0, 1, 0), "slow": (0, 0, 1)}


def test_notices(spark):
    from folioscope.sources import corpus

    files = spark.createDataFrame([("b",), ("a",), ("b",)], "source string")
    sources = spark.createDataFrame([("a", "http://a", "MIT"), ("b", "http://b", None), ("c", "http://c", "X")], "id string, url string, license string")
    assert corpus.notices(files, sources) == "a\n  http://a\n  license: MIT\n  files: 1\n\nb\n  http://b\n  license: unknown\n  files: 2\n"

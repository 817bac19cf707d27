"""Line differences: scripts rebuild the new text, are as short as any, and renames are found."""

import difflib
import random

from folioq.operators import line_diff


def test_scripts():
    r = random.Random(2)
    for _ in range(400):
        old = [r.choice("abcde") for _ in range(r.randint(0, 14))]
        new = list(old)
        for _ in range(r.randint(0, 6)):
            at = r.randint(0, len(new))
            new[at : at + r.randint(0, 2)] = [r.choice("abcde") for _ in range(r.randint(0, 2))]
        edits = line_diff.script(old, new)
        assert [new[j] for k, _, j in edits if k != "-"] == new and [old[i] for k, i, _ in edits if k != "+"] == old
        assert all(old[i] == new[j] for k, i, j in edits if k == " ")
        table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, x in enumerate(old):
            for j, y in enumerate(new):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(k != " " for k, _, _ in edits) == len(old) + len(new) - 2 * table[-1][-1]
    assert len(line_diff.script(["a"] * 50, ["b"] * 50, most=10)) == 100
    old, new = [f"l{i}" for i in range(40)], [f"l{i}" for i in range(40) if i != 20]
    wanted = list(difflib.unified_diff(old, new, lineterm="", n=3))[2:]
    assert line_diff.patch(old, new, line_diff.script(old, new)).split("\n") == wanted


def test_changes(spark):
    body = "\n".join(f"line {i} of a file" for i in range(30))
    old = [("a", "x\ny\nz"), ("b", body), ("c", "same"), ("d", "gone\nfor good"), ("e", "q\n" * 30000)]
    new = [("a", "x\nz\nw"), ("b2", body.replace("line 7 of", "line seven of")), ("c", "same"), ("n", "fresh"), ("e", "p\n" * 30000), ("z", "")]
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    got = {r["path"]: (r["old_path"], r["status"], r["added"], r["removed"]) for r in line_diff.changes(frame(old), frame(new)).collect()}
    assert got == {"a": ("a", "M", 1, 1), "b2": ("b", "R", 1, 1), "d": ("d", "D", 0, 2), "n": (None, "A", 1, 0), "e": ("e", "M", 30000, 30000), "z": (None, "A", 0, 0)}
    big = line_diff.changes(frame(old), frame(new)).where("path = 'e'").first()
    assert big["cut"] and len(big["patch"]) == line_diff.PATCH_BYTES
    assert line_diff.changes(frame(old), frame(old)).count() == 0

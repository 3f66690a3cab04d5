import re

import pytest

from loamworks.functions.globs import glob_regex, glob_tuple


@pytest.mark.parametrize(
    ("pattern", "path", "held"),
    [("**/a.ts", "a.ts", True), ("**/a.ts", "x/y/a.ts", True), ("x/*.py", "x/y/a.py", False), ("x/*.{py,js}", "x/a.js", True), ("x/**", "x/y/a", True), ("x/**", "x", False), ("x/**/*.go", "x/a.go", True), ("a.b", "axb", False), ("src/{a/b,c}.py", "src/a/b.py", True), ("{src/**,docs}", "src/x/y", True)],
)
def test_globs(pattern, path, held):
    assert bool(re.match(glob_regex(pattern), path)) is held


def test_tuples():
    assert glob_tuple("src/*.py")[:2] == (1, "/ext") and glob_tuple("src/*.py")[3]
    assert glob_tuple("src/{a/b,c}.py")[:2] == (1, "any") and not glob_tuple("src/{a/b,c}.py")[3]
    assert glob_tuple("**/a.ts")[:2] == (0, "name")

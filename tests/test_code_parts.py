"""Parts of real and broken Python files against a parser by indentation, which shares no step with ast."""

import dataclasses
import inspect
import io
import json.decoder
import re
import tokenize

import pytest

from loomgraph.operators import chunking

ODD = {
    "nested.py": "import os\n\nclass A:\n    x = 1\n\n    @property\n    def p(self) -> int:\n        def inner(a: int = 3, *, b=None):\n            return a\n        return inner\n\nasync def go(x):\n    async with x:\n        pass\n# tail\n",
    "broken.py": "  def f(:\n\tpass\n   trailing  ",
    "blank.py": "",
    "none.py": None,
    "nul.py": "a = 1\x00",
    "windows.py": "def f():\r\n    return 1\r\n\r\nz = f()\r\n",
    "decorated.py": '@a\n@b(1)\ndef f():\n    pass\n\n\n@c\nclass D(E, metaclass=M):\n    """doc"""\n',
    "oneline.py": "def f(): return 1\nclass G: pass\n",
    "deep.py": "x = " + "(" * 500 + ")" * 500,
}
SKIPPED = (tokenize.NL, tokenize.COMMENT)


def by_indentation(text):
    """(kind, name, first, last line) of classes and functions, from the token stream."""
    tokens = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in SKIPPED]
    out, open_, depth, last, pending = [], [], 0, 0, None
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        if t.type == tokenize.NAME and t.string in ("def", "class") and (before is None or before.string == "async" or before.type in (tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT)):
            pending = ["class" if t.string == "class" else "function", tokens[i + 1].string, (before if before and before.string == "async" else t).start[0], None, depth]
        elif t.type == tokenize.NEWLINE:
            last = t.start[0]
            if pending and tokens[i + 1].type == tokenize.INDENT:
                open_.append(pending)
            elif pending:
                out.append([*pending[:3], last])
            pending = None
        elif t.type == tokenize.INDENT:
            depth += 1
        elif t.type == tokenize.DEDENT:
            depth -= 1
            while open_ and open_[-1][4] >= depth:
                out.append([*open_.pop()[:3], last])
    return sorted(map(tuple, out))


def parts(spark, files, kind="python"):
    rows = spark.createDataFrame([(p, t, kind, "own") for p, t in files.items()], "relative_path string, text string, source_type string, extra string")
    out = {}
    for r in chunking.python_parts(rows).orderBy("relative_path", "_part").collect():
        assert r.extra == "own"
        out.setdefault(r.relative_path, []).append(r)
    return out


def test_real_files(spark):
    files = {m.__name__: inspect.getsource(m) for m in (json.decoder, dataclasses, re, inspect)}
    found = parts(spark, files)
    for name, text in files.items():
        lines, got = text.split("\n"), found[name]
        assert sorted((r.chunk_kind, r.symbol_name, r.line_start, r.line_end) for r in got if r.chunk_kind in ("class", "function")) == by_indentation(text)
        covered = {i for r in got if r.chunk_kind != "fallback" for i in range(r.line_start, r.line_end + 1)}
        runs = sorted((r.line_start, r.line_end) for r in got if r.chunk_kind == "fallback")
        assert [i for a, b in runs for i in range(a, b + 1)] == [i for i in range(1, len(lines) + 1) if i not in covered]
        assert all(b[0] > a[1] + 1 for a, b in zip(runs, runs[1:], strict=False))
        assert all(r.text == "\n".join(lines[r.line_start - 1 : r.line_end]).strip() and r.section == (r.symbol_name or r.chunk_kind) for r in got)


def test_odd_files(spark):
    found = parts(spark, ODD)
    key = lambda name: [(r.chunk_kind, r.symbol_name, r.line_start, r.line_end) for r in found[name]]
    assert key("nested.py") == [("class", "A", 3, 10), ("function", "go", 12, 14), ("function", "p", 7, 10), ("function", "inner", 8, 9), ("fallback", None, 1, 2), ("fallback", None, 11, 11), ("fallback", None, 15, 16)]
    assert key("broken.py") == [("fallback", None, 1, 3)] and found["broken.py"][0].text == ODD["broken.py"]
    assert key("blank.py") == key("none.py") == [("fallback", None, 1, 1)]
    assert key("windows.py") == [("function", "f", 1, 2), ("fallback", None, 3, 5)]
    assert [k[:2] for k in key("decorated.py")][:2] == [("function", "f"), ("class", "D")]
    assert key("oneline.py") == [("function", "f", 1, 1), ("class", "G", 2, 2), ("fallback", None, 3, 3)]
    assert len(key("deep.py")) == len(key("nul.py")) == 1


def test_test_files(spark):
    found = parts(spark, {"a.py": "def test_b():\n    pass\n\nclass T:\n    def test_a(self):\n        pass\n", "none.py": " x = 1\n", "broken.py": "def test_x(:"}, "test")
    assert [(r.symbol_name, r.line_start) for r in found["a.py"]] == [("test_b", 1), ("test_a", 5)]
    assert [r.chunk_kind for r in found["none.py"]] == ["fallback"] and [r.chunk_kind for r in found["broken.py"]] == ["fallback"]


def test_each_file_is_read_once(spark, tmp_path):
    spark.createDataFrame([("a.py", "x = 1", "python")], "relative_path string, text string, source_type string").write.parquet(str(tmp_path / "files"))
    plan = chunking.python_parts(spark.read.parquet(str(tmp_path / "files")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


@pytest.mark.parametrize(("n", "ranges", "runs"), [(5, [], [(1, 5)]), (5, [(1, 5)], []), (6, [(2, 3), (3, 4), (2, 2)], [(1, 1), (5, 6)]), (3, [(1, 9)], []), (4, [(3, 3)], [(1, 2), (4, 4)])])
def test_uncovered_runs(n, ranges, runs):
    assert list(chunking.uncovered(n, ranges)) == runs

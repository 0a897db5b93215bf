"""Chunking: overlapping windows, heading sections and Python symbols with line provenance."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import strip

SIZE, OVERLAP = 1000, 100
#: Fixed value: a line that underlines (or overlines) a heading.
ADORNMENT = "^[=\\-~^`:#*]{3,}$"


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Zero-based starts of the windows over n characters: the last one reaches the end."""
    step = max(1, size - max(0, overlap))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def text_windows(parts: DataFrame, order: list[str] | None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows over the parts of each file, numbered over the file without blank ones.

    parts: relative_path, text, line_start, line_end, section and whatever else, which is kept;
    `order` orders the parts of a file. None: a file is one part, so that its windows are numbered
    within the row and nothing is shuffled. Adds chunk_index, chunk_id, content, content_hash and
    the windows' own lines, estimated in proportion to the characters.
    """
    n = F.length("text")
    own = lambda start: strip(F.substring(F.col("text"), start + 1, F.lit(size)))
    starts = window_starts(n, size, overlap)
    if order is None:
        filled = F.filter(F.transform(starts, lambda i: F.struct(i.alias("start"), own(i).alias("content"))), lambda w: w["content"] != "")
        rows = parts.select("*", n.alias("_n"), F.posexplode(filled).alias("chunk_index", "_w"))
        rows = rows.withColumn("_start", F.col("_w.start")).withColumn("content", F.col("_w.content")).drop("_w")
    else:
        rows = parts.select("*", n.alias("_n"), F.explode(starts).alias("_start")).withColumn("content", own(F.col("_start"))).filter("content <> ''")
    lines = F.greatest(F.lit(1), F.col("line_end") - F.col("line_start") + 1)
    at = lambda c: F.floor(lines * c / F.col("_n")).cast("int")
    rows = rows.withColumn("_from", F.col("line_start") + at(F.col("_start")))
    rows = rows.withColumn("_to", F.least(F.col("line_end"), F.greatest(F.col("_from"), F.col("line_start") + at(F.least(F.col("_n"), F.col("_start") + size)))))
    rows = rows.withColumn("line_start", F.col("_from")).withColumn("line_end", F.col("_to"))
    if order is not None:
        rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("relative_path").orderBy(*order, "_start")) - 1)
    rows = rows.withColumn("chunk_id", chunk_id(F.col("relative_path"), F.col("chunk_index")))
    return rows.withColumn("content_hash", content_hash()).drop("_n", "_start", "_from", "_to", "text")


def chunk_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit("::chunk:"), index.cast("string"))


def content_hash() -> Column:
    """sha256 of path, section, lines and the text without white space at line ends."""
    plain = F.regexp_replace("content", "(?U)\\s+(?=\\r?\\n)|\\s+$", "")
    return F.sha2(F.concat_ws("|", strip(F.col("relative_path")), strip(F.col("section")), F.col("line_start").cast("string"), F.col("line_end").cast("string"), plain), 256)


def whole_files(files: DataFrame, kind: str | Column = "fallback") -> DataFrame:
    """The fallback: a file's whole text as one part."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = F.size(F.split("text", "\n"))
    return files.withColumns({"chunk_kind": kind, "section": kind, "line_start": F.lit(1), "line_end": lines, "_part": F.lit(0)})


def window_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """relative_path, text (and more) -> one row per window."""
    return text_windows(whole_files(files), None, size, overlap).drop("_part")


def sections(files: DataFrame) -> DataFrame:
    """Parts between headings: `#` lines in .md, titles above an adornment line elsewhere.

    Text before the first heading is a part of its own if line 1 is neither blank nor an
    adornment. A file without headings is one part.
    """
    kind = F.when(F.col("source_type") == "example", "example_section").otherwise("section")
    lines = files.withColumn("_lines", F.split(F.regexp_replace("text", "\\r\\n?", "\n"), "\n"))
    # As a text's last line break opens no line.
    lines = lines.withColumn("_lines", F.when(F.element_at("_lines", -1) == "", F.slice("_lines", 1, F.size("_lines") - 1)).otherwise(F.col("_lines")))
    adorned = lambda line: strip(line).rlike(ADORNMENT)
    at = F.sequence(F.lit(1), F.size("_lines"))
    hash_heads = F.filter(at, lambda i: F.element_at("_lines", i).rlike("^#{1,6}\\s+"))
    under_heads = F.filter(at, lambda i: (i < F.size("_lines")) & (strip(F.element_at("_lines", i)) != "") & adorned(F.try_element_at("_lines", i + 1)))
    heads = F.when(F.size("_lines") == 0, F.array().cast("array<int>")).when(F.col("extension") == ".md", hash_heads).otherwise(under_heads)
    lines = lines.withColumn("_heads", heads)
    first = F.element_at("_lines", 1)
    opens = (F.size("_heads") > 0) & (F.try_element_at("_heads", F.lit(1)) > 1) & (strip(first) != "") & ~adorned(first)
    lines = lines.withColumn("_heads", F.when(opens, F.concat(F.array(F.lit(1)), "_heads")).otherwise(F.col("_heads")))
    split = lines.filter(F.size("_heads") > 0).select("*", F.posexplode("_heads").alias("_part", "line_start"))
    split = split.withColumn("line_end", F.coalesce(F.try_element_at("_heads", F.col("_part") + 2) - 1, F.size("_lines")))
    own = F.slice("_lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    split = split.withColumn("_own", own).withColumn("text", strip(F.array_join("_own", "\n")))
    named = F.filter(F.transform("_own", strip), lambda x: (x != "") & ~x.rlike(ADORNMENT))
    name = F.substring(strip(F.regexp_replace(F.try_element_at(named, F.lit(1)), "^#{1,6}\\s+", "")), 1, 160)
    split = split.withColumns({"section": F.coalesce(F.nullif(name, F.lit("")), F.lit("section")), "chunk_kind": kind})
    whole = whole_files(lines.filter(F.size("_heads") == 0), kind)
    return split.drop("_own", "_lines", "_heads").unionByName(whole.drop("_lines", "_heads"))


def notebook_cells(files: DataFrame) -> DataFrame:
    """Parts of notebooks: their cells that are not blank, the cell's number as its line.

    `source` is a string or a list of strings; text that is no JSON is one part.
    """
    schema = "struct<cells: array<struct<cell_type: string, source: string>>>"
    parsed = files.withColumn("_book", F.from_json("text", schema))
    cells = parsed.filter("_book.cells IS NOT NULL").select("*", F.posexplode("_book.cells").alias("_part", "_cell"))
    source = F.col("_cell.source")
    text = F.when(source.startswith("["), F.coalesce(F.array_join(F.from_json(source, "array<string>"), ""), source)).otherwise(source)
    kind = F.when(F.col("_cell.cell_type") == "markdown", "example_section").otherwise("example_cell")
    cells = cells.withColumns({"text": text, "chunk_kind": kind, "section": kind, "line_start": F.col("_part") + 1, "line_end": F.col("_part") + 1})
    rest = whole_files(parsed.filter("_book.cells IS NULL AND NOT ltrim(text) LIKE '{%'"), "example_section")
    return cells.filter(strip(F.col("text")) != "").drop("_cell", "_book").unionByName(rest.drop("_book"))


def _symbols(text: str, tests_only: bool) -> list[tuple[str, str | None, int, int]] | None:
    """Kind, name and lines of a module's docstring, classes and functions, breadth first; or of its
    test functions by line. None if the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[tuple[str, str | None, int, int]] = []
    if not tests_only and tree.body and isinstance(tree.body[0], ast.Expr) and ast.get_docstring(tree):
        out.append(("module_docstring", None, tree.body[0].lineno, tree.body[0].end_lineno))
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in ast.walk(tree):
        if isinstance(node, functions) and (not tests_only or node.name.startswith("test_")):
            out.append(("test_function" if tests_only else "function", node.name, node.lineno, node.end_lineno))
        elif isinstance(node, ast.ClassDef) and not tests_only:
            out.append(("class", node.name, node.lineno, node.end_lineno))
    return sorted(out, key=lambda x: x[2]) if tests_only else out


def uncovered(n_lines: int, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The runs of lines 1 to n_lines that no range covers."""
    next_line = 1
    for low, high in sorted(ranges):
        if low > next_line:
            yield next_line, low - 1
        next_line = max(next_line, high + 1)
    if next_line <= n_lines:
        yield next_line, n_lines


@F.udtf(returnType="_part int, chunk_kind string, symbol_name string, line_start int, line_end int, text string, _whole boolean", useArrow=True)
class PythonParts:
    """The parts of one .py file: its symbols, then the runs of lines that no symbol covers.

    A test file gives its test functions only. A file that does not parse, and a test file
    without test functions, is one part.
    """

    def eval(self, text: str | None, source_type: str | None) -> Iterator[tuple]:
        text = text or ""
        tests_only = source_type == "test"
        found = _symbols(text, tests_only)
        if found is None or (tests_only and not found):
            yield 0, "fallback", None, 1, text.count("\n") + 1, text, True
            return
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        free = [] if tests_only else [("fallback", None, *r) for r in uncovered(len(lines), [x[2:] for x in found])]
        for part, (kind, name, low, high) in enumerate([*found, *free]):
            yield part, kind, name, low, high, "\n".join(lines[low - 1 : high]), False


def python_parts(files: DataFrame) -> DataFrame:
    """Parts of .py files in one pass: each file is joined laterally with what PythonParts makes of it."""
    rows = files.withColumnRenamed("text", "_text")
    parts = rows.lateralJoin(PythonParts(F.col("_text").outer(), F.col("source_type").outer())).drop("_text")
    # A whole file keeps its white space, as windows count its characters.
    text = F.when(F.col("_whole"), F.col("text")).otherwise(strip(F.col("text")))
    return parts.withColumns({"text": text, "section": F.coalesce("symbol_name", "chunk_kind")}).drop("_whole")


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """All files, each by its type: relative_path, text, source_type, extension (and more)."""
    python = (F.col("extension") == ".py") & F.col("source_type").isin("python", "test")
    book = (F.col("extension") == ".ipynb") & (F.col("source_type") == "example")
    prose = F.col("extension").isin(".rst", ".md", ".txt")
    parts = python_parts(files.filter(python))
    parts = parts.unionByName(sections(files.filter(prose & ~book)), allowMissingColumns=True)
    parts = parts.unionByName(notebook_cells(files.filter(book)), allowMissingColumns=True)
    parts = parts.unionByName(whole_files(files.filter(~python & ~book & ~prose)), allowMissingColumns=True)
    return text_windows(parts, ["_part"], size, overlap).drop("_part")

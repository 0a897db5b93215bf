"""File sources and sinks: source trees, evaluation samples, reports, audits, triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".py", ".rst", ".md", ".txt", ".ipynb"]
FOCUS = ["src", "docs/source", "examples", "tests"]
SAMPLE_SCHEMA = (
    "question string, reference_answer string, expected_context_terms array<string>, generated_answer string, retrieved_contexts array<string>, "
    "retrieved_sources array<string>, domain string, difficulty string, retrieval_type string, tags array<string>"
)
REPORT_METRICS = ["context_recall", "answer_faithfulness", "answer_relevance", "grounding", "multi_hop_accuracy", "avg_latency_ms", "estimated_cost_usd"]


def source_type(path: Column) -> Column:
    """By the components of the path below its root."""
    has = lambda name: F.array_contains(F.split(path, "/"), name)
    return F.when(has("tests"), "test").when(has("examples"), "example").when(has("docs") & has("source"), "docs").otherwise("python")


def module_name(path: Column, package_root: str = "") -> Column:
    """Dotted module path, without a leading package root (such as "pkg/src/") and __init__."""
    own = F.when(path.startswith(package_root), F.substring(path, len(package_root) + 1, 1 << 30)).otherwise(path) if package_root else path
    dotted = F.replace(F.regexp_replace(own, "\\.py$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, "\\.__init__$", "")


def load_directory(spark: SparkSession, root: str, prefix: str = "", package_root: str = "") -> DataFrame:
    """relative_path, text and file columns of every supported file below root.

    prefix goes before relative_path, so that several roots can't share a path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = F.regexp_replace("path", "^[a-z]+:/+", "/")
    below = F.regexp_extract(clean, "^" + root.split(":", 1)[-1].rstrip("/").replace(".", "\\.") + "/(.*)$", 1)
    rows = files.select(F.concat(F.lit(prefix), below).alias("relative_path"), F.col("path").alias("source_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    rows = rows.withColumn("filename", F.element_at(F.split("relative_path", "/"), -1)).withColumn("extension", F.regexp_extract("filename", "(\\.[^.]+)$", 1))
    rows = rows.filter(F.col("extension").isin(EXTENSIONS)).withColumn("source_type", source_type(F.col("relative_path")))
    module = F.when(F.col("source_type") == "python", module_name(F.col("relative_path"), package_root)).otherwise(module_name(F.col("relative_path")))
    return rows.withColumn("module_name", module)


def load_directories(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Several roots, each under its name."""
    out = None
    for name, root in roots.items():
        rows = load_directory(spark, root, f"{name}/")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source directories")
    return out


def focus_directories(spark: SparkSession, root: str, focus: list[str] = FOCUS) -> list[str]:
    """The focus folders below root, else below its parent, else root itself."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    base = root.rstrip("/")
    for at in (base, base.rsplit("/", 1)[0]):
        if found := [f"{at}/{f}" for f in focus if exists(f"{at}/{f}")]:
            return found
    if not exists(base):
        raise FileNotFoundError(base)
    return [base]


def select_chunks(chunks: DataFrame, offset: int = 0, most: int | None = None) -> DataFrame:
    """A slice of the chunks in path and index order."""
    if offset < 0 or (most is not None and most <= 0):
        raise ValueError("offset must not be negative, and most must be positive")
    rows = chunks.orderBy("relative_path", "chunk_index").offset(offset)
    return rows if most is None else rows.limit(most)


def summarize(chunks: DataFrame) -> DataFrame:
    """Per source type: files and chunks."""
    return chunks.groupBy("source_type").agg(F.countDistinct("relative_path").alias("n_files"), F.count("*").alias("n_chunks"))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples: a JSON array, an object with `samples`, or JSON lines; checked and trimmed."""
    # A file is read whole, as its beginning tells which of the three it is.
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    array = F.from_json(text, f"array<struct<{SAMPLE_SCHEMA}>>")
    wrapped = F.from_json(text, f"struct<samples:array<struct<{SAMPLE_SCHEMA}>>>")["samples"]
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, f"struct<{SAMPLE_SCHEMA}>"))
    found = F.when(text.startswith("["), array).otherwise(F.coalesce(wrapped, lines))
    rows = spark.read.text(path, wholetext=True).select(F.explode(found).alias("s")).select("s.*")
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    texts, lists = ["question", "reference_answer", "domain", "difficulty", "retrieval_type"], ["expected_context_terms", "retrieved_contexts", "retrieved_sources", "tags"]
    rows = rows.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in texts} | {c: clean(F.col(c)) for c in lists})
    bad = (F.col("question") == "") | (F.col("reference_answer") == "")
    return rows.withColumn("question", F.when(bad, F.raise_error(F.lit("a sample needs a question and a reference answer"))).otherwise(F.col("question")))


def save_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)


def save_report(report: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines, one per row of the report (a mode, or the whole)."""
    report.write.mode("overwrite").json(path)


def save_comparison(contrasted: DataFrame, deltas: DataFrame, path: str, baseline: str = "baseline", candidate: str = "candidate") -> None:
    """A comparison: the metrics' verdicts with both labels, and the changes per question below it."""
    labels = {"baseline_label": F.lit(baseline), "candidate_label": F.lit(candidate)}
    contrasted.withColumns(labels).write.mode("overwrite").json(f"{path}/metrics")
    deltas.withColumns(labels).write.mode("overwrite").json(f"{path}/samples")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports; a metric that is missing is 0."""
    rows = spark.read.schema("ts timestamp, " + ", ".join(f"{m} double" for m in REPORT_METRICS)).json(path)
    return rows.na.fill(0.0, REPORT_METRICS)


def append_audit(rows: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    rows.write.mode("append").json(path)


#: Signs that a literal escapes, the escape's own first.
ESCAPES = [("\\", "\\"), ('"', '"'), ("\n", "n"), ("\r", "r"), ("\t", "t")]


def write_triples(triples: DataFrame, path: str) -> None:
    """N-Triples, which every Turtle reader takes."""
    iri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    plain = F.col("o")
    for sign, name in ESCAPES:
        plain = F.replace(plain, F.lit(sign), F.lit("\\" + name))
    literal = F.concat(F.lit('"'), plain, F.lit('"'))
    line = F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), F.when(F.col("o_kind") == "literal", literal).otherwise(iri(F.col("o"))), F.lit("."))
    triples.select(line.alias("value")).write.mode("overwrite").text(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    pattern = '^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"((?:[^"\\\\]|\\\\.)*)") \\.$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    # One pass: each run between escapes, and each escape by its own sign.
    pieces = F.regexp_extract_all(part(4), F.lit("[^\\\\]+|\\\\."), F.lit(0))
    signs = F.create_map(*[F.lit(x) for sign, name in ESCAPES for x in ("\\" + name, sign)])
    plain = F.array_join(F.transform(pieces, lambda x: F.coalesce(signs[x], x)), "")
    is_literal = F.col("value").rlike('" \\.$')
    return spark.read.text(path).filter(F.col("value").rlike(pattern)).select(part(1).alias("s"), part(2).alias("p"), F.when(is_literal, plain).otherwise(part(3)).alias("o"), F.when(is_literal, "literal").otherwise("iri").alias("o_kind"))

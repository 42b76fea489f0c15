"""What changed: changed file paths (P8) and unified diff text split per
file (F2), as tables.

A version-control tool's output enters as rows: ``changed_files(path)``
and ``diff_lines(diff_id, line_no, line)`` — one row per diff line.
The split is a running count of header lines, in two levels: chunks of
``CHUNK`` lines are counted on their own and shifted by the headers of the
chunks before, so one long diff is many tasks; then a grouped, line-ordered
concatenation per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODEL_DIR = "models/"
MODEL_EXT = ".sql"
HEADER = "diff --git"
#: Lines numbered by one window.
CHUNK = 4096


def model_paths(changed_files: DataFrame, path_col: str = "path") -> DataFrame:
    """Paths under ``models/`` ending ``.sql`` (trimmed), sorted."""
    p = F.trim(F.col(path_col))
    return (changed_files.select(p.alias("path"))
            .filter(p.startswith(MODEL_DIR) & p.endswith(MODEL_EXT))
            .orderBy("path"))


def diff_lines_from_text(spark: SparkSession, diffs: dict[str, str]) -> DataFrame:
    """Helper for callers holding diff text: ``{diff_id: text}`` → lines
    (newline kept, as the text had it)."""
    rows = []
    for did, text in diffs.items():
        for i, line in enumerate(text.splitlines(keepends=True)):
            rows.append((did, i, line))
    return spark.createDataFrame(rows, "diff_id string, line_no long, line string")


def diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """``diff_id, line_no, line`` of diff files, read line by line as Spark
    reads text: numbered within the part of a file that a task reads, and
    shifted by the lines of the parts before."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("\n")).alias("line"))
    parts = raw.groupBy("diff_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("diff_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return (raw.join(parts, ["diff_id", "part"])
            .select("diff_id", (F.col("off") + F.col("at") - F.col("first")).alias("line_no"), "line"))


def split_diffs(diff_lines: DataFrame) -> DataFrame:
    """``diff_id, path, diff`` — one row per changed model file.

    A line starting ``diff --git`` opens a file whose path is the 4th
    whitespace token without its ``b/`` prefix; later lines belong to it;
    lines before the first header are dropped; a repeated path in one diff
    keeps the later section; only ``models/…sql`` paths are kept."""
    is_head = F.col("line").startswith(HEADER)
    tokens = F.split(F.trim(F.col("line")), r"\s+")
    head_path = F.when(is_head & (F.size(tokens) >= 4),
                       F.regexp_replace(F.element_at(tokens, 4), "^b/", ""))
    lines = diff_lines.withColumns({"head": is_head.cast("long"), "head_path": head_path,
                                    "chunk": F.floor(F.col("line_no") / F.lit(CHUNK))})
    # one row per chunk
    counts = lines.groupBy("diff_id", "chunk").agg(F.sum("head").alias("heads"))
    before = counts.select("diff_id", "chunk", F.coalesce(F.sum("heads").over(
        Window.partitionBy("diff_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("diff_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = (lines.withColumn("own", F.sum("head").over(within)).join(before, ["diff_id", "chunk"])
              .withColumn("section", F.col("own") + F.col("before")).filter(F.col("section") > 0))
    sections = (tagged.groupBy("diff_id", "section")
                .agg(F.max("head_path").alias("path"),
                     F.array_join(F.transform(
                         F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                         lambda x: x["line"]), "").alias("diff")))
    last = Window.partitionBy("diff_id", "path").orderBy(F.col("section").desc())
    return (sections.filter(F.col("path").isNotNull()
                            & F.col("path").startswith(MODEL_DIR)
                            & F.col("path").endswith(MODEL_EXT))
            .withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
            .select("diff_id", "path", "diff"))

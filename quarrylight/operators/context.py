"""The compact view of the files that results lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

COLLAPSED = 40
_SPAN = "({kind}, lines {start_line}-{end_line})"


def collapsed(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """One line for each symbol of the results' files that isn't a result: qid, file_path, place, line.

    Whole-file and module chunks have none; the first forty of a file are shown.
    """
    rows = _file_chunks(results, chunks).where("NOT selected AND kind <> 'module' AND symbol_name <> '__file__'")
    place = Window.partitionBy("qid", "file_path").orderBy("start_line", "end_line", "ord")
    line = F.concat(F.lit("//   "), F.col("symbol_name"), F.lit("  ("), F.col("kind"), F.lit(", lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit("):  "), T.signature(F.col("code")))
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= COLLAPSED).select("qid", "file_path", "place", line.alias("line"))


def _file_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of each file that a result lies in, with the file's place and whether the chunk is a result."""
    located = results.select("qid", "chunk_id", "rank").join(chunks.select("chunk_id", "file_path"), "chunk_id")
    files = located.groupBy("qid", "file_path").agg(F.min("rank").alias("file_rank"))
    chosen = results.select("qid", "chunk_id").distinct().withColumn("_yes", F.lit(True))
    return files.join(chunks, "file_path").join(chosen, ["qid", "chunk_id"], "left").withColumn("selected", F.coalesce("_yes", F.lit(False))).drop("_yes")


def render(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid and context: a block for each file, in order of its best result.

    A file's module chunk comes first, results in full, other symbols as one line each.
    """
    rows = _file_chunks(results, chunks)
    by_line = Window.partitionBy("qid", "file_path").orderBy("start_line", "end_line", "ord")
    is_module, is_file = F.col("kind") == "module", F.col("symbol_name") == "__file__"
    other = ~is_module & ~is_file & ~F.col("selected")
    modules = F.sum(is_module.cast("int")).over(by_line)
    shown = F.sum(other.cast("int")).over(by_line)
    span = F.concat(F.col("symbol_name"), F.lit("  ("), F.col("kind"), F.lit(", lines "), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(")"))
    text = (
        F.when(is_module, F.when(modules == 1, F.col("code")))
        .when(is_file, F.when(F.col("selected"), F.col("code")))
        .when(F.col("selected"), F.concat(F.lit("// ▸ "), span, F.lit("\n"), F.col("code")))
        .when(shown <= COLLAPSED, F.concat(F.lit("//   "), span, F.lit(":  "), T.signature(F.col("code"))))
    )
    # the order within a file: the module first, then by line
    at = F.struct((~is_module).alias("a"), F.col("start_line").alias("b"), F.col("end_line").alias("c"), F.col("ord").alias("d"), text.alias("text"))
    files = rows.withColumn("_at", at).withColumn("_other", other.cast("int")).groupBy("qid", "file_path", "file_rank").agg(F.array_sort(F.collect_list(F.when(F.col("_at.text").isNotNull(), F.col("_at")))).alias("_parts"), F.sum("_other").alias("_others"))
    lines = F.transform("_parts", lambda p: p["text"])  # symbols that show nothing were never collected
    more = F.when(F.col("_others") > COLLAPSED, F.array(F.concat(F.lit("//   … "), F.col("_others") - COLLAPSED, F.lit(" more symbol(s) in this file")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit("// ═══ "), F.col("file_path"), F.lit(" ═══")))
    blocks = files.select("qid", "file_rank", F.array_join(F.concat(head, lines, more), "\n").alias("block"))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_rank", "block"))), lambda b: b["block"]), "\n\n").alias("context"))

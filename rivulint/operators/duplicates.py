"""Functions defined in more than one file.

A name may stand in any number of files, in a third of the corpus too.  What is asked of all names
(how many files, which is the first) is combined before the shuffle.  Lists of files are dealt
into numbered parts of at most ``LISTED_FILES``: files are range-partitioned by name and
path, so that a hot name lies in many tasks, ranked within each of them, and given their place by
the counts of the tasks before.  No task sorts or ranks more than a part of a name; where a list
is wanted as one text, the texts of its parts are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulint.operators.file_checks import defined_names, review_text
from rivulint.operators.keyed import keyed_join
from rivulint.rules.fixed_values import REVIEW_TEXTS
from rivulint.schema import as_findings
from rivulint.session import shared_dir

# Files in one part of a list, and parts in one text: a million paths, some 60 MB.
LISTED_FILES, TEXT_PARTS = 10_000, 100


def function_definitions(files: DataFrame) -> DataFrame:
    """(name, path), once per file defining the name; no shuffle, a file is one row."""
    return (
        review_text(files)
        .where(F.col("text").contains("function"))
        .select(F.explode(F.expr(defined_names())).alias("name"), "path")
    )


def stored_definitions(files: DataFrame) -> DataFrame:
    """The definitions of a corpus, read and searched once, for what looks at them repeatedly."""
    return written(function_definitions(files), "definitions")


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """Narrow rows written once to the shared folder, for what reads them several times."""
    out = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(out)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def shared_names(definitions: DataFrame) -> DataFrame:
    """(name, n_files, first_path) of the names in several files; combined before the shuffle."""
    return (
        definitions.groupBy("name")
        .agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))
        .where(F.col("n_files") > 1)
    )


def defining_files(definitions: DataFrame) -> DataFrame:
    """(name, n_files, path): every file of every shared name, a row each.

    ``definitions`` should be stored.  Names of many files stay where their rows are.
    """
    names = written(shared_names(definitions).withColumn("n", F.col("n_files")), "shared-names")
    return keyed_join(definitions, names, ["name"]).select("name", "n_files", "path")


def ranked_files(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows of (name, path) with ``place``, from 0 by path within the name; no name in one task."""
    order = ["name", "path"]
    placed = written(
        rows.select(*order, *carried).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("task", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked")
    before = Window.partitionBy("name").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    # One row for a name and task: what a name's tasks before this one hold.
    starts = written(
        placed.groupBy("name", "task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranked-starts")
    return keyed_join(placed, starts, ["name", "task"]).select(
        *order, *carried, (F.col("base") + F.col("at") - F.col("first")).alias("place"))


def _lists(definitions: DataFrame, listed: int) -> tuple[DataFrame, DataFrame | None]:
    """(name, n_files, first_path, part, files) of names of one part, and of those of several."""
    once = definitions.select("name", "path")
    names = written(shared_names(once).withColumn("n", F.col("n_files")), "shared-names")
    columns, files = ["name", "n_files", "first_path"], F.array_sort(F.collect_list("path"))
    few = (
        once.join(names.where(F.col("n_files") <= listed), "name")
        .groupBy(*columns).agg(files.alias("files"))
        .select(*columns, F.lit(1).alias("part"), "files"))
    many = names.where(F.col("n_files") > listed)
    if many.isEmpty():
        return few, None
    placed = ranked_files(keyed_join(once, many, ["name"]), "n_files", "first_path")
    part = (F.floor(F.col("place") / listed) + 1).cast("int")
    return few, placed.groupBy(*columns, part.alias("part")).agg(files.alias("files"))


def file_lists(definitions: DataFrame, listed: int = LISTED_FILES) -> DataFrame:
    """(name, n_files, first_path, part, files): the sorted files of shared names.

    ``definitions`` should be stored.  A name in more than ``listed`` files has several parts,
    numbered from 1, each of so many.
    """
    few, many = _lists(definitions, listed)
    return few if many is None else few.unionByName(many)


def list_texts(definitions: DataFrame, listed: int = LISTED_FILES,
               parts: int = TEXT_PARTS) -> DataFrame:
    """(name, n_files, first_path, number, text): the files of shared names, joined by commas.

    A text is one value and so has a limit, ``parts`` parts; a name with more has several texts.
    """
    few, many = _lists(definitions, listed)
    columns, text = ["name", "n_files", "first_path"], F.array_join("files", ", ")
    out = few.select(*columns, F.lit(1).alias("number"), text.alias("text"))
    if many is None:
        return out
    number = (F.floor((F.col("part") - 1) / parts) + 1).cast("int")
    pieces = F.array_sort(F.collect_list(F.struct("part", text.alias("text"))))
    joined = many.groupBy(*columns, number.alias("number")).agg(pieces.alias("pieces")).select(
        *columns, "number",
        F.array_join(F.transform("pieces", lambda p: p["text"]), ", ").alias("text"))
    return out.unionByName(joined)


def duplicate_function_findings(files: DataFrame, listed: int = LISTED_FILES,
                                parts: int = TEXT_PARTS) -> DataFrame:
    return shared_name_findings(stored_definitions(files), listed, parts)


def shared_name_findings(definitions: DataFrame, listed: int = LISTED_FILES,
                         parts: int = TEXT_PARTS) -> DataFrame:
    """A finding per shared name, with all its files in the message.

    ``definitions`` should be stored.  A name in more files than one text holds has further
    findings on the same file, told apart by match_no, which go on with the list.
    """
    severity, category, message, fix = REVIEW_TEXTS["RV-24"]
    definitions = definitions.where(~F.col("name").startswith("__"))
    text = F.lit(message)
    for slot, value in (
        ("{0}", F.col("name")), ("{1}", F.col("n_files").cast("string")), ("{2}", F.col("text")),
    ):
        text = F.replace(text, F.lit(slot), value)
    rows = list_texts(definitions, listed, parts).select(
        F.col("first_path").alias("path"), F.lit(0).alias("line"),
        F.lit("RV-24").alias("rule_id"), F.lit(severity).alias("severity"),
        F.lit(category).alias("category"), text.alias("message"), F.lit("").alias("snippet"),
        F.lit(fix).alias("recommendation"), F.lit("PHP").alias("language"),
        F.col("number").alias("match_no"),
    )
    return as_findings(rows, "review")

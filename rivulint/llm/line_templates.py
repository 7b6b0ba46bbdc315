"""Line deduplication by templates: a fixed-depth tree of token counts and leading tokens.

A document's lines are split at line feeds and their tokens at single blanks (tabs and carriage
returns count as blanks; blanks at both ends are cut).  Tokens with a digit are variable fields,
written ``<*>``.  The tree's levels are the token count and the first ``DEPTH`` tokens; each leaf
holds lines that may be one template.  Within a leaf a line joins the template of a more frequent
line (ties: the lesser text) that agrees with it in at least ``SIMILARITY`` of the positions; of
several it takes the most similar one.  Candidates are found by cutting the positions behind the
leading tokens into so many runs that lines that similar agree in a whole run: each line meets
all lines that share one of its runs.  Lines of a run are dealt into blocks of about ``BLOCK``
that meet two by two, and pairs stay inside arrays, so no group or row count grows with the
square of a run.  Templates so joined one to the other are one.

A template whose lines stand in at least ``MIN_DOCS`` documents recurs.  Of its lines the first
(by doc_id, then line number) stays, all others are dropped.  Lines of fewer than ``MIN_TOKENS``
tokens have too few places to generalise: each is a template of its own, if it has at least
``MIN_CHARS`` characters (scripts without blanks included); shorter ones repeat by chance and
are left alone.

Only DataFrame functions are used.  The texts are read twice and shuffled once, at the end, with
the numbers of their dropped lines; in between, lines travel as hashes.  Lines of leaves with
several different lines, whose texts are needed, are picked by a bitmap of fixed size
(``BITMAP_WORDS`` words, the only thing broadcast) and then exactly.  A line that stands in a
third of all documents is counted with map-side aggregation.

Null, empty and repeated: a null text stays null and has no lines; an empty one stays empty;
rows equal in doc_id and text are one document and lose the same lines; a null doc_id sorts
first; a document all of whose lines are dropped becomes empty and stays; an empty table gives
no row.  Other columns are kept; columns with the names of the three results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulint.llm.common import (block_pairs, connected_components, fresh_name, keyed_join,
                                 row_key, settled)

DEPTH, MIN_TOKENS, MIN_CHARS, MIN_DOCS, SIMILARITY = 3, 5, 16, 2, 0.8
BITMAP_WORDS, BLOCK = 1 << 15, 256
FIELD = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def masked(line: Column) -> Column:
    """The line with its variable fields generalised."""
    blank = F.when(line.contains("\t") | line.contains("\r"), F.translate(line, "\t\r", "  "))
    plain = F.trim(F.coalesce(blank, line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, FIELD, "<*>")).otherwise(plain)


def lines_of(docs: DataFrame) -> DataFrame:
    """document (key), doc_id, line_no, masked, tokens (their number) and leaf of the lines."""
    # Masked before the lines are taken apart, and taken apart by the outer form: else the
    # optimizer would have every filter on them mask the lines again.
    lines = docs.select(
        row_key("doc_id", "text").alias("document"), "doc_id",
        F.posexplode_outer(F.transform(F.split("text", "\n"), masked)).alias("line_no", "masked"))
    text = F.col("masked")
    counted = lines.where(text.isNotNull()).withColumn(
        "tokens", F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)
    is_long = F.col("tokens") >= MIN_TOKENS
    # A short line's leaf holds nothing else.
    return counted.where(is_long | (F.length(text) >= MIN_CHARS)).withColumn(
        "leaf", F.xxhash64("tokens", F.when(is_long, F.substring_index(text, " ", DEPTH))
                           .otherwise(text)))


def _in_crowded_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines in the given leaves.  A bitmap bounds what is read on; the join settles it."""
    word = F.col("leaf").bitwiseAND(F.lit(BITMAP_WORDS - 1))
    bit = F.shiftrightunsigned("leaf", 32).bitwiseAND(F.lit(63)).cast("int")
    bitmap = leaves.groupBy(word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    likely = lines.join(F.broadcast(bitmap), word == F.col("word")).where(
        F.call_function("getbit", F.col("bits"), bit) == 1).drop("word", "bits")
    # Not a semi join: the optimizer would move that below the bitmap.
    return likely.join(leaves, "leaf")


def template_links(lines: DataFrame) -> DataFrame:
    """(u, v): hashes of a masked line and of the more frequent line whose template it joins.

    ``lines`` are those of leaves that hold several different lines.
    """
    # As many runs as leave one equal where the tolerated number of positions differ.
    spare = F.floor((1 - SIMILARITY) * F.col("tokens") + 1e-9).cast("int")
    width = F.greatest(F.lit(1), F.floor((F.col("tokens") - DEPTH) / (spare + 1)).cast("int"))

    def piece(run: Column) -> Column:
        # The last run takes the rest.
        size = F.when(run == F.col("spare"), F.col("tokens")).otherwise(F.col("width"))
        return F.xxhash64("leaf", run, F.slice("list", F.lit(DEPTH + 1) + run * F.col("width"), size))

    counted = lines.groupBy("leaf", "masked", "tokens").agg((-F.count(F.lit(1))).alias("less"))
    cut = counted.withColumns({"spare": spare, "width": width, "list": F.split("masked", " ")})
    kinds = settled(cut.select(
        F.xxhash64("masked").alias("line"), "masked", "less",
        F.transform(F.sequence(F.lit(0), "spare"), piece).alias("pieces")), "templates")
    runs = kinds.select("line", "pieces", F.posexplode("pieces").alias("run", "piece")).select(
        "line", "piece", F.when(F.col("run") == 0, F.col("line")).otherwise(
            F.get("pieces", F.col("run") - 1)).alias("before"))
    # Lines that all share the run before as well have met there.
    fresh = runs.groupBy("piece").agg(F.min("before").alias("a"), F.max("before").alias("b")).where(
        "a <> b").select("piece")
    met = block_pairs(runs.join(fresh, "piece").select("line", "piece"), ["piece"],
                      F.col("line"), BLOCK)
    marks = F.transform(F.split("masked", " "), lambda token, at: F.xxhash64(at, token))
    groups = met.join(kinds, "line").groupBy("piece", "low", "high").agg(F.collect_list(F.struct(
        "line", "own", "less", "masked", "pieces", marks.alias("marks"))).alias("members"))

    def best(x: Column) -> Column:
        """The most similar more frequent line of those that x first meets in this run."""
        met_here = F.filter("members", lambda y: (
            (F.struct(y["less"], y["masked"]) < F.struct(x["less"], x["masked"]))
            & ((F.col("low") == F.col("high")) | (y["own"] != x["own"]))
            & (F.get(F.array_intersect(x["pieces"], y["pieces"]), F.lit(0)) == F.col("piece"))))
        compared = F.transform(met_here, lambda y: F.struct(
            (-F.size(F.array_intersect(x["marks"], y["marks"]))).alias("unlike"),
            y["less"].alias("less"), y["masked"].alias("head"), y["line"].alias("v")))
        return F.array_min(F.filter(
            compared, lambda z: 1e-9 - z["unlike"] >= SIMILARITY * F.size(x["marks"])))

    found = groups.select(F.explode(F.transform("members", lambda x: F.struct(
        x["line"].alias("u"), best(x).alias("best")))).alias("one")).select("one.u", "one.best")
    return found.where("best is not null").groupBy("u").agg(F.min("best").alias("best")).select(
        "u", F.col("best.v").alias("v"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """document (key) and drops, the numbers (from 0) of its lines that go."""
    every = settled(lines_of(docs).select(
        "document", "doc_id", "line_no", "leaf", F.xxhash64("masked").alias("line")), "lines")
    leaves = every.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b")).where(
        "a <> b").select("leaf")
    roots = connected_components(
        template_links(_in_crowded_leaves(lines_of(docs), leaves)), "template-groups")
    known = settled(every.join(roots, F.col("line") == F.col("node"), "left").select(
        "document", "doc_id", "line_no", F.coalesce("root", "line").alias("template")),
        "line-templates")
    first = F.struct("doc_id", "document", "line_no")
    recurring = settled(
        known.groupBy("template", "document").agg(F.min(first).alias("first"),
                                                  F.count(F.lit(1)).alias("n"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("documents"),
                                 F.min("first").alias("first"), F.sum("n").alias("n"))
        .where(F.col("documents") >= MIN_DOCS).select("template", "first", "n"), "recurring")
    later = (F.col("document") != F.col("first.document")) | (
        F.col("line_no") != F.col("first.line_no"))
    return keyed_join(known, recurring, ["template"]).where(later).groupBy("document").agg(
        F.collect_set("line_no").alias("drops"))


def drop_recurring_lines(docs: DataFrame, n_lines: str = "n_lines",
                         n_dropped: str = "n_dropped") -> DataFrame:
    """The documents without recurring lines, with the numbers of lines and of dropped ones.

    Columns with the names of these two are replaced.
    """
    docs = docs.drop(n_lines, n_dropped)
    key, gone = fresh_name(docs, "_document"), fresh_name(docs, "_drops")
    drops = dropped_lines(docs).select(F.col("document").alias(key), F.col("drops").alias(gone))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    joined = docs.withColumn(key, row_key("doc_id", "text")).join(drops, key, "left")
    return joined.select(
        *[F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias(c)
          if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).alias(n_dropped))

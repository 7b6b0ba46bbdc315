r"""Quality rules by the divergence of a document's histograms from those of its language.

Base rules count words, symbols, repeated lines and words in repeated windows of five.  Documents
that pass them are compared with the references of their language (the ``lang`` column; a null is
a language of its own): the histogram of character classes and that of the ``COMMON`` words
which stand in most documents of the language, all other words being one more bin.  A reference
holds the median share of every bin, scaled to one, over the language's documents that are long
enough to judge, so that less than half of them being junk does not move it far.  Documents weigh
the same, but that copies of one text which are over a thousandth of all rows weigh as one document
together.  A document is kept if both Jensen-Shannon distances (base 2) are within their limits.

Minimum lengths: the distance of a true sample falls as the root of its size, so a limit is
``BASE + SPREAD / sqrt(size)``, and texts of fewer than ``MIN_WORDS`` words are not judged by words,
those of fewer than ``MIN_CHARS`` characters not by classes.  A language of fewer than ``MIN_DOCS``
documents of that length has no reference; its documents are judged by the base rules alone.

Only DataFrame functions are used, and no text is shuffled.  Words that stand in most documents
are found in two counts: by hash bucket (at most ``BUCKETS`` rows a language), then exactly in the
buckets that hold as many as the least of the words found so far; the rest cannot hold one.
Hashes of large groups of copies, fewer than a thousand, are broadcast, and so are the tables of
languages with over a thousandth of all documents; texts of other languages, if any, are joined by
language.

Null, empty and repeated: a null text is an empty one, has no words and fails; equal words in equally
many documents are ranked by text; rows are judged each for itself, repeated or not, and count
each in the references; an empty table gives no row; texts of any length are read whole.  Other
columns are ignored; ``judged`` returns those named beside the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulint.llm.common import HOT_SHARE, keyed_join, settled

WINDOW, MIN_DOC_WORDS, MOST_REPEATED = 5, 10, 20
COMMON, MIN_DOCS, STEPS = 16, 20, 4096
MIN_WORDS, WORD_BASE, WORD_SPREAD = 40, 0.11, 1.75
MIN_CHARS, CLASS_BASE, CLASS_SPREAD = 200, 0.1, 3.0
BUCKETS, FIRST_BUCKETS = 4096, 64
# The weight of a document in whole numbers, so that sums do not depend on their order.
WEIGHT = 1_000_000
SPACE, BLANKS = r"[\x20\x09-\x0D]", " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
# Character classes, each of what the ones before have left.
CLASSES = [r"\p{Ll}", SPACE, r"\p{Lu}", r"\p{N}", r"[.,;:!?'\"()\-]", r"[\p{L}\p{M}]"]
NO_LANGUAGE = "?"
BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern + "+", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _behind(array: Column, step: int) -> Column:
    """The array without its first entries."""
    return F.slice(array, F.lit(step + 1), F.size(array))


def words_of(text: Column) -> Column:
    """What stands between spaces; one empty word in a text of nothing else is left out."""
    return F.array_remove(F.split(F.btrim(text, F.lit(BLANKS)), SPACE + "+"), "")


def bare_words(text: Column) -> Column:
    """The words in lower case without the marks at their ends; one empty word if there is none."""
    bare = F.regexp_replace(F.lower(text), rf"[.,;:!?]+(?={SPACE}|\z)", "")
    return F.split(F.btrim(bare, F.lit(BLANKS)), SPACE + "+")


def window_hashes(words: Column) -> Column:
    """A hash for every window of five words, in order: of pairs, of pairs of these, of five."""
    def paired(a: Column, b: Column, step: int) -> Column:
        # The shorter side is padded with nulls, which are cut off at the end.
        return F.zip_with(a, _behind(b, step), lambda x, y: F.xxhash64(x, y))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(
        paired(h, h, 1), lambda two: F.slice(paired(paired(two, two, 2), h, 4), F.lit(1), F.greatest(
            F.lit(0), F.size(words) - WINDOW + 1))))


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the given places, in any order."""
    return _let(F.sort_array(starts), lambda at: F.aggregate(
        F.zip_with(at, _behind(at, 1), lambda a, b: F.least(
            F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more.

    Windows are sorted by half of their hash, with their place in the other half of the number.
    Where neighbours agree in that half, the windows themselves decide.
    """
    def window(at: Column) -> Column:
        return F.slice(words, at + 1, F.lit(WINDOW))

    def keys(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda x, i: F.shiftleft(x, 32) + i))

    def half(key: Column) -> Column:
        return F.shiftright(key, 32)

    def place(key: Column) -> Column:
        return key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def with_next(ranked: Column) -> Column:
        """Places of pairs of neighbours with equal halves: every repeated window is in one."""
        return F.filter(F.zip_with(ranked, _behind(ranked, 1), lambda a, b: F.when(
            half(a) == half(b), F.struct(place(a).alias("a"), place(b).alias("b")))),
            lambda p: p.isNotNull())

    def places(pairs: Column) -> Column:
        return F.array_union(F.transform(pairs, lambda p: p["a"]),
                             F.transform(pairs, lambda p: p["b"]))

    def exactly(pairs: Column) -> Column:
        """Equal halves of different windows: all windows in question, sorted by their words."""
        ranked = F.sort_array(F.transform(places(pairs), lambda i: F.struct(
            F.array_join(window(i), " ").alias("w"), i.alias("i"))))
        same = _let(ranked, lambda r: F.filter(F.zip_with(
            r, _behind(r, 1), lambda x, y: F.when(
                x["w"] == y["w"], F.struct(x["i"].alias("a"), y["i"].alias("b")))),
            lambda p: p.isNotNull()))
        return _let(same, lambda p: _covered(places(p)))

    def counted(pairs: Column) -> Column:
        differ = F.exists(pairs, lambda p: window(p["a"]) != window(p["b"]))
        return F.when(F.size(pairs) == 0, F.lit(0)).when(differ, exactly(pairs)).otherwise(
            _covered(places(pairs)))

    def found(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(
            keys(hashes), lambda r: _let(with_next(r), counted))).otherwise(F.lit(0))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(window_hashes(words), found))


def base_counts(texts: DataFrame, *keep: str) -> DataFrame:
    """The counts, with the words and ``classes``, characters of each class, of texts (not null)."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # What neither small letters nor spaces are is little, and looked through several times.
    read = texts.withColumns({"words": words_of(F.col("text")), "n_chars": F.length("text"),
                              "rest": _without(F.col("text"), r"[\p{Ll}\x20\x09-\x0D]")})
    n_words, word_chars = F.size("words"), F.length(F.array_join("words", ""))
    spaces = F.col("n_chars") - word_chars
    left, lengths = F.col("rest"), [F.length("rest")]
    for pattern in CLASSES[2:]:
        left = _without(left, pattern)
        lengths.append(F.length(left))
    others = _let(F.array(*lengths), lambda x: F.transform(
        x, lambda count, i: count - F.coalesce(F.get(x, i + 1), F.lit(0))))
    small = F.col("n_chars") - F.length("rest") - spaces
    return read.select(
        *keep, "words", "n_chars", n_words.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (F.length("rest") - F.length(_without(F.col("rest"), SYMBOLS))).cast("long")
        .alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
        .alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform(F.concat(F.array(small, spaces), others), lambda n: n.cast("double"))
        .alias("classes"))


def word_counts(words: Column, common: Column, n_words: Column) -> Column:
    """How often each common word occurs among bare words, and how many other words there are.

    ``words`` are narrowed to the buckets of the common words; the rest is searched as one text.
    """
    def count(text: Column, word: Column) -> Column:
        # Words have two blanks between them, of which the search takes one on either side.
        rest = F.octet_length(F.replace(text, F.concat(F.lit(" "), word, F.lit(" ")), F.lit("")))
        return ((F.octet_length(text) - rest) / (F.octet_length(word) + 2)).cast("double")

    text = F.concat(F.lit(" "), F.array_join(_flagged(words), "  "), F.lit(" "))
    counts = _let(text, lambda t: F.transform(common, lambda w: count(t, w)))
    return _let(counts, lambda c: F.concat(
        c, F.array(n_words.cast("double") - F.aggregate(c, F.lit(0.0), lambda a, b: a + b))))


# --- references -------------------------------------------------------------------------------

def _language(docs: DataFrame) -> Column:
    if "lang" not in {c.lower() for c in docs.columns}:
        return F.lit(NO_LANGUAGE)
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(NO_LANGUAGE))


def weighted(texts: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """The texts with the weight each has in the references."""
    key = F.xxhash64("text")
    copies = settled(texts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies")),
                     "text-copies")
    total = copies.agg(F.sum("copies")).first()[0] or 0
    large = copies.where((F.col("copies") > 1) & (F.col("copies") * share > total))
    return texts.withColumn("key", key).join(F.broadcast(large), "key", "left").select(
        *texts.columns, F.expr(f"greatest(1, coalesce({WEIGHT} div copies, {WEIGHT}))").alias("weight"))


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _flags(buckets: Column) -> Column:
    """For every bucket whether it is among the given ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)),
                       lambda i: F.array_contains(buckets, i))


def _flagged(words: Column) -> Column:
    return F.filter(words, lambda w: F.get("flags", _bucket(w)))


def _first(counts: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows with most documents a language; ranked in every task before the shuffle."""
    order = Window.partitionBy("language").orderBy(F.desc("docs"), by)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def common_words(texts: DataFrame) -> DataFrame:
    """language, n (its documents), common, the COMMON words in most of these, and their flags."""
    every = texts.select("language", "weight", bare_words(F.col("text")).alias("words"))
    docs = F.sum("weight").alias("docs")
    languages = settled(texts.groupBy("language").agg(F.count(F.lit(1)).alias("n")), "languages")
    # A document counts once in each bucket it has words in, so a bucket has at least the
    # documents of any of its words.
    found_in = F.array_distinct(F.transform("words", _bucket))
    buckets = settled(
        every.select("language", "weight", F.explode(found_in).alias("bucket"))
        .groupBy("language", "bucket").agg(docs), "word-buckets")

    def counted(chosen: DataFrame) -> DataFrame:
        """Documents of every word of the chosen buckets."""
        wanted = settled(chosen.groupBy("language").agg(F.collect_list("bucket").alias("chosen"))
                         .select("language", _flags(F.col("chosen")).alias("flags")).join(languages, "language"),
                         "buckets")
        held = F.array_distinct(_flagged(F.col("words")))
        return keyed_join(every, wanted, ["language"]).select(
            "language", "weight", F.explode(held).alias("word")).where("word <> ''").groupBy(
            "language", "word").agg(docs)

    tried = _first(buckets, "bucket", FIRST_BUCKETS).select("language", "bucket")
    found = settled(_first(counted(tried), "word", COMMON).drop("place"), "common-words")
    least = found.groupBy("language").agg(
        F.when(F.count(F.lit(1)) == COMMON, F.min("docs")).otherwise(F.lit(0)).alias("least"))
    # Any word that outranks these stands in a bucket with as many documents.
    others = settled(buckets.join(tried, ["language", "bucket"], "left_anti").join(
        least, "language").where(F.col("docs") >= F.col("least")).select("language", "bucket"),
        "other-buckets")
    if not others.isEmpty():
        found = _first(found.unionByName(counted(others)), "word", COMMON)
    lists = found.groupBy("language").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("docs")).alias("less"), "word"))).alias("ranked"))
    common = F.coalesce(F.transform("ranked", lambda s: s["word"]),
                        F.array().cast("array<string>"))
    return settled(languages.join(lists, "language", "left").select(
        "language", "n", common.alias("common"),
        _flags(F.transform(common, _bucket)).alias("flags")), "common")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return _let(total, lambda t: F.transform(counts, lambda x: F.try_divide(x, t)))


def reference_histograms(known: DataFrame) -> DataFrame:
    """language, n, usual_bins and usual_classes: weighted medians of the shares, scaled to one.

    Medians are those of shares in steps of 1/``STEPS``, found from counts by step, so that any
    number of documents comes down to at most ``STEPS`` rows a language and bin.  They are null
    for a language with too few documents that are long enough to judge.
    """
    material = known.where((F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS))
    shares = F.concat(_shares(F.col("classes")), _shares(F.col("bins")))
    stepped = F.transform(shares, lambda x: F.floor(x * STEPS).cast("int"))
    steps = material.select("language", "weight", F.posexplode(stepped).alias("bin", "step")).groupBy(
        "language", "bin", "step").agg(F.sum("weight").alias("weight"))
    below = Window.partitionBy("language", "bin").orderBy("step")
    total = F.sum("weight").over(Window.partitionBy("language", "bin"))
    medians = steps.select("language", "bin", "step", F.sum("weight").over(below).alias("so_far"),
                           total.alias("total")).where(
        (2 * F.col("so_far") >= F.col("total")) & (F.col("total") >= MIN_DOCS * WEIGHT)).groupBy(
        "language", "bin").agg(F.min("step").cast("double").alias("step"))
    ordered = F.array_sort(F.collect_list(F.struct("bin", "step")))
    classes = len(CLASSES) + 1

    def usual(part: Column) -> Column:
        return _shares(F.transform(part, lambda s: s["step"]))

    lists = medians.groupBy("language").agg(ordered.alias("all")).select(
        "language", usual(F.slice("all", 1, classes)).alias("usual_classes"),
        usual(F.slice("all", F.lit(classes + 1), F.size("all"))).alias("usual_bins"))
    languages = known.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    return settled(languages.join(lists, "language", "left"), "references")


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance (base 2, a root) of two distributions of one length."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    both = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(F.greatest(F.lit(0.0), both / 2))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns named, the base counts, base_failed, both distances and kept, for every row.

    A distance is null where it is not judged.  Of the columns named, those with the name of
    a result are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("own"),
                        _language(docs).alias("language"), text.alias("text"))
    texts = weighted(texts)
    lists = common_words(texts)
    read = base_counts(keyed_join(texts, lists, ["language"]), "own", "language", "weight", "common", "flags",
                       "text")
    counts = [*BASE_COUNTS]
    known = settled(read.select(
        "own", "language", "weight", *counts, "n_chars", "classes",
        word_counts(bare_words(F.col("text")), F.col("common"), F.col("n_words")).alias("bins")),
        "histograms")

    references = reference_histograms(known)
    words = F.when(F.col("n_words") >= MIN_WORDS,
                   divergence(_shares(F.col("bins")), F.col("usual_bins")))
    classes = F.when((F.col("n_chars") >= MIN_CHARS) & (F.col("n_words") > 0),
                     divergence(_shares(F.col("classes")), F.col("usual_classes")))
    failed = (F.col("n_words") < MIN_DOC_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = keyed_join(known, references, ["language"]).select(
        "own", *counts, "n_chars", failed.alias("base_failed"),
        words.alias("word_distance"), classes.alias("class_distance"))

    def within(distance: str, base: float, spread: float, size: str) -> Column:
        return F.coalesce(F.col(distance) <= base + spread / F.sqrt(F.col(size)), F.lit(True))

    results = [*counts, "base_failed", "word_distance", "class_distance"]
    taken = {*results, "kept"}
    return measured.select(
        *[F.col("own")[c].alias(c) for c in keep if c.lower() not in taken], *results,
        (~F.col("base_failed") & within("word_distance", WORD_BASE, WORD_SPREAD, "n_words")
         & within("class_distance", CLASS_BASE, CLASS_SPREAD, "n_chars")).alias("kept"))

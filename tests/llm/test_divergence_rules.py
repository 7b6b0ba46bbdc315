"""Quality rules: base counts by hand, verdicts against SQL and on texts of another kind."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from rivulint.llm import divergence_rules, queries, sql

FIELDS = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again,
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


ODD = [None, "", " \n\t\x0b\x0c\r ", "a", "a b c d e", "a b c d e a b c d e",
       "x " * 300, "one two three four five six " * 40, "l\nl\n\n\nl \nl", "a\rb\r\na\rb",
       "été là où ça été là où ça été là où ça", "日本語 テキスト " * 30, "#*$%&|<> " * 9,
       "a" * 100_000, "w%d " * 5, "    　", "... ... !! ?? .", "𝔘𝔫𝔦 𝔠𝔬𝔡𝔢 é",
       " ".join(f"w{i % 97}" for i in range(20_000)), "a b c d e f " + "q r s t u " * 2]


def table_of(spark, texts, lang="xx"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], FIELDS)


def test_base_counts_of_odd_texts(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(80)]
    found = divergence_rules.judged(table_of(spark, texts), "doc_id").collect()
    assert len(found) == len(texts)
    for r in found:
        have = tuple(r[c] for c in divergence_rules.BASE_COUNTS) + (r.base_failed,)
        assert have == plain_counts(texts[r.doc_id]), texts[r.doc_id]


def agrees(spark, rows):
    """The operator and its SQL over the given rows."""
    df = spark.createDataFrame(rows, FIELDS)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    names = ["doc_id", *divergence_rules.BASE_COUNTS, "base_failed", "kept"]
    have = Counter(tuple(r) for r in divergence_rules.judged(df, "doc_id").select(*names).collect())
    want = Counter(con.sql(f"SELECT {', '.join(names)} FROM ({sql.OP11})").fetchall())
    assert have == want
    return {r[0]: r[-1] for r in have}


def made_texts(seed=1):
    """Three languages of made words; clean ones, and shouted, spoiled and listed ones."""
    rng = random.Random(seed)
    rows = []
    for lang, letters in (("aa", "aeioulmn"), ("bb", "bcdfgouy"), (None, "krstuvwa")):
        common = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
        def word():
            if rng.random() < 0.4:
                return rng.choice(common)
            return "".join(rng.choice(letters) for _ in range(rng.randrange(4, 11)))
        for i in range(120):
            words = [word() for _ in range(rng.choice([15, 60, 200, 500]))]
            kind = i % 12
            if kind == 0:
                words = [w.upper() + "!!" for w in words]
            elif kind == 1:
                words = [w + "%%%" for w in words]
            rows.append((len(rows), " ".join(words), lang))
    return rows


def test_spoiled_texts_diverge_and_clean_ones_stay(spark):
    rows = made_texts()
    rows += [(1_000 + i, t, "aa") for i, t in enumerate(ODD)]
    rows += [(2_000 + i, rows[5][1], "aa") for i in range(150)]   # a third are copies
    rows += [(3_000, "a few words of a rare language " * 3, "zz")]
    kept = agrees(spark, rows)
    long_ones = [r for r in rows[:360] if len(r[1].split()) >= 60]
    spoiled = [r[0] for r in long_ones if r[0] % 120 % 12 in (0, 1)]
    clean = [r[0] for r in long_ones if r[0] % 120 % 12 not in (0, 1)]
    assert not any(kept[i] for i in spoiled)
    assert sum(kept[i] for i in clean) >= 0.99 * len(clean)
    assert all(kept[i] for i in range(2_000, 2_150))


@pytest.mark.parametrize("first", [1, 3])
def test_common_words_beyond_the_first_buckets(spark, monkeypatch, first):
    """Few buckets at first: the second count finds the rest, exactly."""
    monkeypatch.setattr(divergence_rules, "FIRST_BUCKETS", first)
    rows = made_texts(4)
    texts = spark.createDataFrame(rows, FIELDS).selectExpr(
        "text", "coalesce('=' || lang, '?') as language", "1000000L as weight")
    got = {r.language: r.common for r in divergence_rules.common_words(texts).collect()}
    counts: dict = {}
    for _, text, lang in rows:
        words = {re.sub(r"[.,;:!?]+$", "", w.lower()) for w in text.split()} - {""}
        counts.setdefault(f"={lang}" if lang else "?", Counter()).update(words)
    assert got == {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:16]]
                   for lang, c in counts.items()}


def test_languages_too_rare_to_broadcast(spark, monkeypatch):
    """With a small share most languages go through the shuffled join."""
    from rivulint.llm import common
    monkeypatch.setattr(common.keyed_join, "__defaults__", (2,))
    agrees(spark, made_texts(6))


def test_empty_tables_and_other_columns(spark):
    df = table_of(spark, ODD)
    assert divergence_rules.judged(df.where("false"), "doc_id").count() == 0
    more = df.selectExpr("*", "1 as language", "'a' as own", "2 as n", "3 as Common", "4 as words")
    out = divergence_rules.judged(more, *more.columns)
    assert out.columns[: len(more.columns)] == more.columns and out.count() == len(ODD)
    without = divergence_rules.judged(df.drop("lang"), "doc_id", "text")
    assert without.columns[:2] == ["doc_id", "text"] and without.count() == len(ODD)


def test_junk_of_the_tables_goes_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op11_divergence_rules"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT l.doc_id, quality, length(text) FROM '{sf}/labels.parquet' l "
                        f"JOIN '{sf}/documents.parquet' d USING (doc_id)").fetchall()
    bad = [kept[d] for d, quality, size in labels if quality == 0]
    good = [kept[d] for d, quality, size in labels if quality == 1 and size >= 60]
    print(sum(bad), len(bad), sum(good), len(good))
    assert sum(bad) <= 0.06 * len(bad) and sum(good) >= 0.985 * len(good)

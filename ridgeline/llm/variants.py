"""Spelling variants: words one code point apart, found through wildcard groups and deletions, without pairs of replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, letters: str = r"[A-Za-zÀ-ÿ]", least_length: int = 6, least_count: int = 5, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all texts with A-Z lower-cased, at least so long and so frequent.

    drop_one_in: plant misspellings: where this number divides the crc32 of `<doc_id>:<run>`, the run loses the code point
    at the place that the crc32 names (modulo its length). Null texts have no words, a null doc_id is written as nothing;
    repeated rows count again. Words are counted before the shuffle, so a frequent one is a row a task.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(letters + "{%d,}" % least_length), F.lit(0))).alias("run")
    word = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    words = docs.select("doc_id", run).select("doc_id", word.alias("word"))
    if drop_one_in:
        crc = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("crc") % F.length("word")).cast("int")
        left = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.withColumn("crc", crc).select(F.when(F.col("crc") % drop_one_in == 0, left).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def nearest(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of (word, n), each word once: how many words differ from it by one replaced, inserted or
    deleted code point, and the most frequent of these (of equals the first in code-point order); 0 and nulls without any.

    Replacements: each place of a word names a wildcard group (place, what stands before, what stands after), which keeps its
    size and its first two words only; a group's words differ in one code point, so a group is as large as the alphabet at most.
    Indels: each word's different deletions meet the vocabulary, at most a row for each place of the word.
    Tables meet in merge joins: Spark takes what explode makes of a vocabulary for small, and would collect it to be broadcast.
    """
    c = F.col
    cells = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("p")).select("word", "n", "p", F.substring("word", F.lit(1), c("p") - 1).alias("prefix"), F.substring("word", c("p") + 1, F.length("word")).alias("suffix"))
    ranked = F.struct((-c("n")).alias("m"), c("word").alias("w"))
    groups = cells.groupBy("p", "prefix", "suffix").agg(F.count("*").alias("size"), F.slice(F.sort_array(F.collect_list(ranked)), 1, 2).alias("top")).where("size > 1")
    other = F.when(c("top")[0]["w"] == c("word"), c("top")[1]).otherwise(c("top")[0])
    replaced = cells.join(groups.hint("merge"), ["p", "prefix", "suffix"]).select("word", (c("size") - 1).alias("near"), other.alias("best"))

    shorter = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda p: F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, F.length("word")))))
    deleted = words.select(c("word").alias("long"), c("n").alias("long_n"), F.explode(shorter).alias("word"))
    met = deleted.join(words.hint("merge"), "word")
    sides = F.explode(F.array(F.struct(c("word").alias("word"), F.struct((-c("long_n")).alias("m"), c("long").alias("w")).alias("best")), F.struct(c("long").alias("word"), ranked.alias("best"))))
    indels = met.select(sides.alias("s")).select("s.word", F.lit(1).cast("long").alias("near"), "s.best")

    found = replaced.unionByName(indels).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), c("best.w").alias("near"), (-c("best.m")).alias("near_n"))


def variant_forms(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its nearest word (see nearest) if that is ratio times as frequent, else null.

    root: the last word that forms lead to from the word, itself if it has no form. Frequencies grow by the ratio at each
    step, so a path has log(n) steps at most, and each round doubles how far paths are followed. Repeated words are summed
    up, null ones left out; no words give no rows.
    """
    c = F.col
    words = staged(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    has = c("near_n") >= ratio * c("n")
    forms = staged(nearest(words).select("word", F.when(has, c("near")).alias("form"), "n", "n_near", F.when(has, c("near_n")).alias("form_n")), "forms")
    paths = forms.where("form is not null").select("word", c("form").alias("to"))
    while True:
        step = paths.select(c("word").alias("to"), c("to").alias("next"))
        paths = staged(paths.join(step.hint("merge"), "to", "left").select("word", F.coalesce("next", "to").alias("to"), c("next").isNotNull().alias("moved")), "paths")
        if not paths.where("moved").limit(1).count():
            break
        paths = paths.select("word", "to")
    return forms.join(paths.select("word", c("to").alias("root")).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Inline citations of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import marker_numbers, marker_texts, sentences

SNIPPET = 200


def citations(answers: DataFrame, key: str, answer: str, n_contexts: Column) -> DataFrame:
    """One row for each mark of each sentence, a mark once a sentence: (key, sent_ord, answer_sentence, marker, valid).

    A mark is valid if it numbers one of the contexts.
    """
    s = answers.select(key, n_contexts.alias("_n"), F.posexplode(sentences(F.col(answer))).alias("sent_ord", "answer_sentence"))
    m = s.select(key, "_n", (F.col("sent_ord") + 1).alias("sent_ord"), "answer_sentence", F.explode(F.array_distinct(marker_numbers(F.col("answer_sentence")))).alias("marker"))
    return m.select(key, "sent_ord", "answer_sentence", "marker", ((F.col("marker") >= 1) & (F.col("marker") <= F.col("_n"))).alias("valid"))


def citation_stats(answers: DataFrame, key: str, answer: str, n_contexts: Column) -> DataFrame:
    """Sentences, sentences with marks, marks (repeats count) and invalid marks of each answer."""
    s = sentences(F.coalesce(F.col(answer), F.lit("")))
    bad = lambda m: (m < 1) | (m > F.col("_n"))
    x = answers.select(key, s.alias("_s"), n_contexts.alias("_n"))
    return x.select(
        key,
        F.size("_s").alias("n_sentences"),
        F.size(F.filter("_s", lambda t: F.size(marker_texts(t)) > 0)).alias("n_sentences_with_marker"),
        F.aggregate("_s", F.lit(0), lambda a, t: a + F.size(marker_texts(t))).alias("n_markers"),
        F.aggregate("_s", F.lit(0), lambda a, t: a + F.size(F.filter(marker_numbers(t), bad))).alias("n_markers_invalid"),
    )


def with_sources(cited: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Citations with document, parent and a snippet of the context their mark numbers; nulls where there is none."""
    c = contexts.select(key, F.col("rank").alias("marker"), F.col("doc_id").alias("source_doc"), "parent_id", F.replace(F.substring("text", 1, SNIPPET), F.lit("\n"), F.lit(" ")).alias("supporting_snippet"))
    return cited.join(c, [key, "marker"], "left")


def invalid_marks(answer: Column, context: Column, n_contexts: Column) -> Column:
    """Numbers of marks out of range whose text does not stand in the context itself."""
    out = F.filter(marker_texts(answer), lambda t: ~((F.regexp_replace(t, r"[\[\]【】]", "").cast("int") >= 1) & (F.regexp_replace(t, r"[\[\]【】]", "").cast("int") <= n_contexts)) & ~F.contains(F.coalesce(context, F.lit("")), t))
    return F.array_sort(F.array_distinct(F.transform(out, lambda t: F.regexp_replace(t, r"[\[\]【】]", "").cast("int"))))

"""Parent and child chunks of page texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.order import running_sums
from tarn.session import ship
from tarn.storage import Scratch

#: Separators in the order they are tried (fixed values); the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", "。", ".", "！", "？", "!", "?", " ", "")
PARENT = (1200, 150)
CHILD = (400, 40)


def _cuts(text: str, lo: int, hi: int, mark: str) -> list[int]:
    """Ends of the pieces of text[lo:hi] that stand before each mark, and hi; every place for the empty mark."""
    if not mark:
        return list(range(lo + 1, hi + 1))
    out, at = [], text.find(mark, lo, hi)
    while at >= 0:
        if at > lo:
            out.append(at)
        at = text.find(mark, at + len(mark), hi)
    return [*out, hi]


def _gather(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> list[str]:
    """Neighbouring spans as windows of at most ``size``, each starting with up to ``overlap`` characters of the last."""
    out, first = [], 0
    for i, (_, hi) in enumerate(spans):
        if i > first and hi - spans[first][0] > size:
            out.append(text[spans[first][0] : spans[i - 1][1]].strip())
            while first < i and (spans[i - 1][1] - spans[first][0] > overlap or hi - spans[first][0] > size):
                first += 1
    out.append(text[spans[first][0] : spans[-1][1]].strip())
    return [w for w in out if w]


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Windows of a text, cut at the first separator that occurs, and its long pieces at later ones.

    A separator belongs to the piece behind it. Pieces shorter than ``size`` gather to
    windows; one as long or longer is cut further, or stands alone when no separator is left.
    Pieces are spans of the one text; those still to be worked on wait on a stack, the first on top.
    """
    if overlap > size:
        raise ValueError(f"overlap {overlap} exceeds size {size}")
    out: list[str] = []
    todo: list = [(0, len(text), 0)]  # spans with the separator to try next (None: whole as it is), and runs of short spans
    while todo:
        part = todo.pop()
        if isinstance(part, list):
            out += _gather(text, part, size, overlap)
            continue
        lo, hi, level = part
        if level is None:
            out.append(text[lo:hi])
            continue
        at = next((i for i in range(level, len(separators)) if not separators[i] or text.find(separators[i], lo, hi) >= 0), None)
        mark = separators[-1 if at is None else at]
        level = at + 1 if at is not None and mark and at + 1 < len(separators) else None
        row: list = []
        for end in _cuts(text, lo, hi, mark):
            if end - lo >= size:
                row.append((lo, end, level))
            elif end > lo and row and isinstance(row[-1], list):
                row[-1].append((lo, end))
            elif end > lo:
                row.append([(lo, end)])
            lo = end
        todo += reversed(row)
    return out


def chunk(pages: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD) -> DataFrame:
    """Children with their parents: doc_id, page, parent_id, parent_ord, parent_text, chunk_uid, child_ord, text.

    ``pages`` has doc_id, page and text. Chunks never cross pages; ordinals run over a
    document's pages in order. Pages are cut in parallel; ordinals come from windows over their
    counts, so that a document of any length is never in one task with its texts.
    """
    ship(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for d, page, text in zip(pdf["doc_id"], pdf["page"], pdf["text"], strict=True):
                k = 0
                for i, p in enumerate(split_text(text or "", *parent)):
                    for c in split_text(p, *child):
                        rows.append((d, page, i, k, p, c))
                        k += 1
            yield pd.DataFrame(rows, columns=["doc_id", "page", "p", "k", "parent_text", "text"])

    types = dict(pages.dtypes)
    cut = pages.select("doc_id", "page", "text").mapInPandas(run, f"doc_id {types['doc_id']}, page {types['page']}, p int, k int, parent_text string, text string")
    sizes = cut.groupBy("doc_id", "page").agg(F.max("p").alias("p"), F.max("k").alias("k"))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("doc_id", "page", F.coalesce(F.sum(F.col("p") + 1).over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum(F.col("k") + 1).over(before), F.lit(0)).alias("k0"))
    out = cut.join(base, ["doc_id", "page"]).withColumns({"parent_ord": (F.col("p") + F.col("p0")).cast("int"), "child_ord": (F.col("k") + F.col("k0")).cast("int")})
    return out.select("doc_id", "page", F.format_string("%s:p%04d", F.col("doc_id").cast("string"), "parent_ord").alias("parent_id"), "parent_ord", "parent_text", F.format_string("%s:c%05d", F.col("doc_id").cast("string"), "child_ord").alias("chunk_uid"), "child_ord", "text")


def parents_of(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("parent_id").agg(F.min("doc_id").alias("doc_id"), F.min("page").alias("page"), F.min("parent_ord").alias("ord"), F.min("parent_text").alias("text"))


def children_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_uid", "parent_id", "doc_id", "page", F.col("child_ord").alias("ord"), "text")


def census(chunks: DataFrame, tokens_per_char: float = 0.269) -> DataFrame:
    """Per document: child characters, children, estimated tokens, and running totals in order of the document."""
    d = chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("children"))
    d = d.withColumn("tokens", F.round(F.col("chars") * tokens_per_char).cast("long"))
    return running_sums(d, [], ["doc_id"], {"chars_so_far": F.col("chars"), "children_so_far": F.col("children")}, Scratch(chunks.sparkSession, "census"))

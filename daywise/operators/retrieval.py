"""Lexical retrieval of pages and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.operators.layout import reading_order


def question_terms(question: str) -> list[str]:
    """Words between white space, in lower case; the distinct characters of a question without any."""
    return sorted({w for w in question.lower().split() if w} or set(question))


def _hit(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def retrieve_pages(lines: DataFrame, question: str, *, max_pages: int | None = None, adjacent: bool = True, min_hits: int = 1, page_cap: int = 64) -> DataFrame:
    """``document_token, page_number, hits, chosen_as, truncated, can_read_more``: whole pages on which lines contain a term of the question.

    Pages rank by hit lines, then by number; with ``adjacent`` the pages beside chosen ones come too. Without
    ``max_pages`` all pages with hits are chosen, up to the feature's ``page_cap`` in page order; with it the best,
    and at most two more. A document without hits gives its first page. ``truncated`` tells that ``max_pages`` was given
    and pages were not chosen, ``can_read_more`` that fewer pages are returned than the document has.
    """
    terms = question_terms(question)
    pages = reading_order(lines).groupBy("document_token", "page_number").agg(F.count_if(_hit(F.col("text"), terms)).alias("hits"))
    doc = Window.partitionBy("document_token")
    ranked = pages.withColumn("rank", F.row_number().over(doc.orderBy(F.col("hits").desc(), "page_number")))
    found = F.col("hits") >= min_hits
    ranked = ranked.withColumn("hit", found & (F.lit(True) if max_pages is None else F.col("rank") <= max_pages))
    order = doc.orderBy("page_number")
    beside = F.coalesce(F.lag("hit").over(order), F.lit(False)) | F.coalesce(F.lead("hit").over(order), F.lit(False))
    marked = ranked.withColumns({"beside": beside & F.lit(adjacent), "any": F.max("hit").over(doc), "place": F.row_number().over(order), "pages": F.count(F.lit(1)).over(doc)})
    kept = marked.withColumn("chosen_as", F.when(F.col("hit"), "hit").when(F.col("beside"), "adjacent").when(~F.col("any") & (F.col("place") == 1), "first")).filter("chosen_as is not null")
    most = page_cap if max_pages is None else max_pages + (2 if adjacent else 0)
    counted = kept.withColumns({"n": F.row_number().over(order), "chosen": F.count(F.lit(1)).over(doc)}).filter(F.col("n") <= most)
    truncated = F.lit(max_pages is not None) & (F.col("chosen") < F.col("pages"))
    return counted.select("document_token", "page_number", "hits", "chosen_as", truncated.alias("truncated"), (F.least("chosen", F.lit(most)) < F.col("pages")).alias("can_read_more"))


def retrieve_lines(lines: DataFrame, question: str, *, top_k: int = 40, window: int = 1) -> DataFrame:
    """``document_token, line_index, hits``: per document the ``top_k`` lines by distinct shared characters, with neighbours.

    Lines without a shared character are never chosen but as neighbours; a document in which no line shares one, as
    with a question without letters and digits, comes whole. Blank lines are passed over.
    """
    letters = sorted({c for c in question if c.isalnum()})
    shared = F.size(F.array_intersect(F.array_distinct(F.split("text", "")), F.array(*[F.lit(c) for c in letters]).cast("array<string>")))
    seen = reading_order(lines).filter(F.trim("text") != "").withColumn("hits", shared)
    doc = Window.partitionBy("document_token")
    seen = seen.withColumns({"place": F.row_number().over(doc.orderBy("line_index")), "rank": F.row_number().over(doc.orderBy(F.col("hits").desc(), "line_index"))})
    seen = seen.withColumn("top", ((F.col("rank") <= top_k) & (F.col("hits") > 0)).cast("int"))
    near = F.max("top").over(doc.orderBy("place").rowsBetween(-window, window))
    whole = F.max("hits").over(doc) == 0
    return seen.withColumns({"near": near, "whole": whole}).filter("near = 1 or whole").select("document_token", "line_index", "hits")

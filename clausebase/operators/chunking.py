"""Chunks of whole paragraphs with the clause and pages they come from, packed in one fold over each document's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import let
from ..functions.text import clause_ref, fence, paragraphs, sentences, word_count

MIN_WORDS = 200
MAX_WORDS = 500


def units(pages: Column, max_words: int) -> Column:
    """Paragraphs in order, those over max_words as sentences: struct(text, page, own, words, kind, first, last).

    kind is P or S; first and last mark the ends of a cut paragraph.
    """

    def of_paragraph(text: Column, page: Column) -> Column:
        own = clause_ref(text)
        whole = F.array(F.struct(text.alias("text"), page.alias("page"), own.alias("own"), word_count(text).alias("words"), F.lit("P").alias("kind"), F.lit(False).alias("first"), F.lit(False).alias("last")))
        parts = sentences(text)
        cut = F.transform(parts, lambda s, i: F.struct(s.alias("text"), page.alias("page"), own.alias("own"), word_count(s).alias("words"), F.lit("S").alias("kind"), (i == 0).alias("first"), (i == F.size(parts) - 1).alias("last")))
        return F.when(word_count(text) > max_words, cut).otherwise(whole)

    by_page = F.transform(pages, lambda text, i: F.flatten(F.transform(paragraphs(text, 2 * MAX_WORDS), lambda p: of_paragraph(p, i + 1))))
    return F.flatten(by_page)


def pack(of: Column, min_words: int, max_words: int) -> Column:
    """Where chunks begin: struct(at, clause) for each, the place of its first unit and the clause in effect there.

    A paragraph starts a new chunk when it would pass max_words and the open
    chunk has min_words; a chunk that has max_words is closed.  A cut paragraph
    makes chunks of its own, each filled with sentences up to max_words.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("words"), F.lit(False).alias("open"), F.lit(None).cast("string").alias("clause"), F.array().cast("array<struct<at:int,clause:string>>").alias("begins"))

    def step(a: Column, u: Column) -> Column:
        over = a["words"] + u["words"] > max_words
        fresh = ~a["open"] | F.when(u["kind"] == "S", u["first"] | over).otherwise(over & (a["words"] >= min_words))
        words = F.when(fresh, 0).otherwise(a["words"]) + u["words"]
        shut = F.when(u["kind"] == "S", u["last"]).otherwise(words >= max(min_words, max_words))
        clause = F.coalesce(u["own"], a["clause"])
        begins = F.when(fresh, F.concat(a["begins"], F.array(F.struct(a["at"].alias("at"), clause.alias("clause"))))).otherwise(a["begins"])  # copied once for each chunk
        return F.struct((a["at"] + 1).alias("at"), F.when(shut, 0).otherwise(words).alias("words"), (~shut).alias("open"), clause.alias("clause"), begins.alias("begins"))

    return F.aggregate(of, zero, step, lambda a: a["begins"])


def chunk_documents(docs: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per chunk of docs (doc_id, pages array<string>, and any of the chunk table's document columns).

    Adds chunk_id, chunk_index, text, clause_ref (the one in effect at its
    first unit), page_start, page_end.  No shuffle: each document is folded in
    its own row, and each of its units is copied into one chunk.
    """
    rest = [c for c in docs.columns if c != "pages"]
    own = docs.select(*rest, fence(units(F.col("pages"), max_words)).alias("chunk_units")).where(F.size("chunk_units") > 0)
    own = own.select(*rest, "chunk_units", fence(pack(F.col("chunk_units"), min_words, max_words)).alias("chunk_begins"))

    def chunk(b: Column, i: Column) -> Column:
        end = F.coalesce(F.get("chunk_begins", i + 1)["at"], F.size("chunk_units"))
        return let(F.slice("chunk_units", b["at"] + 1, end - b["at"]), lambda part: F.struct(_joined(part).alias("text"), b["clause"].alias("clause_ref"), F.array_min(F.transform(part, lambda u: u["page"])).alias("page_start"), F.array_max(F.transform(part, lambda u: u["page"])).alias("page_end")))

    own = own.select(*rest, F.posexplode(fence(F.transform("chunk_begins", chunk))).alias("chunk_index", "chunk"))
    return own.select(F.concat(F.col("doc_id").cast("string"), F.lit("::chunk"), F.col("chunk_index").cast("string")).alias("chunk_id"), *rest, "chunk_index", "chunk.text", "chunk.clause_ref", "chunk.page_start", "chunk.page_end")


def _joined(part: Column) -> Column:
    texts = F.transform(part, lambda u: u["text"])
    return F.when(F.get(part, F.lit(0))["kind"] == "S", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n\n"))

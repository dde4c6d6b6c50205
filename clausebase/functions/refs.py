"""A document's own number and date, and its references to other documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let, parse_date

# fixed values: patterns, windows and relations
HEAD_CHARS = 1500
LOOKAHEAD_CHARS = 200
DATE = r"\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}|\d{1,2}(?:st|nd|rd|th)?\s+[A-Za-z]{3,9}\.?,?\s+\d{4}"
OWN_NUMBER = r"(?iU)(?:F\.?\s*)?(?:N\s?o\.?|Ref\.?\s*N\s?o\.?|Number)\s*[:.]?\s*((?=[A-Za-z0-9/_.\-()]*\d)[A-Za-z0-9][A-Za-z0-9/_.\-()]{2,40})"
OWN_DATE = r"(?iU)(?:dated|\bdt\.?|dinank|दिनांक)\s*[:.,]?\s*(" + DATE + ")"
RELATIONS = {
    "supersession": r"in\s+supersession\s+of",
    "partial_modification": r"in\s+partial\s+modification\s+of",
    "modification": r"in\s+modification\s+of",
    "amendment": r"\bamends?\b|\bamendment\s+to\b",
    "continuation": r"in\s+continuation\s+of",
}
REFERENCE = r"(Commercial\s+Circular|Circular|letter)\s*(?:No\.?|Number)?\s*([A-Za-z0-9./\-]+)(?:\s+of\s+(\d{4}))?(?:\s*,?\s*dated\s+(" + DATE + "))?"
CLAUSE = r"(?iU)\b(?:Clause|Para(?:graph)?|Item|Sub-?Clause)\s*[:.\-]?\s*(\d+(?:\.\d+)*|\([a-zA-Z0-9]+\))"
FULL = ("supersession",)
PARTIAL = ("partial_modification", "modification", "amendment")
INFORMATIONAL = ("continuation",)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def document_ref(text: Column) -> Column:
    """struct(number, date_raw, date_parsed) from the first HEAD_CHARS characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD_CHARS)
    found = F.struct(F.rtrim(_found(head, OWN_NUMBER, 1), F.lit(".,;:")).alias("number"), _found(head, OWN_DATE, 1).alias("date_raw"))
    return let(found, lambda x: F.struct(x["number"].alias("number"), x["date_raw"].alias("date_raw"), parse_date(x["date_raw"]).alias("date_parsed")))


def _of_relation(text: Column, k: int, relation: str, phrase: str) -> Column:
    phrase = f"(?:{phrase})"
    windows = F.regexp_extract_all(text, F.lit(rf"(?iU)(?=({phrase}[\s\S]{{0,{LOOKAHEAD_CHARS}}})){phrase}"), F.lit(1))

    def ref(whole: Column, i: Column) -> Column:
        after = F.regexp_replace(whole, rf"(?iU)^{phrase}", "")
        own = F.struct(after.alias("after"), F.nullif(F.regexp_extract(after, rf"(?iU)^([\s\S]*?{REFERENCE})", 1), F.lit("")).alias("cited"))
        return let(own, lambda x: _reference(whole, x["after"], x["cited"], i))

    def _reference(whole: Column, after: Column, cited: Column, i: Column) -> Column:
        said = F.substring(whole, F.lit(1), F.char_length(whole) - F.char_length(after) + F.char_length(cited))
        sentence = F.when(cited.isNotNull(), said).otherwise(F.substring_index(whole, ".", 1))
        part = lambda n: _found(cited, "(?iU)" + REFERENCE, n)
        return F.struct(
            F.lit(relation).alias("relation"), F.lit(k).alias("relation_ord"), i.alias("position"), part(1).alias("referenced_label"), part(2).alias("referenced_number"), part(3).alias("referenced_year"),
            part(4).alias("referenced_date_raw"), F.btrim(_found(whole, CLAUSE, 1), F.lit("()")).alias("referenced_clause"), F.regexp_replace(sentence, r"(?U)^\s+|\s+$", "").alias("matched_sentence"),
        )

    # most texts hold no phrase at all, which one plain search tells
    return F.transform(F.when(text.rlike(f"(?iU){phrase}"), windows).otherwise(F.array().cast("array<string>")), ref)


def references(text: Column) -> Column:
    """All references of a text, by relation and then by place: array of struct(relation, relation_ord, position, referenced_*, matched_sentence)."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_of_relation(text, k, *item) for k, item in enumerate(RELATIONS.items())])


def normal_number(number: Column) -> Column:
    """Letters and digits, lower-cased; null if none."""
    return F.nullif(F.lower(F.regexp_replace(number, "[^A-Za-z0-9]", "")), F.lit(""))


def normal_clause(clause: Column) -> Column:
    return F.nullif(F.lower(F.btrim(F.trim(clause), F.lit("()."))), F.lit(""))


def clause_matches(own: Column, referenced: Column) -> Column:
    """The same clause or one below it, on normal forms; false if either is null."""
    return F.coalesce((own == referenced) | F.startswith(own, F.concat(referenced, F.lit("."))), F.lit(False))


def summary(title: Column, number: Column, date: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" ", F.coalesce(full(title), F.lit("an indexed circular")), F.concat(F.lit("(No. "), full(number), F.lit(")")), F.concat(F.lit("dated "), full(date)))

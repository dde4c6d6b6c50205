"""Personal data and information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers,
found by pattern and checked (parts, Luhn, number of digits).  Their values are
the protected entities.  A term discloses an entity as far as knowing it makes
the entity likelier: with counts over the different lines of the corpus,

    PMI(t; e) = log(N n(t, e) / ((n(t) + 1) (n(e) + 1))),   IC(e) = log(N / n(e)),

and a term whose PMI reaches the share ``GENERALISE`` of the entity's
information content is generalised (replaced by its shape), one that reaches
``REMOVE`` is removed, on every line of each document that holds the entity.
Every pair that shares a line is scored.  Copies of one line count once, so that they prove
nothing, and the PMI is discounted as if each of the two stood on one more line
without the other: that weighs on rare pairs and vanishes for frequent ones.

Positions are code points, ends exclusive.  No pattern crosses a line break.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, fence, small

KINDS = ("email", "ip", "card", "phone")
#: The stated patterns in linear-time form: a match can only begin where a run of its characters begins or the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_GOOD = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}]+"
TERM = r"^\p{L}[\p{L}\p{N}]{2,}$"
GENERALISE = 0.5
REMOVE = 0.8
#: The corpus's different lines are found in so many parts, one after another, so that only one part's lines are on disk.
PARTS = 4
_SPAN = "array<struct<s:int,e:int,v:string>>"
_PLACES = "array<struct<s:int,e:int,level:int>>"


def located(text: Column, pattern: str) -> Column:
    """Non-overlapping matches from the left as array<struct<s, e, v>>, from the pieces between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.struct(F.char_length(p).alias("p"), F.char_length(m).alias("n"), m.alias("v")))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
    step = lambda acc, x: F.struct((acc["pos"] + x["p"] + x["n"]).alias("pos"), F.concat(acc["out"], F.array(F.struct((acc["pos"] + x["p"]).alias("s"), (acc["pos"] + x["p"] + x["n"]).alias("e"), x["v"].alias("v")))).cast(_SPAN).alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(steps, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> list[Column]:
    """Checked spans of each kind, in the order of KINDS."""
    none = F.array().cast(_SPAN)
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    n_digits = lambda v: F.length(digits(v))
    return [
        F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(located(text, IP), lambda x: x["v"].rlike(IP_GOOD))).otherwise(none),
        F.when(text.rlike("[0-9][ -]?[0-9]"), F.filter(located(text, CARD), lambda x: F.call_function("luhn_check", digits(x["v"])))).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE), lambda x: (n_digits(x["v"]) >= 8) & (n_digits(x["v"]) <= 15))).otherwise(none),
    ]


def entity_lines(marked: DataFrame) -> DataFrame:
    """rid, line_no, line, entities (array<string>), masked (spans) of each line with a base span. marked: rid, text, n_base."""
    each = marked.where("n_base > 0").select("rid", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike("[0-9@]"))
    found = each.select("rid", "line_no", "line", *[fence(c).alias(f"b_{k}") for k, c in zip(KINDS, base_spans(F.col("line")), strict=True)])
    value = lambda k: F.transform(f"b_{k}", lambda x: F.concat(F.lit(k + ":"), F.lower(x["v"]) if k in ("email", "ip") else F.regexp_replace(x["v"], "[^0-9]", "")))
    found = found.select("rid", "line_no", "line", F.concat(*[F.col(f"b_{k}") for k in KINDS]).alias("masked"), fence(F.array_distinct(F.concat(*[value(k) for k in KINDS]))).alias("entities"))
    return found.where(F.size("entities") > 0)


def line_terms(line: Column, masked: Column) -> Column:
    """Words outside the masked spans: array<struct<s, e, v>>, v in lower case."""
    words = F.filter(located(line, WORD), lambda x: x["v"].rlike(TERM) & ~F.exists(masked, lambda m: (m["s"] < x["e"]) & (x["s"] < m["e"])))
    return F.transform(words, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v")))


def disclosing_terms(docs: DataFrame, on_lines: DataFrame) -> DataFrame:
    """entity, term, level (1: generalise, 2: remove). docs: text; on_lines: line, entities, terms."""
    seen = on_lines.select(F.xxhash64("line").alias("h"), F.explode("entities").alias("entity"), F.array_distinct(F.transform("terms", lambda t: t["v"])).alias("ts"))
    together = durable(seen.select("h", "entity", F.explode("ts").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")))
    alone = seen.select("h", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    wanted = durable(together.select("term").distinct())
    n_wanted = wanted.count()
    if n_wanted == 0:
        return together.select("entity", "term", F.lit(1).alias("level")).limit(0)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("line"), F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    wanted = wanted.union(wanted.sparkSession.range(1).select(F.lit("").alias("term")))

    def counted(part: int) -> DataFrame:
        own = lines.where(F.pmod(F.xxhash64("line"), F.lit(PARTS)) == part).distinct()
        terms = own.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("term"))  # the empty word, once a line, counts the lines
        if n_wanted <= BROADCAST_ROWS:
            return terms.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
        return terms.groupBy("term").agg(F.count("*").alias("n_t")).join(wanted, "term", "left_semi")

    parts = functools.reduce(DataFrame.unionByName, [durable(counted(part)) for part in range(PARTS)])
    counts = durable(parts.groupBy("term").agg(F.sum("n_t").alias("n_t")))
    total = F.lit(float(counts.where("term = ''").first()["n_t"]))
    scored = together.join(alone, "entity").join(counts, "term")
    pmi = F.log(total * F.col("n_te") / ((F.col("n_t") + 1) * (F.col("n_e") + 1)))
    share = pmi / F.greatest(F.log(total / F.col("n_e")), F.lit(1e-9))
    return scored.select("entity", "term", F.when(share >= REMOVE, 2).when(share >= GENERALISE, 1).otherwise(0).alias("level")).where("level > 0")


def find(docs: DataFrame) -> DataFrame:
    """rid, doc_id, email, ip, card, phone (spans), terms (array<struct<s, e, level>>, sorted) of each document.

    Null text is empty.  Rows that repeat each other repeat their result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = own.select("rid", "doc_id", *[fence(c).alias(k) for k, c in zip(KINDS, base_spans(F.col("text")), strict=True)])
    spans = durable(spans)
    hit = spans.where(" + ".join(f"size({k})" for k in KINDS) + " > 0").select("rid")
    n_hit = hit.count()
    texts = own.join(F.broadcast(hit) if n_hit <= 200_000 else hit, "rid", "left_semi").select("rid", "text", F.lit(1).alias("n_base"))  # one long each
    on_lines = entity_lines(texts)
    on_lines = durable(on_lines.select("rid", "line_no", "line", "entities", fence(line_terms(F.col("line"), F.col("masked"))).alias("terms")))
    risky = durable(disclosing_terms(own.select("text"), on_lines))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    said = texts.select("rid", F.explode(fence(words)).alias("term")).join(small(risky), "term")  # by term: a risky one is rare, its entity may not be
    flagged = said.join(on_lines.select("rid", F.explode("entities").alias("entity")).distinct(), ["rid", "entity"]).groupBy("rid", "term").agg(F.max("level").alias("level"))
    flagged = flagged.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "level"))).alias("levels"))  # at most the words of a document
    places = texts.join(flagged, "rid").select("rid", fence(_placed(F.col("text"))).alias("terms")).dropDuplicates(["rid"])
    spans = spans.join(places, "rid", "left")
    masked = F.concat(*KINDS)
    clear = fence(F.filter("terms", lambda t: ~F.exists(masked, lambda m: (m["s"] < t["e"]) & (t["s"] < m["e"]))))
    return spans.withColumn("terms", F.coalesce(clear, F.array().cast(_PLACES)))


def _placed(text: Column) -> Column:
    """array<struct<s, e, level>> of the words in the column ``levels``, in order."""
    found, between = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, w: F.struct(F.char_length(p).alias("p"), F.char_length(w).alias("n"), F.element_at("levels", F.lower(w)).alias("level")))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_PLACES).alias("out"))
    place = lambda acc, x: F.struct((acc["pos"] + x["p"]).alias("s"), (acc["pos"] + x["p"] + x["n"]).alias("e"), x["level"].alias("level"))
    step = lambda acc, x: F.struct((acc["pos"] + x["p"] + x["n"]).alias("pos"), F.when(x["level"].isNotNull(), F.concat(acc["out"], F.array(place(acc, x))).cast(_PLACES)).otherwise(acc["out"]).alias("out"))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, sanitised text: base spans as [KIND], generalised terms as their shape class, removed terms as nothing.

    Of spans that overlap, the one that begins first counts, and the longer of two that begin together.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    base = [_cuts(k) for k in KINDS]
    term = F.transform("terms", lambda t: F.struct(t["s"].alias("s"), (-t["e"]).alias("minus_e"), F.when(t["level"] == 1, F.lit("[TERM]")).otherwise(F.lit("")).alias("by")))
    cuts = find(docs).dropDuplicates(["rid"]).select("rid", F.array_sort(F.concat(*base, term)).alias("cuts"))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    keep = lambda acc, c: F.when(c["s"] >= acc["pos"], F.struct((-c["minus_e"]).alias("pos"), F.concat(acc["out"], F.substring("text", acc["pos"] + 1, c["s"] - acc["pos"]), c["by"]).alias("out"))).otherwise(acc)
    done = F.aggregate("cuts", zero, keep, lambda acc: F.concat(acc["out"], F.substring("text", acc["pos"] + 1, F.char_length("text"))))
    return own.join(cuts, "rid").select("doc_id", done.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``find``."""
    name = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat(*[name(k) for k in KINDS])
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["s"].cast("string"), x["e"].cast("string")))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, terms), ",").alias("spans"))


def _cuts(kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"), F.lit(f"[{kind.upper()}]").alias("by")))

"""Line dedup by an exact set-similarity join.

Lines are sets of tokens.  Equal lines are one class from the start.  Each
class's tokens are put in one global order, rare tokens first: rarity is the
count of a token's hash bucket over all text (``RARITY_BITS`` bits of buckets,
a table of fixed size).  Two sets with a Jaccard index of 0.8 or more share a
token among the first floor(0.2 n) + 1 of each, so classes meet on those
(prefix filter), past the length filter, the positional filter and a filter on
the parities of token hashes.  A line is removed if an earlier line, by
(doc_id, line number), equals it or is similar to it.

Classes meet in two levels.  First each one meets the representatives of its
prefix tokens, the earliest class and the one with the most copies: that is
linear, and settles most of a group of near copies.  Then those not settled
meet all earlier classes.  Both levels verify Jaccard on
the 64-bit hashes of all the lines' tokens.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fence

RARITY_BITS = 16
BUCKETS = 1 << RARITY_BITS
#: Rows of one long that may be broadcast to filter texts; beyond, the join shuffles.
FILTER_ROWS = 200_000
#: Parts of the token space whose classes are joined one after another, and the share of it (one part of so many) in which they meet representatives.
SLICES = 4
FIRST_SLICE = 4
#: A token has representatives if it is in the prefix of more classes than this.
CROWD = 8
#: Lines of more tokens have parities of 128 bits, others of 64.
WIDE = 40
#: No token: 32 bits, tokens have 31.
NONE = 0xFFFFFFFF
SPACES = "\t\r\f\u000b"


def plain(text: Column, more: str = "") -> Column:
    """Other white space within lines, and the characters of ``more``, as spaces."""
    return F.regexp_replace(text, f"[{SPACES}{more}]", " ")


def hashed(tokens: Column) -> Column:
    """64-bit hashes of the tokens that aren't empty."""
    return F.array_remove(F.transform(tokens, lambda t: F.xxhash64(t)), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame) -> Column:
    """Rarity of each hash bucket (third parts of the binary logarithm of its count of tokens in all documents) as an array literal of BUCKETS bytes."""
    tokens = docs.select(F.explode(F.split(plain(F.col("text"), "\n"), " ")).alias("t"))
    counts = tokens.select(F.xxhash64("t").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    packed = counts.select((F.col("b") * 128 + F.least(F.lit(127), F.ceil(3 * F.log2("n"))).cast("int")).alias("x")).groupBy(F.pmod(F.shiftright("x", 7), F.lit(64)).alias("part")).agg(F.collect_list("x").alias("all"))
    table = [0] * BUCKETS
    for row in packed.select("all").collect():  # BUCKETS numbers at most; as rows of their own they took the driver's Python 350 bytes each
        for x in row["all"]:
            table[x >> 7] = x & 127
    return F.from_json(F.lit(json.dumps(table)), "array<tinyint>")


def ordered(tokens: Column, table: Column) -> Column:
    """Distinct 63-bit keys of the tokens that aren't empty, rare first: the bucket's rarity, then the rest of the hash."""
    rare = lambda h: F.coalesce(F.get(table, h.bitwiseAND(BUCKETS - 1).cast("int")), F.lit(0).cast("tinyint"))  # noqa: E731  never null: keys are then sorted as longs
    key = lambda h: F.shiftleft(rare(h).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(F.array_distinct(hashed(tokens)), key))


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, line_no, line of every line that holds a token."""
    each = docs.select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where(F.ltrim("line", F.lit(" " + SPACES)) != "")


def parity(keys: Column) -> tuple[Column, Column]:
    """Two words whose bits are parities of the tokens that fall on them: two sets differ by at least as many tokens as bits.

    The first word is over the lowest six bits of each key; for sets of more
    than WIDE tokens the second has the part with the seventh bit set.
    """
    shift = lambda value, x: F.call_function("shiftleft", value, x.bitwiseAND(63).cast("int"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = F.aggregate(keys, zero, lambda bits, x: bits.bitwiseXOR(shift(one, x)))
    half = F.aggregate(keys, zero, lambda bits, x: bits.bitwiseXOR(shift(F.shiftright(x, 6).bitwiseAND(1), x)))
    return whole, F.when(F.size(keys) > WIDE, half).otherwise(zero)


def _heads(classes: DataFrame, slices: int, part: int, *more: str) -> DataFrame:
    """A row for each prefix token of each class, of one of ``slices`` slices of the tokens.

    place orders classes but for those of one doc_id; n is negative for classes that look for no partner.
    """
    place = F.coalesce(F.col("at.doc_id"), F.lit(-(1 << 63)).cast("long")).alias("place")
    rows = classes.select("id", place, "copies", F.when(F.col("open"), F.col("n")).otherwise(-F.col("n")).alias("n"), "bits", "more", *more, F.posexplode("prefix").alias("i", "token"))
    return rows.where(F.pmod("token", F.lit(slices)) == part)


def _alike(a: str, b: str) -> tuple[Column, Column]:
    """Whether two rows pass the filter on parity, and the bits in which they differ."""
    c = lambda side, name: F.col(f"{side}.{name}")
    na, nb = F.abs(c(a, "n")), F.abs(c(b, "n"))
    whole, half = c(a, "bits").bitwiseXOR(c(b, "bits")), c(a, "more").bitwiseXOR(c(b, "more"))
    apart = F.when((na > WIDE) & (nb > WIDE), F.bit_count(half) + F.bit_count(whole.bitwiseXOR(half))).otherwise(F.bit_count(whole))
    return 9 * apart <= na + nb, apart


def _near(a: str, b: str) -> tuple[Column, Column]:
    """Whether two rows pass the filters on length, parity and order (a before b), and the bits in which they differ.

    Each condition is on both sides, none on one alone: so both are the same exchange, written once.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    na, nb = F.abs(c(a, "n")), c(b, "n")
    alike, apart = _alike(a, b)
    length = 5 * F.least(na, nb) >= 4 * F.greatest(na, nb)
    return (c(a, "place") <= c(b, "place")) & (c(a, "id") != c(b, "id")) & length & alike, apart


def _by_representatives(heads: DataFrame) -> DataFrame:
    """b, a: for each class its most similar one among the representatives of its crowded tokens."""
    fields = ("id", "place", "n", "bits", "more")
    chosen = [F.min_by(f, "place").alias(f"first_{f}") for f in fields] + [F.max_by(f, "copies").alias(f"most_{f}") for f in fields]
    found = heads.groupBy("token").agg(F.count("*").alias("m"), *chosen).where(F.col("m") > CROWD)
    both = F.array(*[F.struct(*[F.col(f"{kind}_{f}").alias(f) for f in fields]) for kind in ("first", "most")])
    reps = found.select("token", F.explode(both).alias("r")).select("token", "r.*")
    near, apart = _near("a", "b")
    pairs = reps.alias("a").join(heads.alias("b"), (F.col("a.token") == F.col("b.token")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), apart.alias("apart"))
    return pairs.groupBy("b").agg(F.min_by("a", "apart").alias("a"))


def _band(n: Column) -> Column:
    """Half octaves of set sizes: sets with a Jaccard index of 0.8 or more are in one of them or in two that follow."""
    return F.floor(2 * F.log2(n)).cast("int")


def _keyed(classes: DataFrame, bands: Column, slices: int, part: int) -> DataFrame:
    """Heads of the first ``most`` prefix tokens for each (band, most) of the bands, whose tokens are joined with the band; last: the two tokens before each."""
    each = classes.withColumn("in", F.explode(bands)).withColumns({"band": F.col("in.band"), "prefix": F.slice("prefix", 1, F.col("in.most"))})
    before = lambda k: F.coalesce(F.get("prefix", F.col("i") - k), F.lit(-1)).cast("long")  # noqa: E731  tokens are never negative
    last = F.shiftleft(before(1), 32).bitwiseOR(before(2).bitwiseAND(NONE))
    return _heads(each, slices, part, "band", "prefix").withColumns({"last": last, "token": F.hash("token", "band")}).drop("copies", "band", "prefix")


def _met_before() -> Column:
    """Whether a and b share one of the two tokens before theirs, so that they meet on that one too."""
    two = lambda side: (F.shiftrightunsigned(f"{side}.last", 32), F.col(f"{side}.last").bitwiseAND(NONE))
    (a1, a2), (b1, b2) = two("a"), two("b")
    return ((a1 != NONE) & ((a1 == b1) | (a1 == b2))) | ((a2 != NONE) & ((a2 == b1) | (a2 == b2)))


def _candidates(classes: DataFrame, slices: int, part: int) -> DataFrame:
    """a, b of open classes b and those that share a prefix token with them, past the filters, for one slice of the tokens.

    Of two sets the smaller has its first shared token among its first
    floor(n / 9) + 1, so only those are looked up, in the bands of sizes that
    a larger partner can have: pairs of a common token with unlike sizes never
    meet.  In the next band all partners have ``least`` tokens or more, and
    so many must be shared that fewer are looked up.  The positional filter is
    that of the first token they share: none before it is common, so all that
    are lie from there on.  It holds at every shared token before one at which
    it holds, so near copies, which share most tokens, need not be paired again
    where they share one of the two before.
    """
    own = _band(F.col("n"))
    most = lambda band, limit: F.struct(band.alias("band"), F.expr(limit).cast("int").alias("most"))
    least = "cast(ceil(pow(2D, (floor(2 * log2(n)) + 1) / 2D) - 1e-6) as int)"
    home, away = most(own, "n div 9 + 1"), most(own + 1, f"n + 1 - (4 * (n + {least}) + 8) div 9")
    small = _keyed(classes, F.when(_band(F.expr("5 * n div 4")) > own, F.array(home, away)).otherwise(F.array(home)), slices, part).alias("a")
    large = _keyed(classes, F.array(most(own, "n div 5 + 1")), slices, part).alias("b")
    na, nb = F.abs("a.n"), F.abs("b.n")
    position = 9 * F.least(na - F.col("a.i"), nb - F.col("b.i")) >= 4 * (na + nb)
    forth = (F.col("a.place") <= F.col("b.place")) & (F.col("b.n") > 0)
    back = (F.col("b.place") <= F.col("a.place")) & (F.col("a.n") > 0)
    once = (na < nb) | ((na == nb) & (F.col("a.id") < F.col("b.id")))
    met = small.join(large, (F.col("a.token") == F.col("b.token")) & position & once & _alike("a", "b")[0] & (forth | back) & ~_met_before())
    pair = lambda a, b: F.struct(F.col(f"{a}.id").alias("a"), F.col(f"{b}.id").alias("b"))
    return met.select(F.explode(F.array(F.when(forth, pair("a", "b")), F.when(back, pair("b", "a")))).alias("p")).where("p is not null").select("p.a", "p.b").distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of each b of the pairs whose a is before it and similar, judged by the 64-bit hashes of all tokens of their lines."""
    ids = classes.select("id", "at").join(_few(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id")
    per_text = durable(ids.groupBy("at.rid").agg(F.collect_list(F.struct("at", "id")).alias("wanted")))  # at most the lines of one text
    texts = docs.select("rid", "text")
    if per_text.count() <= FILTER_ROWS:
        texts = texts.join(F.broadcast(per_text.select("rid")), "rid", "left_semi")
    texts = texts.dropDuplicates(["rid"]).join(per_text, "rid")
    found = texts.select(fence(F.split("text", "\n")).alias("all"), "wanted").select("all", F.explode("wanted").alias("w"))
    tokens = F.array_distinct(hashed(F.split(plain(F.get("all", F.col("w.at.line_no"))), " ")))
    lines = durable(found.select("w.id", "w.at", tokens.alias("k")))  # once for each line, not for each of its pairs
    side = lambda x: lines.select(F.col("id").alias(x), F.col("at").alias(f"at_{x}"), F.col("k").alias(f"k{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("at_a < at_b")
    return durable(both.where(9 * F.size(F.array_intersect("ka", "kb")) >= 4 * (F.size("ka") + F.size("kb"))).select(F.col("b").alias("id")).distinct())


def removed_lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, line_no of each line to remove. docs: rid (long, equal only for equal rows), doc_id, text."""
    table = rarity(docs)
    lines = _lines(docs)
    at = F.struct("doc_id", "line_no", "rid")
    keyed = lines.select(at.alias("at"), F.xxhash64("line").alias("id"), fence(ordered(F.split(plain(F.col("line")), " "), table)).alias("k"))
    prefix = F.transform(F.slice("k", 1, F.expr("size(k) div 5 + 1")), lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    bits, more = parity(F.col("k"))
    rows = keyed.select("id", F.struct("at", F.size("k").alias("n"), bits.alias("bits"), more.alias("more"), prefix.alias("prefix")).alias("x"))
    classes = durable(rows.groupBy("id").agg(F.min("x").alias("x"), F.count("*").alias("copies")).select("id", "copies", "x.*"))

    reps = durable(_by_representatives(_heads(classes.withColumn("open", F.lit(True)), FIRST_SLICE, 0)))
    settled = _verified(docs, classes, reps)
    classes = _marked(classes, settled, "settled")
    if settled.count() > FILTER_ROWS:
        classes = durable(classes)  # joined once, not for each slice
    open_classes = classes.withColumn("open", ~F.col("settled"))
    # one slice of the tokens at a time, so that only its rows are on disk
    pairs = functools.reduce(DataFrame.unionByName, [durable(_candidates(open_classes, SLICES, k)) for k in range(SLICES)]).distinct()
    classes = _marked(classes, _verified(docs, classes, durable(pairs)), "similar").withColumn("gone", F.col("settled") | F.col("similar"))

    places = classes.where("gone").select("at.rid", "at.doc_id", "at.line_no")
    several = durable(classes.where("copies > 1").select("id", "at", "gone"))  # only these stand in other places too
    copies = lines.select(at.alias("place"), F.xxhash64("line").alias("id"))
    if several.count() <= FILTER_ROWS:
        copies = copies.join(F.broadcast(several.select("id")), "id", "left_semi")
    copies = copies.join(several, "id").where(F.col("place") != F.col("at")).select("place.rid", "place.doc_id", "place.line_no")
    return places.unionByName(copies)


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= FILTER_ROWS else ids


def _marked(classes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """classes with a column that says whether their id is among ids."""
    return classes.join(_few(ids.withColumn(name, F.lit(True))), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _own(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"rid": F.xxhash64("doc_id", "text"), "doc_id": F.col("doc_id").cast("long")})


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-joined) of each document.

    Lines without tokens are never removed; null text is one such line.  Rows
    equal in doc_id and text are one document; rows that share a doc_id only
    are ordered by a hash.  Tokens are case-sensitive runs without white space.
    """
    own = _own(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    gone = removed_lines(own).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))  # at most the lines of one text
    sizes = own.select("rid", "doc_id", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).dropDuplicates(["rid"])
    joined = sizes.join(gone, "rid", "left").withColumn("gone", F.sort_array(F.coalesce("gone", F.array().cast("array<int>"))))
    return joined.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with repeated lines taken out of text and n_chars counted anew; documents left with no token go, all other columns stay, whatever their names."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.struct("*").alias("row"), "text", F.xxhash64(F.col("doc_id"), text).alias("rid"))
    gone = removed_lines(docs.select(F.xxhash64(F.col("doc_id"), text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))
    joined = own.join(gone, "rid", "left").withColumn("all", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("all"), i)), "\n"))
    out = joined.withColumn("text", fence(left)).where(F.col("gone").isNull() | F.col("text").rlike(r"\S"))
    anew = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return out.select(*[anew.get(f.name, F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM t),
k AS (SELECT *, list_distinct(list_filter(string_split_regex(line, '[ \t\r\f\v]'), lambda x: x <> '')) AS toks FROM l),
c AS (SELECT line, min(doc_id * 1000000 + line_no) AS pos, any_value(toks) AS toks FROM k WHERE len(toks) > 0 GROUP BY line),
u AS (SELECT pos, len(toks) AS n, unnest(toks) AS t FROM c),
o AS (SELECT a.pos AS pa, b.pos AS pb, a.n + b.n AS nn, count(*) AS ov FROM u a JOIN u b ON a.t = b.t AND a.pos < b.pos AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
d AS (SELECT DISTINCT pb AS pos FROM o WHERE 9 * ov >= 4 * nn),
v AS (SELECT k.doc_id, k.line_no, len(k.toks) > 0 AND (c.pos <> k.doc_id * 1000000 + k.line_no OR d.pos IS NOT NULL) AS gone
      FROM k LEFT JOIN c ON k.line = c.line AND len(k.toks) > 0 LEFT JOIN d ON c.pos = d.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (gone), '') AS removed FROM v GROUP BY doc_id
"""

"""Conversation structure repair by a DP that shares prefixes in a trie.

A conversation is seen as its signature, one character for each row: its role
(s, u, a by initial, x for any other) and whether it may stay.  The cheapest
edits that give roles ``(s?(ua)+)?`` depend on the signature alone, so the
distinct signatures are sorted over ranges and each task walks the prefix trie
that its sorted signatures form: the path to the present node is a stack of DP
layers, a layer is computed when its node is entered and serves every signature
below, and the answer is read off where a signature ends.

Rows never meet as a group in memory: both passes over a conversation stream
its sorted rows, and hold its signature or its edits, a byte for each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: Where an inserted or renamed row leads from each state, and the role it gets.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a row that keeps its role leads.
STAYS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: Characters of a signature: a row that must go, and the role of one that may stay, in capitals if it is truncated.
GONE = "d"
LEGAL = {"su", "ua", "au"}

Layer = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> Layer:
    for a, b in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT), (ASSISTANT, USER)):
        costs[b] = min(costs[b], costs[a] + INSERT)
    return tuple(costs)


def _moves(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state: initial, cost, new state; in ASCII order."""
    yield "D", DELETE, state
    if symbol != GONE:
        extra, stays = TRUNCATED * symbol.isupper(), STAYS[symbol.lower()].get(state)
        if stays is not None:
            yield "K", KEEP + extra, stays
        if stays != NEXT[state]:
            yield "R", REROLE + extra, NEXT[state]


FIRST: Layer = _inserted([0, FAR, FAR, FAR])


def next_layer(layer: Layer, symbol: str) -> Layer:
    """Least costs of each state after one more row and what is inserted behind it."""
    costs = [FAR] * 4
    for state, cost in enumerate(layer):
        if cost < FAR:
            for _, more, to in _moves(symbol, state):
                costs[to] = min(costs[to], cost + more)
    return _inserted(costs)


def answer(signature: str, layers: list[Layer]) -> tuple[int, str]:
    """Least cost, and the ASCII-least edits of that cost.

    An edit is on a cheapest way if costs add up along it and its end is on one;
    edits from one state begin with different letters, so the least letter that
    stays on a cheapest way is right at each step.
    """
    n = len(signature)
    best = min(layers[n][START], layers[n][ASSISTANT])
    good: list[set[int]] = [set()] * (n + 1)
    reach = {q for q in (START, ASSISTANT) if layers[n][q] == best}
    for i in range(n, -1, -1):
        layer = layers[i]
        if i < n:
            reach = {q for q in range(4) if layer[q] < FAR for _, cost, to in _moves(signature[i], q) if to in good[i + 1] and layer[q] + cost == layers[i + 1][to]}
        for _ in range(3):
            reach |= {q for q, to in NEXT.items() if to in reach and layer[q] + INSERT == layer[to]}
        good[i] = reach
    out, i, state = [], 0, START
    while not (i == n and state in (START, ASSISTANT) and layers[n][state] == best):
        options = [(c, i + 1, to) for c, cost, to in _moves(signature[i], state) if to in good[i + 1] and layers[i][state] + cost == layers[i + 1][to]] if i < n else []
        if NEXT[state] in good[i] and layers[i][state] + INSERT == layers[i][NEXT[state]]:
            options.append(("I", i, NEXT[state]))
        letter, i, state = min(options)
        out.append(letter)
    return best, "".join(out)


def walk(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """signature, cost, audit of sorted signatures; layers of a prefix that they share are computed once."""
    layers, last = [FIRST], ""
    for own in signatures:
        shared = next((i for i, (a, b) in enumerate(zip(own, last, strict=False)) if a != b), min(len(own), len(last)))
        del layers[shared + 1 :]
        for symbol in own[shared:]:
            layers.append(next_layer(layers[-1], symbol))
        yield own, *answer(own, layers)
        last = own


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy after the planned faults; a null role or text is one space.

    By the checksum of ``conv_id:turn`` (a null as one space) modulo 20: 0 drops
    a row, 1 empties its text, 2 takes out its full stops, exclamation and
    question marks, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), fault.alias("fault"),
    )
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("fault != 0").withColumn("copy", copies).drop("fault")


def _ordered(rows: DataFrame) -> DataFrame:
    """rows with sha, a key of role and text; by it, after turn and role, rows of one turn are ordered."""
    return rows.withColumn("sha", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


_ORDER = ["conv_id", "turn", "role", "sha", "copy"]


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of sorted rows."""
    names = ("conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal")
    out: dict[str, list] = {c: [] for c in names}
    kind = None

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(out["conv_id"], kind), pa.array(out["signature"], pa.string()), *(pa.array(out[c], pa.int64()) for c in names[2:])], names=list(names))
        for c in names:
            out[c].clear()
        return batch

    own: list[str] = []
    lowest = highest = last_turn = None
    distinct = faults_b = faults_d = faults_t = illegal = 0
    current: object = own  # no conversation's id is this list
    initial = ""
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, turn, role, blank, cut, seen in _groups(iter([batch]), ["conv_id", "turn", "initial", "blank", "cut", "seen"]):
            if conv != current or current is own:
                if current is not own:
                    for c, v in zip(names, (current, "".join(own), 0 if lowest is None else highest - lowest + 1 - distinct, faults_b, faults_d, faults_t, illegal), strict=True):
                        out[c].append(v)
                current, own, initial = conv, [], ""
                lowest = highest = last_turn = None
                distinct = faults_b = faults_d = faults_t = illegal = 0
            if turn is not None:
                distinct += turn != last_turn
                lowest, highest, last_turn = turn if lowest is None else lowest, turn, turn
            illegal += bool(own) and initial + role not in LEGAL
            initial = role
            repeated = seen > 1 and not blank
            faults_b += blank
            faults_d += repeated
            faults_t += cut and not blank and not repeated
            own.append(GONE if blank or repeated else role.upper() if cut else role)
        if len(out["conv_id"]) >= 5000:
            yield flush()
    if current is not own:
        for c, v in zip(names, (current, "".join(own), 0 if lowest is None else highest - lowest + 1 - distinct, faults_b, faults_d, faults_t, illegal), strict=True):
            out[c].append(v)
    if out["conv_id"]:
        yield flush()


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of rows (conv_id, turn, role, text, copy).

    Rows stand by turn, nulls first, rows of one turn by role and then in a
    fixed order in which equal rows lie together.  A blank row is not counted as
    a duplicate too, nor a duplicate as truncated.
    """
    initial = F.substring("role", 1, 1)
    narrow = _ordered(rows).select(
        "conv_id", "turn", "role", "sha", "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
    )
    first = Window.partitionBy("conv_id", "sha").orderBy(F.asc_nulls_first("turn"), "copy")
    seen = narrow.repartition("conv_id").withColumn("seen", F.row_number().over(first))
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long"
    return seen.sortWithinPartitions(*_ORDER).select("conv_id", "turn", "initial", "blank", "cut", "seen").mapInArrow(_described, schema)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = walk(s for (s,) in _groups(batches, ["signature"]))
    more = True
    while more:
        rows = [x for _, x in zip(range(5000), found, strict=False)]
        more = len(rows) == 5000
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], names=["signature", "cost", "audit"])


def cheapest(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""
    return signatures.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(_answers, "signature string, cost long, audit string")


def plan(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: the faults of each conversation of rows (conv_id, turn, role, text, copy), and its cheapest edits."""
    found = durable(signatures(rows))
    return found.join(cheapest(found), "signature").drop("signature")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """conv_id, letter, role, text of every edit of sorted rows, each conversation's audit before its rows; a row with no letter ends a conversation."""
    audit, at, state, current = "", 0, START, None

    def insertions() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, NEXT[state]
            yield current, "I", ROLE[state], ""

    begun = False
    for conv, plan_, role, text in _groups(batches, ["conv_id", "audit", "role", "text"]):
        if plan_ is not None:
            if begun:
                yield from insertions()
                yield current, None, None, None
            audit, at, state, current, begun = plan_, 0, START, conv, True
            continue
        yield from insertions()
        letter, at = audit[at], at + 1
        if letter == "K":
            state = STAYS[role[:1]][state]
        elif letter == "R":
            state = NEXT[state]
            role = ROLE[state]
        yield conv, letter, role, text
    if begun:
        yield from insertions()
        yield current, None, None, None


def _lined_up(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in one task: a stream, not a group."""
    head = plans.select("conv_id", "audit", F.lit(0).alias("kind"))
    body = _ordered(rows).select("conv_id", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"), "turn", "role", "sha", "copy", "text")
    return head.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:]).select("conv_id", "audit", "role", "text")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit, role, text: the messages of each conversation after its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = 0
        pack = lambda: pa.record_batch([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.int64()), *(pa.array([r[k] for r in out], pa.string()) for k in (2, 3, 4))], names=["conv_id", "position", "edit", "role", "text"])
        for conv, letter, role, text in _replay(batches):
            if letter is None:
                at = 0
            elif letter != "D":
                out.append((conv, at, letter, role, text))
                at += 1
            if len(out) >= 1000:
                yield pack()
                out.clear()
        if out:
            yield pack()

    of = rows.schema["conv_id"].dataType
    kind = _arrow(of)
    return _lined_up(rows, plans).mapInArrow(run, f"conv_id {of.simpleString()}, position long, edit string, role string, text string")


def repaired_hashes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 over ``role:text`` of each conversation's messages after its edits, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        state, glue = hashlib.sha256(), b""
        for conv, letter, role, text in _replay(batches):
            if letter is None:
                ids.append(conv)
                found.append(state.hexdigest())
                state, glue = hashlib.sha256(), b""
                if len(ids) >= 5000:
                    yield pa.record_batch([pa.array(ids, kind), pa.array(found)], names=["conv_id", "repaired_sha256"])
                    ids, found = [], []
            elif letter != "D":
                state.update(glue + f"{role}:{text}".encode())
                glue = b"\n"
        if ids:
            yield pa.record_batch([pa.array(ids, kind), pa.array(found)], names=["conv_id", "repaired_sha256"])

    of = rows.schema["conv_id"].dataType
    kind = _arrow(of)
    return _lined_up(rows, plans).mapInArrow(run, f"conv_id {of.simpleString()}, repaired_sha256 string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id, after the planned faults.

    gaps are turns missing between the lowest and the highest.  A conversation
    with no rows left has zeros, an empty audit and the hash of nothing; rows
    whose conv_id is null are one conversation.
    """
    rows = damaged(conversations)
    plans = durable(plan(rows))
    hashes = repaired_hashes(rows, plans)
    everyone = conversations.select(F.col("conv_id").alias("id")).distinct()
    out = everyone.join(plans, F.col("id").eqNullSafe(plans["conv_id"]), "left").drop("conv_id")
    out = out.join(hashes, F.col("id").eqNullSafe(hashes["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

"""Byte-level BPE, conversation repair and the dataset manifest, each against a plain version."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausebase.llm import bpe, conversations, manifest, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CONV = "conv_id long, turn long, role string, text string"
SHA = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

TEXTS = [
    None, "", " ", "Plain words, and some more.", "it's we'll   don't\n\n\n  x", "数据处理，是的。中文文本没有空格" * 9, "a" * 900, " " * 700 + "end", "\n" * 333, "''s'''re 'x" * 40,
    "😀👩‍👩‍👧 é é   wide　space " * 20, "<|endoftext|> is text here", "1234567890" * 60, "tab\tand\x1c\x1dfile marks \x85 next " * 15, "नमस्ते दुनिया, यह एक परीक्षण है। " * 12,
]


def reference_ids(text):
    coder, _ = tokens.encoder(tokens.default_vocabulary())
    return coder.encode_ordinary(text or "")


def digest_row(text):
    ids = reference_ids(text)
    return len(ids), SHA(np.asarray(ids, "<u4").tobytes()), SHA(text or "")


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 512), (64, 24), (17, 8)])
def test_round_trip_and_pieces(spark, chunk, overlap):
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["ab", "'s ", " ", "\n", "é", "漢", "7", "!?", "'re", "  ", " "]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    texts = TEXTS + mixed
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (len(texts), texts[7]), (None, texts[8])], "doc_id long, text string").withColumns({"sha": F.lit(1), "k": F.lit("x"), "piece": F.lit(0)})
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, chunk=chunk, overlap=overlap).collect())
    want = sorted([(False, i, *digest_row(t)) for i, t in enumerate(texts)] + [(False, 3, *digest_row(texts[3])), (False, len(texts), *digest_row(texts[7])), (True, None, *digest_row(texts[8]))])
    assert got == want
    once = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = bpe.encode(once, chunk=chunk, overlap=overlap).orderBy("doc_id", "piece").collect()
    data = {r.doc_id: [] for r in pieces}
    for r in bpe.decode(bpe.encode(once, chunk=chunk, overlap=overlap)).orderBy("doc_id", "piece").collect():
        data[r.doc_id].append(bytes(r.bytes))
    for i, t in enumerate(texts):
        assert b"".join(bytes(r.ids) for r in pieces if r.doc_id == i) == np.asarray(reference_ids(t), "<u4").tobytes()
        assert b"".join(data[i]).decode() == (t or "")
    if chunk == 64:
        assert len([r for r in pieces if r.doc_id == 5]) > 1 and len([r for r in pieces if r.doc_id == 6]) == 1  # a run of letters has no seam


def test_round_trip_of_no_rows(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab's 'r\te\n 7,!漢́\U00010d50"), min_size=1, max_size=60))
def test_text_may_be_cut_at_seams(text):
    for p in bpe.seams(text, 1, len(text)):
        assert reference_ids(text) == reference_ids(text[:p]) + reference_ids(text[p:])


# --- conversations


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if c == 1:
            text = ""
        if c == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if c == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def legal(roles):
    body = roles[1:] if roles[:1] == "s" else roles
    return not roles or bool(body) and len(body) % 2 == 0 and body == "ua" * (len(body) // 2)


def cheapest_edits(rows, found):
    """Uniform-cost search over all edit sequences; ties by the string."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and legal(roles):
            return cost, audit, out
        key = (i, roles[-1:], bool(roles))
        if key in done:
            continue
        done.add(key)
        fits = lambda r: legal(roles + r) or legal(roles + r + "a") or legal(roles + r + "ua")
        for r, name in (("u", "user"), ("a", "assistant")):
            if fits(r):
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + r, (*out, f"{name}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, out))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                if role[:1] in ("s", "u", "a") and fits(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[:1], (*out, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if fits(r):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, roles + r, (*out, f"{name}:{text}")))


def expected_report(rows):
    after = damage(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest_edits(own, found)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), bad, cost, audit, SHA("\n".join(lines)))
    return out


def conversation_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(14), rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello there.", "Yes!", "no end", " \n", "", None, "Wie geht es?  ", "été."])
            rows.append((conv, rng.choice([turn, turn, turn, None]), role, text))
    return rows


def report_of(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_repair_report(spark):
    rows = conversation_rows(4, 150) + [(None, 0, "user", "No id."), (None, 1, "assistant", "None at all.")] + [(700, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(600)]
    rows += [(901, 3, "user", "Same."), (901, 3, "user", "Same.")]
    conv = next(c for c in range(5000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((conv, 0, "user", "Dropped."))  # a conversation with nothing left
    df = spark.createDataFrame(rows, CONV).repartition(5).withColumns({"signature": F.lit(1), "audit": F.lit("x"), "copy": F.lit(9)})
    want = expected_report(rows)
    assert want[conv][-2:] == ("", SHA(""))
    assert report_of(conversations.repair_report(df)) == want
    assert conversations.repair_report(df.limit(0)).count() == 0


def test_repaired_messages_are_legal(spark):
    rows = conversations.damaged(spark.createDataFrame(conversation_rows(9, 60), CONV))
    plans = conversations.plan(rows)
    by: dict = {}
    for r in conversations.repaired(rows, plans).orderBy("conv_id", "position").collect():
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        assert legal("".join(r.role[:1] for r in own)) and [r.position for r in own] == list(range(len(own)))
        assert all((r.edit == "I") == (r.text == "") for r in own)


def test_layers_of_shared_prefixes_are_computed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(conversations, "next_layer", lambda layer, s, f=conversations.next_layer: calls.append(s) or f(layer, s))
    signs = sorted({"".join(x) for n in range(6) for x in itertools.product("uad", repeat=n)})
    got = {s: (c, a) for s, c, a in conversations.walk(signs)}
    assert len(got) == len(signs) and len(calls) == len(signs) - 1  # a layer for each node of the trie but its root
    for s in signs:
        rows = [(0, k, {"u": "user", "a": "assistant", "d": "user"}[c], f"{k}.") for k, c in enumerate(s)]
        assert got[s] == cheapest_edits(rows, ["blank" if c == "d" else "" for c in s])[:2]


# --- manifest


def pairs(nodes):
    return [SHA("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def expected_manifest(rows):
    """By (doc_id, leaf): every digest of the contract."""

    def leaf(doc_id, text, lang, source, n_chars):
        return SHA("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def climb(nodes, at):
        path = []
        while len(nodes) > 1:
            other = at ^ 1
            path.append((nodes[other] if other < len(nodes) else "", other < at))
            nodes, at = pairs(nodes), at // 2
        return path, nodes[0]

    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[t]], 0)[1] for t in names]
    out = []
    for k, t in enumerate(names):
        leaves = [x[2] for x in trees[t]]
        for at, (_, _, own, row) in enumerate(trees[t]):
            low, subroot = climb(leaves, at)
            high, root = climb(subroots, k)
            hit = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf(*row[:4], row[4] + 1) if hit else own
            for other, left in low + high:
                folded = SHA(other + folded if left else folded + other)
            out.append((row[0], own, subroot, root, SHA("".join(s for s, _ in low + high)), folded, folded == root))
    return sorted(out, key=str)


MANIFEST_ROWS = [(i, f"text {i} é", random.Random(i).choice(["en", "de", None, "ß", "z"]), "web" if i % 3 else None, None if i % 5 == 0 else i) for i in range(137)]


@pytest.mark.parametrize(("bits", "most"), [(12, 4096), (3, 4096), (2, 12), (1, 6)])
def test_manifest(spark, bits, most):
    rows = MANIFEST_ROWS + [(None, "no id", "en", "s", 1), (None, None, None, None, None), (5, "again", "de", "s", 3), MANIFEST_ROWS[7], MANIFEST_ROWS[7], (999, "only one", "lone", "s", 8)]
    df = spark.createDataFrame(rows, DOC).repartition(6).withColumns({"pos": F.lit("x"), "block": F.lit(3), "tree": F.lit("t"), "leaf": F.lit(1)})
    got = sorted((tuple(r) for r in manifest.verified(df, bits, most).collect()), key=str)
    assert got == expected_manifest(rows)


def test_manifest_of_few_rows(spark):
    for rows in ([], [(7, "alone", "en", "s", 5)]):
        assert sorted((tuple(r) for r in manifest.verified(spark.createDataFrame(rows, DOC)).collect()), key=str) == (expected_manifest(rows) if rows else [])


def test_manifest_has_a_bound_on_trees(spark):
    df = spark.createDataFrame([(i, "x", f"l{i}", "s", 1) for i in range(9)], DOC)
    with pytest.raises(ValueError, match="at most 4 trees"):
        manifest.verified(df, 2, 4)

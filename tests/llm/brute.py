"""Plain versions of the operators, for small fixtures."""

import collections
import re

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(_LOW))


def shingles(words, width=5):
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def jaccard_classes(docs):
    """{doc_id: (class_id, n_links)} for unique ids."""
    sets = {i: shingles(near_words(t)) for i, t in docs}
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 9 * shared >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), links[i]) for i in ids}


def removed_lines(docs):
    """{doc_id: [line numbers]} of lines that equal or resemble an earlier one."""
    lines = [(i, k, frozenset(x for x in re.split("[ \t\r\f\v]", line) if x)) for i, t in sorted(docs) for k, line in enumerate((t or "").split("\n"))]
    gone, seen = collections.defaultdict(list), []
    for i, k, own in lines:
        if own:
            if any(9 * len(own & other) >= 4 * (len(own) + len(other)) for other in seen):
                gone[i].append(k)
            seen.append(own)
    return gone


def contained(docs, items):
    """{(doc_id, item_id)} of contained items."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    five = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out = set()
    for i, t in docs:
        own = five(words(t))
        for j, x in items:
            s = five(words(x))
            if s and 10 * len(s & own) >= 8 * len(s):
                out.add((i, j))
    return out


def repeats(docs, length):
    """{doc_id: (n_bytes, n_removed, n_spans, kept)}."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if cover[k] and (not k or not cover[k - 1]))
        out[i] = (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


def passages(docs, length, least):
    """{doc_id: (runs, words)} of the runs covered by repeated strings of length bytes that hold over least words."""
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        cover = "".join("1" if any(seen[b[p : p + length]] > 1 for p in range(max(0, k - length + 1), min(k, len(b) - length) + 1)) else "0" for k in range(len(b)))
        words = [len(b[m.start() : m.end()].split()) for m in re.finditer("1+", cover)]
        out[i] = (sum(n > least for n in words), sum(n for n in words if n > least))
    return out

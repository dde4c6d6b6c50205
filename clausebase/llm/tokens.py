"""Token counts by offset-mapped attribution.

Each whole document is encoded once.  The byte lengths of its tokens give the
place of every token in the text; these spans are joined to the document's
sections by interval (both are sorted, so a search finds each token's
sections), and a token that crosses a boundary goes where the rule says:

``start``     the section that holds its first byte
``end``       the section that holds its last byte
``majority``  the section that holds most of its bytes, the earlier on a tie
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

RULES = ("start", "end", "majority")
#: Texts are cut into pieces of about this size between lines for the encoder only if ``split_at`` is asked for; 0: whole texts.
_encoders: dict[str, tuple] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The encoder of a rank file and the byte length of each of its tokens; one per worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encoders[path]


def sections(data: np.ndarray) -> np.ndarray:
    """Ends of the lines of a text, in bytes; a line holds its line break. No line for an empty text."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if len(data) and len(ends) and ends[-1] == len(data) else np.append(ends, len(data)) if len(data) else ends[:0]


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross one of its boundaries."""
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    own = last if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for k in crossing:  # few: only tokens over a line break
            edges = np.concatenate(([starts[k]], section_ends[first[k] : last[k]], [token_ends[k]]))
            own[k] = first[k] + int(np.argmax(np.diff(edges)))
    n = len(section_ends)
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def count_by_section(docs: DataFrame, vocabulary: str | None = None, rule: str = "majority") -> DataFrame:
    """doc_id, section (from 0), start, end (bytes of UTF-8, end exclusive), n_tokens, n_crossing: one row for each line.

    The sum over a document's rows is the length of its encoding.  A null or
    empty text has one row, section 0, with no tokens.  Repeated rows repeat
    their result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoder(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for part in K.slices(texts):
                out: list[list] = [[], [], [], [], [], []]
                for k in range(part.last - part.first):
                    data = part.data[part.ends[k] : part.ends[k + 1]]
                    ends = sections(data)
                    if len(ends):
                        tokens = coder.encode_to_numpy(texts[part.first + k].as_py(), disallowed_special=())
                        n, crossing = allocate(np.cumsum(sizes[tokens]), ends, rule)
                    else:
                        ends = n = crossing = np.zeros(1, np.int64)
                    out[0].append(np.full(len(ends), part.first + k))
                    for column, values in zip(out[1:], (np.arange(len(ends)), np.concatenate(([0], ends[:-1])), ends, n, crossing), strict=True):
                        column.append(values)
                at, *rest = (np.concatenate(x) for x in out)
                yield pa.record_batch([ids.take(pa.array(at)), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")

"""Byte-level BPE of whole texts, long ones in overlapping chunks.

A text of at most ``CHUNK`` characters is encoded where it stands.  A longer one
is cut into chunks that overlap by ``OVERLAP`` characters, which are dealt out
and split into pre-tokens side by side.  What the pattern matches from a place
on depends on what follows only, so once two neighbours have a boundary in
common they agree from there on: the first common boundary in their overlap
becomes the seam between them.  The pieces between seams are encoded, each by
itself, and their ids are the text's ids.  Where neighbours don't meet in the
overlap the chunk is joined to the piece before it.

Decoding is the concatenation of the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tokens import default_vocabulary, encoder

CHUNK = 1 << 15
OVERLAP = 512
PORTION_BYTES = 1 << 22
_tables: dict[str, tuple[np.ndarray, np.ndarray, bytes]] = {}


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Starts and ends of each token's bytes in one string of all; one per worker."""
    if path not in _tables:
        coder, sizes = encoder(path)
        ends = np.cumsum(sizes)
        _tables[path] = ends - sizes, ends, b"".join(coder.decode_single_token_bytes(k) if n else b"" for k, n in enumerate(sizes))
    return _tables[path]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows with a few megabytes of text."""
    for batch in batches:
        for part in K.slices(batch.column("text"), PORTION_BYTES):
            yield batch.slice(part.first, part.last - part.first)


def decoded(ids: np.ndarray, path: str) -> bytes:
    starts, ends, data = token_bytes(path)
    return b"".join([data[a:b] for a, b in zip(starts[ids].tolist(), ends[ids].tolist(), strict=True)])


def encoded(text: str, path: str) -> np.ndarray:
    """Ids of a text, little-endian; strings that look like special tokens are ordinary text."""
    return encoder(path)[0].encode_to_numpy(text, disallowed_special=()).astype("<u4")


def _settled(c: str) -> bool:
    """Whether the class of a character has been fixed since Unicode 3.2, so that all libraries agree on it."""
    return unicodedata.ucd_3_2_0.category(c)[0] == unicodedata.category(c)[0]


def seams(text: str, low: int, high: int) -> list[int]:
    """Boundaries of pre-tokens from low to below high at which the text may be cut.

    The character before is no white space and the one behind no letter; a
    match of the pattern spans no such change of class, so that neither what
    comes before nor the end of a chunk can move the boundary.
    """
    import public_tokenizers
    import regex

    found = (m.end() for m in regex.finditer(public_tokenizers.PATTERN, text))
    return [p for p in found if low <= p < min(high, len(text)) and p and not text[p - 1].isspace() and not text[p].isalpha() and _settled(text[p - 1]) and _settled(text[p])]


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("sha"), batch.column("text"), strict=True):
                whole = text.as_py()
                starts = range(0, len(whole), chunk)
                for k in range(0, len(starts), 64):
                    some = starts[k : k + 64]
                    yield pa.record_batch([pa.array([key.as_py()] * len(some), pa.binary()), pa.array(range(k, k + len(some)), pa.int32()), pa.array([whole[a : a + chunk + overlap] for a in some])], names=["sha", "k", "text"])

    return run


def _boundaries(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in _portions(batches):
            texts = [x.as_py() for x in batch.column("text")]
            head = [seams(t[: 2 * overlap], 1, overlap) for t in texts]
            tail = [[p - chunk for p in seams(t, chunk, chunk + overlap)] for t in texts]
            yield pa.record_batch([batch.column("sha"), batch.column("k"), pa.array(head, kind), pa.array(tail, kind)], names=["sha", "k", "head", "tail"])

    return run


def _parts(chunk: int):
    """What a chunk gives to its piece: from its seam, or its start, to the next chunk's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "seam", "next")), strict=True)
            cut = [t[a or 0 : None if b is None else chunk + b] for t, a, b in rows]
            yield pa.record_batch([batch.column("sha"), batch.column("piece"), batch.column("k"), pa.array(cut, pa.string())], names=["sha", "piece", "k", "text"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            ids = [encoded(t, path).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("sha"), batch.column("piece"), pa.array(ids, pa.binary())], names=["sha", "piece", "ids"])

    return run


def _encode_joined(path: str):
    """As ``_encode``, for sorted parts of pieces of more than one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        pack = lambda: pa.record_batch([pa.array([key[0]], pa.binary()), pa.array([key[1]], pa.int32()), pa.array([encoded("".join(parts), path).tobytes()], pa.binary())], names=["sha", "piece", "ids"])
        for batch in batches:
            for sha, piece, text in zip(*(batch.column(c).to_pylist() for c in ("sha", "piece", "text")), strict=True):
                if key != (sha, piece):
                    if key is not None:
                        yield pack()
                    key, parts = (sha, piece), []
                parts.append(text)
        if key is not None:
            yield pack()

    return run


def long_texts(docs: DataFrame, chunk: int) -> DataFrame:
    """doc_id, sha, text of the texts that are cut."""
    return docs.where(F.length("text") > chunk).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")


def encode_long(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """sha, piece, ids (little-endian unsigned 32-bit integers) of each different text of more than chunk characters; pieces ascend."""
    cut = long_texts(docs, chunk).select("sha", "text").mapInArrow(_chunks(chunk, overlap), "sha binary, k int, text string")
    cut = cut.dropDuplicates(["sha", "k"])  # copies go before the shuffle
    edges = cut.mapInArrow(_boundaries(chunk, overlap), "sha binary, k int, head array<int>, tail array<int>")
    up = Window.partitionBy("sha").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(up), F.col("head")))
    stitched = edges.select("sha", "k", met.alias("seam"))
    begins = (F.col("k") == 0) | F.col("seam").isNotNull()
    owner = F.last(F.when(begins, F.col("k")), True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    more = F.lead("k").over(up).isNotNull()
    # a chunk whose successor has no seam ends where that one starts
    after = F.when(more, F.coalesce(F.lead("seam").over(up), F.lit(0)))
    several = ~begins | more & F.lead("seam").over(up).isNull()
    spans = stitched.select("sha", "k", "seam", owner.alias("piece"), after.alias("next"), several.alias("several"))
    parts = cut.join(spans, ["sha", "k"])
    schema = "sha binary, piece int, k int, text string"
    of = lambda several: parts.where(F.col("several") == several).select("sha", "k", "piece", "seam", "next", "text").mapInArrow(_parts(chunk), schema)
    single = of(False).mapInArrow(_encode(vocabulary), "sha binary, piece int, ids binary")
    joined = of(True).repartition("sha", "piece").sortWithinPartitions("sha", "piece", "k").mapInArrow(_encode_joined(vocabulary), "sha binary, piece int, ids binary")
    return single.unionByName(joined)


def encode(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, piece, ids: the ids of a document are those of its pieces in order.

    ids are little-endian unsigned 32-bit integers.  A null or empty text has
    one piece with none.  Repeated rows repeat their result.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            ids = [encoded(t or "", path).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([0] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "ids"])

    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = short.mapInArrow(run, "doc_id long, piece int, ids binary")
    cut = long_texts(docs, chunk).select("doc_id", "sha").join(encode_long(docs, path, chunk, overlap), "sha")
    return whole.unionByName(cut.select("doc_id", "piece", "ids"))


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, bytes of rows (doc_id, piece, ids): a document's bytes are those of its pieces in order."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [decoded(np.frombuffer(x, "<u4"), path) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("piece"), pa.array(data, pa.binary())], names=["doc_id", "piece", "bytes"])

    return rows.select("doc_id", "piece", "ids").mapInArrow(run, "doc_id long, piece int, bytes binary")


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: hashes of each text's ids and of the bytes that they decode to.

    A null text is empty.  Long texts are hashed piece by piece as their sorted
    pieces pass; equal ones are encoded once.
    """
    path = vocabulary or default_vocabulary()

    def short_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            ids = [encoded(t or "", path) for t in batch.column("text").to_pylist()]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(decoded(x, path)).hexdigest() for x in ids])]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, of_ids, of_bytes = None, 0, hashlib.sha256(), hashlib.sha256()
        pack = lambda: pa.record_batch([pa.array([key], pa.binary()), pa.array([n], pa.int64()), pa.array([of_ids.hexdigest()]), pa.array([of_bytes.hexdigest()])], names=["sha", "n_tokens", "ids_sha256", "decoded_sha256"])
        for batch in batches:
            for sha, ids in zip(batch.column("sha").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if sha != key:
                    if key is not None:
                        yield pack()
                    key, n, of_ids, of_bytes = sha, 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids) // 4
                of_ids.update(ids)
                of_bytes.update(decoded(np.frombuffer(ids, "<u4"), path))
        if key is not None:
            yield pack()

    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = short.mapInArrow(short_ones, f"doc_id long, {_DIGESTS}")
    pieces = encode_long(docs, path, chunk, overlap).repartition("sha").sortWithinPartitions("sha", "piece")
    hashed = pieces.select("sha", "ids").mapInArrow(long_ones, f"sha binary, {_DIGESTS}")
    cut = long_texts(docs, chunk).select("doc_id", "sha").join(hashed, "sha")
    return whole.unionByName(cut.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))

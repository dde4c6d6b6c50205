"""Language identification by multilingual mixture inference.

Each language is a model of hashed byte trigrams within words.  A document is
taken as a mixture: every word comes from one language, drawn with the
document's own proportions, which expectation-maximisation estimates.  Sets of
the leading languages are compared by penalised likelihood (Bayesian
information criterion: half of log(words) for each language), and the leading
language of the chosen set is the prediction.

Learning covers every training row: each task adds up one count vector per
language, so what is shuffled is bounded by tasks x languages x ``BINS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

BINS = 1 << 15
ROUNDS = 8
#: Languages that may be learned; more than that is an error, not a cut.
MOST_LANGUAGES = 512
UNDETERMINED = "und"
LETTER = r"\p{L}"


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(part: K.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams of words with a space on either side, the first trigram of each word, each text's bounds among words."""
    low = K.LOWER[part.data]
    starts, stops, bounds = K.runs(K.WORD[low], part.ends)
    if not len(starts):
        return np.zeros(0, np.int32), starts, bounds
    size = stops - starts
    firsts = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(size.sum()) - np.repeat(firsts - starts, size)
    padded = np.concatenate((low, [32])).astype(np.uint32)
    before, here, after = padded[at - 1], padded[at], padded[at + 1]
    before[firsts] = 32
    after[firsts + size - 1] = 32
    code = (before | here << np.uint32(8) | after << np.uint32(16)) * np.uint32(2654435761)
    return (code >> np.uint32(17)).astype(np.int32), firsts, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for part in K.slices(batch.column("text")):
            bins, firsts, bounds = _grams(part)
            cuts = np.append(firsts, len(bins))[bounds]
            own = langs[part.first : part.last]
            for lang in set(own):
                mask = np.repeat(own == lang, np.diff(cuts))
                seen = total.setdefault(lang, np.zeros(BINS, np.int64))
                seen += np.bincount(bins[mask], minlength=BINS)
    for lang, seen in total.items():
        at = np.flatnonzero(seen)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bin": pa.array(at, pa.int64()), "n": pa.array(seen[at], pa.int64())})


def learn(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each bin by language, from all rows with text and lang."""
    counts = train.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins")).orderBy("lang")  # BINS entries at most
    langs, rows = [], []
    for row in counts.toLocalIterator():
        if len(langs) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
        seen = np.full(BINS, 0.5)
        for b, n in row["bins"]:
            seen[b] += n
        langs.append(row["lang"])
        rows.append(np.log(seen / seen.sum()))
    return langs, np.array(rows, np.float32).reshape(len(langs), BINS)


def _mixture(like: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over words. like: words x languages; allowed: documents x languages. Proportions and log-likelihoods."""
    share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
    top = like.max(1, keepdims=True)
    odds = np.exp(np.maximum(like - top, -60))
    size = np.maximum(np.bincount(doc, minlength=n_docs), 1)[:, None]
    fit = np.zeros(n_docs)
    for _ in range(ROUNDS):
        part = odds * share[doc]
        total = np.maximum(part.sum(1), 1e-38)
        part /= total[:, None]
        share = np.stack([np.bincount(doc, part[:, k], n_docs) for k in range(like.shape[1])], 1) / size
    total = np.maximum((odds * share[doc]).sum(1), 1e-38)
    fit = np.bincount(doc, np.log(total) + top[:, 0], n_docs)
    return share, fit


def infer(part: K.Slice, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a slice: proportions by language (0 outside the chosen set), and its number of words."""
    n_docs, n_langs = part.last - part.first, len(logp)
    bins, firsts, bounds = _grams(part)
    n_words = np.diff(bounds)
    if not len(firsts) or not n_langs:
        return np.zeros((n_docs, n_langs)), n_words
    like = np.stack([np.add.reduceat(row[bins], firsts) for row in logp], 1)
    doc = np.repeat(np.arange(n_docs), n_words)
    share, fit = _mixture(like, doc, n_docs, np.ones((n_docs, n_langs)))
    order = np.argsort(-share, axis=1, kind="stable")
    cost = 0.5 * np.log(np.maximum(n_words, 2))
    best_share = np.zeros((n_docs, n_langs))
    np.put_along_axis(best_share, order[:, :1], 1.0, 1)
    best = np.bincount(doc, like[np.arange(len(doc)), order[doc, 0]], n_docs) - cost
    for k in range(2, n_langs + 1):
        # no set explains a text better than all languages do: where even that fit is not worth k languages, no k can win
        open_docs = fit - k * cost > best
        if not open_docs.any():
            break
        mask = open_docs[doc]
        ids = np.flatnonzero(open_docs)
        allowed = np.zeros((len(ids), n_langs))
        np.put_along_axis(allowed, order[ids, :k], 1.0, 1)
        own, ll = (share[ids], fit[ids]) if k == n_langs else _mixture(like[mask], np.searchsorted(ids, doc[mask]), len(ids), allowed)
        value = ll - k * cost[ids]
        better = value > best[ids]
        best[ids[better]], best_share[ids[better]] = value[better], own[better]
    best_share[n_words == 0] = 0
    return best_share, n_words


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, and languages (map of each chosen language to its share), from the text alone.

    Null, empty or letterless texts give ``und`` with score 0 and no
    languages, as does a model that has learned nothing.  Repeated rows each
    give a row.
    """
    langs, logp = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            pred, score, sets = [], [], []
            for part in K.slices(batch.column("text")):
                share, n_words = infer(part, logp)
                for k in range(part.last - part.first):
                    if not letters[part.first + k] or not langs or not n_words[k]:
                        pred.append(UNDETERMINED)
                        score.append(0.0)
                        sets.append([])
                        continue
                    own = [(langs[j], float(share[k, j])) for j in np.argsort(-share[k], kind="stable") if share[k, j] > 0]
                    pred.append(own[0][0])
                    score.append(min(1.0, own[0][1]))
                    sets.append(own)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64()), "languages": pa.array(sets, pa.map_(pa.string(), pa.float64()))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least this share, all columns as they were.

    Learns from the same documents outside the held-out fold.  Runs as one
    map: every row passes whole through the workers, repeated rows too.
    """
    langs, logp = learn(docs.where(~held_out(F.col("doc_id"))))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            letters = np.array(batch.column(len(names)).to_pylist(), bool)
            for part in K.slices(batch.column(at)):
                share, n_words = infer(part, logp)
                good[part.first : part.last] = (n_words > 0) & (share.max(1, initial=0) >= least) & letters[part.first : part.last]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([batch.schema.field(k) for k in range(len(names))])).filter(pa.array(good))

    flag = "letters" + "_" * max(map(len, names))  # no column has that name
    rows = docs.select("*", F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias(flag))
    return rows.mapInArrow(run, docs.schema)


def fold(doc_id: int) -> int:
    """The fold of a document, as a plain function for tests."""
    return zlib.crc32(str(doc_id).encode()) % 4

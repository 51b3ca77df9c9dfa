"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of non-letters become one gap. Every n-gram of one to three positions that
holds a letter is hashed into a bucket. Training sums bucket counts and documents by language on the
executors; the smoothed log-probabilities are a matrix (buckets x languages) that is broadcast with the
languages' log priors. Scoring gathers a batch's rows of that matrix in numpy and sums them document by
document; a long text goes part by part, with the n-grams that cross from one to the next.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Bytes of text that are taken at a time: arrays of n-grams are some forty times as large.
CHUNK = 1 << 18
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNDETERMINED = "und"
#: Log-likelihoods are divided by this before they become a posterior: n-grams overlap, so that each letter
#: speaks in some six of them, which the model takes for six independent witnesses.
TEMPERATURE = 6.0


class Model(NamedTuple):
    """Languages in order, float32 log-probabilities (BUCKETS x languages) and log priors."""

    langs: list[str]
    logs: np.ndarray
    priors: np.ndarray


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased text with each run of non-letters as one 0, and which are letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    stay = letter.copy()
    stay[1:] |= letter[:-1]  # the first of a run of non-letters stays as a gap; at the start there is none
    return np.where(letter, points, np.uint32(0))[stay], letter[stay]


def _hashed(points: np.ndarray, letter: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each place, and whether it holds a letter."""
    n = max(0, len(points) - size + 1)
    h = np.full(n, np.uint32(size * 0x27D4EB2F & 0xFFFFFFFF), np.uint32)
    some = np.zeros(n, bool)
    for k in range(size):
        h = (h ^ points[k : n + k]) * _MIX[k]
        h ^= h >> np.uint32(15)
        some |= letter[k : n + k]
    return (h & np.uint32(BUCKETS - 1)).astype(np.int32), some


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a batch of texts."""
    joined = "\n".join(texts).lower()
    if joined.count("\n") != len(texts) - 1 or len(joined) != sum(map(len, texts)) + len(texts) - 1:  # line breaks inside, or lower case of another length
        lowered = [t.lower() for t in texts]
        joined, sizes = "\n".join(lowered), np.fromiter(map(len, lowered), np.int64, len(texts))
    else:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)[: len(points)]
    breaks = np.cumsum(sizes + 1)[:-1] - 1
    stay = letter.copy()
    stay[1:] |= letter[:-1]  # the first of a run of non-letters stays as a gap
    stay[breaks] = False
    points, letter, owner = np.where(letter, points, np.uint32(0))[stay], letter[stay], owner[stay]
    docs, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for size in ORDERS:
        h, some = _hashed(points, letter, size)
        some &= owner[: len(h)] == owner[len(owner) - len(h) :]
        docs.append(owner[: len(h)][some])
        buckets.append(h[some])
    return np.concatenate(docs), np.concatenate(buckets)


#: Where a long text may be cut: after a blank, which ends a word for lower-casing as well.
_CUT = re.compile("[ \n\t]").search


def _parts(text: str, limit: int):
    """Parts of about `limit` characters, cut after a blank if one comes within as many again."""
    at = 0
    while at < len(text):
        end = at + limit
        if end < len(text):
            end = m.end() if (m := _CUT(text, end, end + limit)) else end + limit
        yield text[at:end]
        at = end


def long_grams(text: str, limit: int = CHUNK):
    """The buckets of `grams` of one text, part by part."""
    points, letter = np.zeros(0, np.uint32), np.zeros(0, bool)
    for part in _parts(text, limit):
        more_points, more_letter = _symbols(part)
        held = len(points)
        # A cut in a word can leave the first non-letter after it without its gap.
        if held and letter[-1] and not letters()[ord(part[0].lower()[0])]:
            more_points, more_letter = np.append(np.uint32(0), more_points), np.append(False, more_letter)
        points, letter = np.concatenate([points, more_points]), np.concatenate([letter, more_letter])
        for size in ORDERS:
            first = max(0, held - size + 1)  # n-grams within what was held have been given
            h, some = _hashed(points[first:], letter[first:], size)
            yield h[some]
        points, letter = points[-max(ORDERS) + 1 :], letter[-max(ORDERS) + 1 :]


def _batches(texts: list[str]):
    """(numbers of the texts, buckets with the place of their text among these) of short texts at once, of a long one in parts."""
    short = [k for k, t in enumerate(texts) if len(t) <= 2 * CHUNK]
    if short:
        yield np.array(short), *grams([texts[k] for k in short])
    for k in set(range(len(texts))) - set(short):
        for buckets in long_grams(texts[k]):
            yield np.array([k]), np.zeros(len(buckets), np.int64), buckets


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_rows: int = 20_000, max_languages: int = 256, seed: int = 11) -> Model:
    """The model of rows with a text and a language.

    Beyond `sample_rows` such rows it learns from a random sample of about that many, and from the
    `max_languages` languages with most rows in it (of equal ones the first by name): the bounds on what a
    fit reads and broadcasts. No such row: a model without a language.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    total = docs.filter(docs[lang_col].isNotNull()).select(F.lit(1)).count()
    if total > sample_rows:
        rows = rows.sample(fraction=sample_rows / total, seed=seed)

    def count(batches):
        sums: dict[str, np.ndarray] = {}  # bucket counts, then the documents
        for batch in batches:
            for part in common.chunks(batch, CHUNK):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                names = sorted(set(langs))
                of = np.array([names.index(x) for x in langs], np.int64)
                flat = np.zeros((len(names), BUCKETS + 1), np.int64)
                flat[:, BUCKETS] = np.bincount(of, minlength=len(names))
                for numbers, doc, bucket in _batches(texts):
                    flat[:, :BUCKETS] += np.bincount(of[numbers][doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, flat, strict=True):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            hit = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(hit), pa.string()), "bucket": pa.array(hit, pa.int32()), "n": pa.array(row[hit], pa.int64())})

    none = Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    if not total:
        return none
    summed = rows.mapInArrow(common.tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with common.scratch(docs.sparkSession):
        summed = common.settle(summed, "counts")
        most = summed.filter(F.col("bucket") == BUCKETS).orderBy(F.desc("n"), "lang").limit(max_languages).select("lang")
        table = summed.join(F.broadcast(most), "lang").toArrow()  # at most BUCKETS rows for each language
    if not table.num_rows:
        return none
    names, bucket, n = (table.column(c) for c in ("lang", "bucket", "n"))
    langs = sorted(set(names.to_pylist()))
    of = np.searchsorted(langs, names.to_pylist())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[bucket.to_numpy(), of] = n.to_numpy()
    smoothed = counts[:BUCKETS] + 0.5
    return Model(langs, np.log(smoothed / smoothed.sum(0)).astype(np.float32), np.log(counts[BUCKETS] / counts[BUCKETS].sum()))


def score(texts: list[str], model: Model, temperature: float = TEMPERATURE) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the winner's posterior, of log-likelihoods divided by `temperature`."""
    sums, n = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for numbers, doc, bucket in _batches(texts):
        n[numbers] += np.bincount(doc, minlength=len(numbers))
        for k in range(len(model.langs)):
            sums[numbers, k] += np.bincount(doc, weights=model.logs[:, k][bucket], minlength=len(numbers))
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    scaled = sums / temperature + model.priors
    odds = np.exp(scaled - scaled.max(1, keepdims=True))
    odds /= odds.sum(1, keepdims=True)
    best = odds.argmax(1)
    return [model.langs[b] if k else UNDETERMINED for b, k in zip(best, n, strict=True)], np.where(n > 0, odds.max(1), 0.0)


class Predict:
    def __init__(self, model, temperature: float):
        self.model, self.temperature = model, temperature  # the model is broadcast

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        named, scores = score([t or "" for t in batch.column("text").to_pylist()], self.model.value, self.temperature)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(named, pa.string()), "score": pa.array(scores, pa.float64())})


def predict(docs: DataFrame, model: Model, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the winner's posterior, 0 to 1) for each row.

    Null texts and texts without a letter are `und` with score 0, and so are all texts by a model without
    a language; of languages with equal posteriors the first by name wins; ids may be null or repeat, and
    equal texts are judged alike; whole texts count, a long one part by part; an empty table gives an empty
    table; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    return common.map_chunks(common.id_and_text(docs, id_col, text_col), Predict(shared, temperature), "doc_id long, lang_pred string, score double", CHUNK)


class Sieve:
    """Passes whole rows whose language is known with at least `least` as score."""

    def __init__(self, model, least: float, temperature: float, text_col: str):
        self.model, self.least, self.temperature, self.text_col = model, least, temperature, text_col

    def __call__(self, batches):
        model = self.model.value
        for batch in batches:
            kept = []
            place = batch.schema.get_field_index(self.text_col)
            slim = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string()).fill_null("")], names=["text"])
            for part in common.chunks(slim, CHUNK):
                texts = part.column("text").to_pylist()
                if model.langs:
                    named, scores = score(texts, model, self.temperature)
                    kept += [x != UNDETERMINED and s >= self.least for x, s in zip(named, scores, strict=True)]
                else:
                    kept += [any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))


def keep(docs: DataFrame, model: Model, least: float = 0.5, temperature: float = TEMPERATURE, text_col: str = "text") -> DataFrame:
    """The rows of `docs` in a language of the model, with all their columns, whatever those are named.

    A row goes if its text is null or has no letter, or if its score is under `least`. A model without a
    language (a table without labels) can't tell languages apart: then only rows without a letter go.
    Whole texts count; ids aren't read; repeated rows are judged alike; an empty table gives an empty table.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(common.tidy(Sieve(shared, least, temperature, text_col)), docs.schema)


def held_out(doc_id):
    """Every fifth document by crc32 of its id; null ids are not held out and not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return train(docs.filter(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 != 0))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return predict(docs, learned(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

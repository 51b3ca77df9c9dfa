"""Quality rules as a short-circuit cascade.

Every row gets its base counts. A row that passes the base test then meets the rules one after
another until one rejects it. What each rule costs by itself and which rows it rejects is measured on a
sample of the table; first comes the rule with most rejections per second, then the one with most among
the rows that are left, and so on. The order changes the work, never the verdict: a row is kept if no
rule rejects it.
"""

from __future__ import annotations

import io
import itertools
import math
import time
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
#: Bytes of a text whose words or lines are objects at a time.
PART = 1 << 20


class Doc:
    """A text with its counts; what only some rules need is made when first asked for.

    Words are kept as numbers, eight bytes each, and only different ones as objects.
    """

    def __init__(self, text: str | None):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        self.ascii = len(data) == len(text)
        self.first: dict[bytes, int] = {}
        parts, n = [np.zeros(0, np.int64)], 0
        for body in common.cut_at_blanks(data, PART):
            words = body.split()  # at [\x20\x09-\x0D], as the contract has it
            parts.append(np.fromiter(map(self.first.setdefault, words, itertools.count(n)), np.int64, len(words)))
            n += len(words)
        self.codes = parts[1] if len(parts) == 2 else np.concatenate(parts)
        self.n_words = n
        self.word_chars = len(text) - (len(data) - len(data.translate(None, common.BLANKS)))
        self.n_symbols = len(data) - len(data.translate(None, SYMBOLS))
        self.n_lines, self.n_dup_lines = _lines(data)
        self.n_repeat_words = repeat_words(self.codes)
        self.base_failed = n < 50 or 100 * self.n_repeat_words > 50 * n

    @property
    def distinct_words(self) -> int:
        return len(self.first)

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each different word occurs, in the order of `first`."""
        return np.bincount(self.codes)[np.fromiter(self.first.values(), np.int64, len(self.first))] if self.first else np.zeros(0, np.int64)

    @cached_property
    def strings(self) -> list[str]:
        return b"\n".join(self.first).decode("utf-8", "surrogatepass").split("\n") if self.first else []

    def _flags(self, test: Callable[[str], bool]) -> np.ndarray:
        return np.fromiter(map(test, self.strings), bool, len(self.strings))

    @property
    def shouted(self) -> int:
        """Words that `shouts` says yes to; of ASCII words `isupper` says the same."""
        yes = self._flags(str.isupper)
        if not self.ascii:
            for k in np.flatnonzero(~self._flags(str.isascii)).tolist():
                yes[k] = shouts(self.strings[k])
        return int(self.counts[yes].sum())

    @property
    def lettered(self) -> int:
        """Words with a letter; those of letters alone are told by `isalpha`."""
        yes = self._flags(str.isalpha)
        for k in np.flatnonzero(~yes).tolist():
            yes[k] = has_letter(self.strings[k])
        return int(self.counts[yes].sum())

    def forget(self) -> None:
        """Drops what rules have asked for, so that the next one is measured by itself."""
        self.__dict__.pop("counts", None)
        self.__dict__.pop("strings", None)


def shouts(word: str) -> bool:
    """Has an upper-case letter (Lu) and no lower-case one (Ll)."""
    kinds = set(map(unicodedata.category, word))
    return "Lu" in kinds and "Ll" not in kinds


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier one."""
    if len(data) <= PART:
        lines = [x for x in data.split(b"\n") if x.strip()]
        return len(lines), len(lines) - len(set(lines))
    n, seen = 0, set()
    for line in io.BytesIO(data):
        if line.strip():
            n += 1
            seen.add(line.removesuffix(b"\n"))
    return n, n - len(seen)


def repeat_words(codes: np.ndarray, size: int = 3) -> int:
    """Words within windows of `size` words that occur twice or more; `codes` are equal for equal words."""
    n = len(codes)
    if n <= size:
        return 0
    key = codes[: n - size + 1]
    for k in range(1, size):
        if n >= 2_000_000:  # keep products within 64 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * n + codes[k : n - size + 1 + k]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    cover = np.zeros(n, bool)
    for k in range(size):
        cover[k : n - size + 1 + k] |= twice
    return int(cover.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def rules(symbols=0.1, dup_lines=0.5, shouted=0.4, lettered=0.7, vocabulary=2.0, shortest=2.0, longest=15.0) -> list[Rule]:
    """The rules and their limits; shares are of words, or of lines that hold a word."""
    return [
        Rule("symbols", lambda d: d.n_symbols > symbols * d.n_words),
        Rule("dup_lines", lambda d: d.n_dup_lines > dup_lines * d.n_lines),
        Rule("word_length", lambda d: not shortest * d.n_words <= d.word_chars <= longest * d.n_words),
        Rule("vocabulary", lambda d: d.distinct_words < vocabulary * math.sqrt(d.n_words)),
        Rule("shouted", lambda d: d.shouted > shouted * d.n_words),
        Rule("lettered", lambda d: d.lettered < lettered * d.n_words),
    ]


@dataclass(frozen=True)
class Measured:
    """Seconds a row of each rule, and how many sampled rows each set of rules (a bit a rule) rejects."""

    seconds: list[float]
    rows: dict[int, int]


def measure(docs: DataFrame, cascade: list[Rule], sample_rows: int = 2000, seed: int = 7, text_col: str = "text") -> Measured:
    """Cost and selectivity of the rules on about `sample_rows` rows, of which those that pass the base test count."""
    total = docs.select(F.lit(1)).count()
    sample = docs.select(docs[text_col].cast("string").alias("text"))
    if total > sample_rows:
        sample = sample.sample(fraction=sample_rows / total, seed=seed)

    def run(batches):
        seconds, rows = [0.0] * len(cascade), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                doc = Doc(text)
                if doc.base_failed:
                    continue
                rejected = 0
                for k, rule in enumerate(cascade):
                    doc.forget()
                    began = time.perf_counter()
                    rejected |= bool(rule.rejects(doc)) << k
                    seconds[k] += time.perf_counter() - began
                rows[rejected] += 1
        # A row for each rule with its seconds, and one for each set of rules with its rows.
        yield pa.RecordBatch.from_pydict({"rule": pa.array([*range(len(cascade)), *[None] * len(rows)], pa.int32()), "rejected": pa.array([*[None] * len(cascade), *rows], pa.int64()), "n": pa.array([0] * len(cascade) + list(rows.values()), pa.int64()), "seconds": pa.array(seconds + [0.0] * len(rows), pa.float64())})

    sums = sample.mapInArrow(common.tidy(run), "rule int, rejected long, n long, seconds double").groupBy("rule", "rejected").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))
    found = sums.collect()  # a row for each rule and for each set of rules that rejects a sampled row
    rows = {r["rejected"]: r["n"] for r in found if r["rejected"] is not None}
    n = max(1, sum(rows.values()))
    by_rule = {r["rule"]: r["seconds"] / n for r in found if r["rule"] is not None}
    return Measured([by_rule.get(k, 0.0) for k in range(len(cascade))], rows)


def order(cascade: list[Rule], measured: Measured) -> list[Rule]:
    """Each time the rule with most rejections per second among the rows left; ties keep their place."""
    rows, left, out = dict(measured.rows), list(range(len(cascade))), []
    while left:
        best = max(left, key=lambda k: sum(n for rejected, n in rows.items() if rejected >> k & 1) / max(measured.seconds[k], 1e-9))
        left.remove(best)
        out.append(cascade[best])
        rows = {rejected: n for rejected, n in rows.items() if not rejected >> best & 1}
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Judge:
    def __init__(self, cascade: list[Rule]):
        self.cascade = cascade

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        docs = [Doc(t) for t in batch.column("text").to_pylist()]
        by = [None if d.base_failed else next((r.name for r in self.cascade if r.rejects(d)), None) for d in docs]
        out = {"doc_id": batch.column("doc_id")} | {c: pa.array([getattr(d, c) for d in docs], pa.int64()) for c in COUNTS}
        out |= {"base_failed": pa.array([d.base_failed for d in docs], pa.bool_()), "kept": pa.array([not d.base_failed and b is None for d, b in zip(docs, by, strict=True)], pa.bool_()), "rejected_by": pa.array(by, pa.string())}
        return pa.RecordBatch.from_pydict(out)


def judge(docs: DataFrame, cascade: list[Rule] | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: base counts, base_failed, kept, and the rule that rejected it first, if one did.

    Null and empty texts have no words and fail the base test; whole texts of any length are read, with
    eight bytes a word and the different words and lines as objects; null and repeated ids are judged row
    by row; an empty table gives an empty table; other columns are not
    read. `rejected_by` names the first of the rules in their measured order, which may differ between
    runs where several reject; `kept` does not.
    """
    cascade = order(cascade or rules(), measure(docs, cascade or rules(), sample_rows, text_col=text_col))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, rejected_by string"
    return common.map_chunks(common.id_and_text(docs, id_col, text_col), Judge(cascade), schema)


class Sieve:
    """Passes whole rows that are kept, whatever their columns."""

    def __init__(self, cascade: list[Rule], text_col: str):
        self.cascade, self.text_col = cascade, text_col

    def __call__(self, batches):
        for batch in batches:
            docs = map(Doc, batch.column(batch.schema.get_field_index(self.text_col)).cast(pa.string()).to_pylist())
            yield batch.filter(pa.array([not d.base_failed and not any(r.rejects(d) for r in self.cascade) for d in docs], pa.bool_()))


def keep(docs: DataFrame, cascade: list[Rule] | None = None, sample_rows: int = 2000, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns, whatever those are named.

    Null, empty and long texts and repeated rows are judged as there; ids aren't read; an empty table gives
    an empty table.
    """
    cascade = order(cascade or rules(), measure(docs, cascade or rules(), sample_rows, text_col=text_col))
    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(common.tidy(Sieve(cascade, text_col)), docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir)).drop("rejected_by")


_WORD = r"[^\x20\x09-\x0D]+"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
base AS (
  SELECT r, doc_id, ws, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)),
said AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT n_symbols > 0.1 * n_words AND NOT n_dup_lines > 0.5 * n_lines
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND NOT len(list_distinct(ws)) < 2 * sqrt(n_words)
       AND NOT len(list_filter(ws, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > 0.4 * n_words
       AND NOT len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < 0.7 * n_words AS kept
FROM said
"""

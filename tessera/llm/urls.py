"""URL filter: listed rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled table of URLs, a parameter; the default one is
made below from words that such names are often made of. It is a vector of weights that the closure
carries. Batches of URLs are scored in numpy.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

DIMENSIONS = 1 << 13
SIZES = (3, 4, 5)
#: Rules are (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: What the default labelled table is made of (fixed values): words of unwanted names with what they are
#: joined with, words of wanted names, and syllables for names without a meaning.
UNWANTED = "casino poker wager betting slots roulette jackpot lottery pills pharmacy viagra meds steroids adult porn xxx sex cams escorts spam mailer ads adserver banner popup tracker clicks payday loans replica warez keygen".split()
HEADS = "best free cheap hot top easy real".split()
TAILS = "online shop club zone now deals world".split()
WANTED = "news library museum weather garden university recipes science history travel music health school village river mountain journal research archive market theatre kitchen football engineering photography freedom winter farmers traces address sextant padding classics".split()
SYLLABLES = "an ble con der ent for ga hin il ja ka lor mer ne or pa qui ren san tion ur ver wen yo zu".split()
TOPICS = "about articles index page topic story guide notes".split()


def _joined(words: list[str]) -> list[str]:
    """Names made of each word: alone, and joined with heads and tails that say nothing of a page."""
    out = list(words)
    for i, w in enumerate(words):
        for k in range(2):
            head, tail = HEADS[(3 * i + 2 * k) % len(HEADS)], TAILS[(2 * i + 3 * k) % len(TAILS)]
            out += [f"{head}-{w}", f"{w}-{tail}", f"{w}{tail}" if k else f"{head}{w}"]
    return out


def labelled() -> list[tuple[str, bool]]:
    """The default table of (url, unwanted): names under several hosts. Both classes get paths of the same kinds."""
    made = [a + SYLLABLES[(i * 7 + 3 * k) % len(SYLLABLES)] + SYLLABLES[(i * 11 + 5 * k) % len(SYLLABLES)] for k in (1, 2) for i, a in enumerate(SYLLABLES)]
    out = []
    for names, bad in ((_joined(UNWANTED), True), (_joined(WANTED) + made, False)):
        for i, name in enumerate(names):
            for j in (i % 4, (i + 2) % 4):
                front, end = (("", "com"), ("www.", "net"), ("m.", "org"), ("blog.", "com"))[j]
                language = ("en", "fr", "de", "es")[(i + j) % 4]
                number = (i * 37 + j * 101) % 9973
                out.append((f"https://{front}{name}.example.{end}/{language}/{number if i % 3 else TOPICS[(i + j) % len(TOPICS)]}", bad))
    return out


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    return rest[:end].translate(_UPPER), path[: m.start() if (m := _PATH_END.search(path)) else len(path)]


class Rules:
    """Longest rule whose host is the URL's host or a parent domain and whose path is a prefix."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for prefix, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            _, _, host = host.partition(".")
        return best


_MULTIPLIER = np.uint32(0x85EBCA77)


def _field(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the byte n-grams of each text between its marks ^ and $."""
    marked = [b"^" + t.encode("utf-8", "surrogatepass") + b"$" for t in texts]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(marked)), list(map(len, marked)))
    owners, buckets = [], []
    for size in SIZES:
        n = max(0, len(data) - size + 1)
        h = np.full(n, np.uint32(8 * salt + size), np.uint32)
        for k in range(size):
            h = (h ^ data[k : k + n]) * _MULTIPLIER
            h ^= h >> np.uint32(15)
        whole = owner[:n] == owner[len(data) - n :]
        owners.append(owner[:n][whole])
        buckets.append((h[whole] % np.uint32(DIMENSIONS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def features(parts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(number in the list, bucket) of the distinct n-grams of each (host, path); host's and path's are told apart."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fields = [_field([p[k] for p in parts], k) for k in range(2)]
    flat = np.unique(np.concatenate([o * DIMENSIONS + b for o, b in fields]))
    return flat // DIMENSIONS, flat % DIMENSIONS


def fit(table: Iterable[tuple[str, bool]], rounds: int = 500, rate: float = 20.0, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by full-batch gradient descent over the columns that occur."""
    table = list(table)
    w, b = np.zeros(DIMENSIONS), 0.0
    if not table:
        return w, b
    row, bucket = features([split(url) for url, _ in table])
    used, column = np.unique(bucket, return_inverse=True)
    x = 1 / np.sqrt(np.bincount(row, minlength=len(table)))[row]  # of the cells that aren't zero, row by row
    there, row_starts = np.unique(row, return_index=True)
    by_column = np.argsort(column, kind="stable")
    column_starts, x_by_column, row_by_column = np.unique(column[by_column], return_index=True)[1], x[by_column], row[by_column]
    y, v, z = np.array([float(bad) for _, bad in table]), np.zeros(len(used)), np.zeros(len(table))
    for _ in range(rounds if len(row) else 0):
        z[there] = np.add.reduceat(x * v[column], row_starts)
        error = (1 / (1 + np.exp(-(z + b))) - y) / len(table)
        v -= rate * (np.add.reduceat(x_by_column * error[row_by_column], column_starts) + ridge * v)
        b -= rate / 10 * error.sum()
    w[used] = v
    return w, b


@functools.cache
def default_model() -> tuple[np.ndarray, float]:
    return fit(labelled())


def unwanted(parts: list[tuple[str, str]], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Probability by the model of each (host, path); 0 without a host, which the model knows nothing of."""
    row, bucket = features(parts)
    n = np.bincount(row, minlength=len(parts))
    sums = np.bincount(row, weights=model[0][bucket], minlength=len(parts))
    return np.where([bool(h) for h, _ in parts], 1 / (1 + np.exp(-(sums / np.sqrt(np.maximum(1, n)) + model[1]))), 0.0)


class Judge:
    def __init__(self, rules, model, least):
        self.rules, self.model, self.least = Rules(rules), model, least

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [split(u) for u in batch.column("text").to_pylist()]
        found = [self.rules.find(*x) for x in parts]
        scores = unwanted(parts, self.model)
        return pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("doc_id"),
                "host": pa.array([h for h, _ in parts], pa.string()),
                "path": pa.array([p for _, p in parts], pa.string()),
                "rule": pa.array([f and f[0] for f in found], pa.string()),
                "verdict": pa.array([f[1] if f else "block" if s >= self.least else "allow" for f, s in zip(found, scores.tolist(), strict=True)], pa.string()),
                "unwanted": pa.array(scores, pa.float64()),
            }
        )


def judge(pages: DataFrame, rules=RULES, table: Iterable[tuple[str, bool]] | None = None, least: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability that the page is unwanted.

    `table` is the labelled one, of (url, unwanted). No rule: a page is blocked from a probability of
    `least` on. A null URL or one without `://` has an empty host and path, fits no rule and is allowed.
    A host keeps its port. A rule such as `org/` needs a path that starts with `/`. Rows are judged one by
    one: ids may be null or repeat; a long URL is read whole; an empty table gives an empty one; other
    columns are not read.
    """
    model = default_model() if table is None else fit(table)
    rows = common.id_and_text(pages, id_col, url_col)
    return common.map_chunks(rows, Judge(rules, model, least), "page_id long, host string, path string, rule string, verdict string, unwanted double")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))

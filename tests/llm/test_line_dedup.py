import random
import re

import duckdb
import pytest
from pyspark.sql import types as T

from tessera.llm import line_dedup


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sequences(rows):
    """Documents in order, each a list of (number, line, words) of its lines with a word."""
    docs = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    return docs, [[(n, x, len(WORD.findall(x))) for n, x in enumerate(t.split("\n")) if WORD.search(x)] for *_, t in docs]


def windows(seqs, enough):
    """(document, place, lines) of the shortest runs with enough words from and up to each place."""
    out = set()
    for d, s in enumerate(seqs):
        for k in range(len(s)):
            for ends in (range(k + 1, len(s) + 1), range(k, -1, -1)):
                for e in ends:
                    a, b = (k, e) if e > k else (e, k + 1)
                    if sum(x[2] for x in s[a:b]) >= enough:
                        out.add((d, a, b - a))
                        break
    return out


def kept_lines(docs, seqs, found, members):
    """{(id, text): kept lines} when of each window's equals (document, place) the first stays with what overlaps it."""
    gone = {d: set() for d in range(len(docs))}
    for d, k, n in found:
        e, j = min(members(d, k, n))
        if (e, j) != (d, k) and not (e == d and k < j + n):
            gone[d] |= {seqs[d][m][0] for m in range(k, k + n)}
    return {(None if null else i, t): [x for n, x in enumerate(t.split("\n")) if n not in gone[d]] for d, (null, i, t) in enumerate(docs)}


def brute(rows, enough):
    """By looking up the lines of every window."""
    docs, seqs = sequences(rows)
    found, places = windows(seqs, enough), {}
    for n in {n for *_, n in found}:
        for d, s in enumerate(seqs):
            for k in range(len(s) - n + 1):
                places.setdefault(tuple(x[1] for x in s[k : k + n]), []).append((d, k))
    return kept_lines(docs, seqs, found, lambda d, k, n: places[tuple(x[1] for x in seqs[d][k : k + n])])


def by_suffix_array(rows, enough):
    """By the sorted suffixes and their longest common prefixes: a window's equals are the interval around it."""
    docs, seqs = sequences(rows)
    suffixes = sorted(([x[1] for x in s[k:]], d, k) for d, s in enumerate(seqs) for k in range(len(s)))
    lcp = [0]
    for (x, *_), (y, *_) in zip(suffixes, suffixes[1:], strict=False):
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        lcp.append(n)
    rank = {(d, k): r for r, (_, d, k) in enumerate(suffixes)}

    def interval(d, k, n):
        low = high = rank[d, k]
        while lcp[low] >= n:
            low -= 1
        while high + 1 < len(lcp) and lcp[high + 1] >= n:
            high += 1
        return [x[1:] for x in suffixes[low : high + 1]]

    return kept_lines(docs, seqs, windows(seqs, enough), interval)


LONG = " ".join(f"w{i}" for i in range(60))
A, B, C, D = "a b c", "d e", "f g h i", "j"
ROWS = [
    (1, "\n".join([A, B, C, D])),
    (2, "\n".join(["new", A, B, "", C, D, "end"])),
    (3, "\n".join([B, C, "x", A, B])),
    (3, "\n".join([B, C, "x", A, B])),
    (4, LONG),
    (5, f"start\n{LONG}\n{LONG} \n{LONG}"),
    (None, f"{A}\n{B}\n{C}"),
    (6, None),
    (7, ""),
    (8, " \n\t\n"),
    (9, "\n".join([A] * 9)),
    (10, "\n".join([C, D] * 70)),
    (11, "\n".join(f"{k}" for k in range(40)) + f"\n{LONG}\r"),
    (12, "\n".join(f"{k}" for k in range(3, 40)) + "\nother"),
    (14, "\n".join([" ".join(f"q{k}" for k in range(25))] * 5)),
    (13, f"{LONG}\n" * 500 + "last"),
]


@pytest.mark.parametrize("enough", [1, 4, 7, 16, 50])
def test_against_brute_force(spark, enough):
    rows = ROWS if enough in (16, 50) else ROWS[:-1]
    if enough != 1:
        assert by_suffix_array(ROWS[:-1], enough) == brute(ROWS[:-1], enough)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, seqs int")
    want = brute(rows, enough)
    got = line_dedup.dedup(docs, enough).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in rows}
    for r in got:
        text = texts[r.doc_id]
        kept = want.get((r.doc_id, text))
        if text is None:
            assert (r.n_lines, r.n_removed, r.text) == (0, 0, None)
            continue
        assert r.text == "\n".join(kept), (r.doc_id, enough)
        assert r.n_lines == len(text.split("\n")) and r.n_removed == r.n_lines - len(kept)


def test_sql(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    documents = docs.toArrow()  # noqa: F841  read by duckdb
    want = duckdb.sql(line_dedup.OP10_SQL)
    out = line_dedup.dedup(docs)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_overlapping_repeats(spark):
    """Of a line repeated back to back the first copy of the run stays whole, and what overlaps it."""
    half = " ".join(f"q{k}" for k in range(25))
    for times, left in ((2, 2), (3, 3), (4, 2), (5, 2), (9, 2)):
        (r,) = line_dedup.dedup(spark.createDataFrame([(1, "\n".join([half] * times))], "doc_id long, text string")).collect()
        assert r.text == "\n".join([half] * left) and r.n_removed == times - left, times
    rows = [(1, f"{half}\n{half}"), (2, "\n".join([half] * 3))]
    out = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: f"{half}\n{half}", 2: ""}


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    """Few different lines, so that runs repeat, nest and overlap in every way."""
    rng = random.Random(seed)
    kinds = ["a", "b b", "c c c", "d d d d d d", "e"]
    rows = [(k, "\n".join(rng.choices(kinds, k=rng.randint(1, 40)))) for k in range(30)]
    want = brute(rows, 9)
    assert by_suffix_array(rows, 9) == want
    for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect():
        assert r.text == "\n".join(want[r.doc_id, rows[r.doc_id][1]])


def test_empty_and_columns(spark):
    schema = T.StructType.fromDDL("doc_id long, text string, id long, seq int, h string, gone string, row int, x long, rows long")
    assert line_dedup.dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, LONG, 5, 1, "h", "g", 7, 8, 9), (2, LONG, 6, 2, None, None, 7, 8, 9)]
    out = line_dedup.rewrite(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(*rows[0], 1, 0), (2, "", *rows[1][2:], 1, 1)]
    clash = spark.createDataFrame([(1, LONG, 5)], "doc_id long, text string, _Removed long")
    with pytest.raises(ValueError, match="_removed"):
        line_dedup.rewrite(clash)
    assert line_dedup.rewrite(clash, numbers=("n", "m")).columns == [*clash.columns, "n", "m"]


def test_large_tables_of_removed_lines_are_shuffled(spark, monkeypatch):
    """Also where one document, repeated, is most of the table."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    rows = [(1, f"x\n{LONG}"), *[(2, f"{LONG}\ny")] * 40, (3, "z"), (None, None)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, [(1, f"x\n{LONG}"), *[(2, "y")] * 40, (3, "z"), (None, None)]))

"""Removal of repeated line runs, on DataFrame functions alone.

Lines that hold a word are the symbols of a document's sequence; a line's identity is a 128-bit hash of
its text. Positions whose line occurs once in the corpus can't lie in a repeated run and drop out at
once. Prefix doubling then names the runs of 1, 2, 4, ... lines that start at each position by their
rank in sorted order: pairs of names of half the length are counted, those that occur twice or more
are range-sorted, and their place in that order is the name of the double length. These are the rank
arrays of the suffix array over line ids, as deep as a run of `min_words` words can reach (a line
holds a word at least, so log2(min_words) rounds, whatever the data).

Why that is enough: in the suffix array, the suffixes that share a prefix of l lines are one interval,
whose longest common prefix is l or more, and for 2**k <= l <= 2**(k + 1) two suffixes are in the same
one exactly if the ranks of their first 2**k lines are equal and so are those of the 2**k lines that end
the prefix. So (l, rank, rank) names the interval of any prefix, and a prefix that no other suffix has is
the one whose ranks dropped out. Each position has two windows: the shortest run from it, and the shortest
run up to it, with `min_words` words. A maximal repeated run of that many words is exactly the union of
the windows inside it, and a window is repeated if its interval has a second member. In each interval the
first member (by doc_id, then place) stays, and so does one that shares lines with it, as in a line that
is repeated back to back; the lines of all others are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: The place of null ids in the order of documents: last.
_LAST = 9223372036854775807
#: Lines that a window is first looked for in; only where they are too few for it, all that it may have.
_FEW = 6


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is its id and the hash of its text: rows that repeat both are one document."""
    return common.id_and_text(docs, id_col, text_col).select("text", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"))


def _lines(docs: DataFrame) -> DataFrame:
    """id, h, seq (0, 1, ... over lines with a word), line (its number), hashes a and b of the line, and its words w."""
    split = F.split("text", "\n", -1)
    lines = F.transform(split, lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    rows = docs.filter("text IS NOT NULL").select("id", "h", F.posexplode(F.filter(lines, lambda x: x["w"] > 0)).alias("seq", "x"))
    return rows.select("id", "h", F.col("seq").cast("long").alias("seq"), "x.line", "x.a", "x.b", "x.w")


def _shortest(lines: Column, seq: Column, step: int, enough: int) -> Column:
    """How many of `lines`, which go from place `seq` on by `step`, it takes to have `enough` words; null if there are too few without a gap."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))

    def more(acc, x):
        done = (acc["s"] >= enough) | (x["seq"] != seq + step * acc["n"])
        return F.when(done, acc).otherwise(F.struct((acc["s"] + x["w"]).alias("s"), (acc["n"] + 1).alias("n")))

    return F.aggregate(lines, start, more, lambda acc: F.when(acc["s"] >= enough, acc["n"]))


def _windows(base: DataFrame, enough: int) -> DataFrame:
    """id, h, seq and size of the shortest runs with `enough` words from and up to each position.

    A line that occurs once can't lie in a repeated run, so only runs without one are windows.
    """
    held = base.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("seq", "w"))).alias("ls"))

    def both(x: Column, i: Column) -> Column:
        def up(most):
            return _shortest(F.slice("ls", i + 1, most), x["seq"], 1, enough)

        def down(most):
            return _shortest(F.reverse(F.slice("ls", F.greatest(i + 2 - most, F.lit(1)), F.least(i + 1, F.lit(most)))), x["seq"], -1, enough)

        few = min(_FEW, enough)
        sizes = [F.when(x["w"] >= enough, 1).otherwise(F.coalesce(f(few), f(enough))) for f in (up, down)]
        return F.array(F.struct(x["seq"].alias("seq"), sizes[0].alias("size")), F.struct((x["seq"] - sizes[1] + 1).alias("seq"), sizes[1].alias("size")))

    found = held.select("id", "h", F.explode(F.flatten(F.transform("ls", both))).alias("x"))
    return found.select("id", "h", "x.seq", "x.size").filter("size IS NOT NULL").distinct()


def _ranked(names: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Distinct names with their rank in sorted order (with gaps): a range sort, then the place in it."""
    return common.settle(names.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names", rows)


def _removed(keyed: DataFrame, min_words: int) -> DataFrame:
    """id, h, gone (the numbers of the lines to delete) and rows (how many repeat the document) of the documents that lose any."""
    with common.scratch(keyed.sparkSession) as keep:
        return keep(_gone(keyed, min_words), "removed")


def _gone(keyed: DataFrame, min_words: int) -> DataFrame:
    every = common.settle(_lines(keyed), "lines")
    total = every.count()
    twice = _ranked(every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["a", "b"], total)
    known = common.join_with_heavy(every, twice, ["a", "b"], "n", total).filter("name IS NOT NULL")
    # Rows that repeat a document meet here as one.
    base = common.settle(known.groupBy("id", "h", "seq").agg(F.min("name").alias("rank"), F.min("line").alias("line"), F.min("w").alias("w"), F.count(F.lit(1)).alias("rows")), "positions", total)
    windows = common.settle(_windows(base, min_words), "runs", 2 * total)
    longest = windows.agg(F.max("size")).first()[0] or 0
    level, size, k = base.select("id", "h", "seq", "rank"), 1, 0
    ranks = level.select(F.lit(0).alias("k"), "*")
    while 2 * size <= longest:
        ahead = level.select("id", "h", (F.col("seq") - size).alias("seq"), F.col("rank").alias("next"))
        pairs = level.join(ahead, ["id", "h", "seq"])
        twice = _ranked(pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["rank", "next"], total)
        found = common.join_with_heavy(pairs, twice, ["rank", "next"], "n", total).filter("name IS NOT NULL")
        level = common.settle(found.select("id", "h", "seq", F.col("name").alias("rank")), "ranks", total)
        size, k = 2 * size, k + 1
        ranks = ranks.unionByName(level.select(F.lit(k).alias("k"), "*"))
        if level.isEmpty():
            break

    windows = windows.withColumn("k", F.length(F.bin("size")) - 1)
    windows = windows.join(ranks.withColumnRenamed("rank", "r1"), ["k", "id", "h", "seq"]).withColumn("end", F.expr("seq + size - shiftleft(1, k)"))
    windows = common.settle(windows.join(ranks.select("k", "id", "h", F.col("seq").alias("end"), F.col("rank").alias("r2")), ["k", "id", "h", "end"]).select("id", "h", "seq", "size", "r1", "r2"), "windows", 2 * total)

    interval = ["size", "r1", "r2"]
    first = windows.groupBy(*interval).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "seq")).alias("first")).filter("n > 1")
    first = common.settle(first, "intervals", 2 * total)
    later = common.join_with_heavy(windows, first, interval, "n", max(1, windows.count())).filter("first IS NOT NULL")
    same = (F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h"))
    later = later.filter(~same | (F.col("seq") >= F.col("first.seq") + F.col("size")))
    gone = later.select("id", "h", F.explode(F.sequence(F.col("seq"), F.col("seq") + F.col("size") - 1)).alias("seq"))
    gone = gone.distinct().join(base.select("id", "h", "seq", "line", "rows"), ["id", "h", "seq"])
    return gone.groupBy("id", "h").agg(F.collect_list("line").alias("gone"), F.max("rows").alias("rows"))


#: Up to so many documents and numbers of lines in all are broadcast to the texts; more are shuffled with them.
BROADCAST_LINES = 1 << 20


def rewrite(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", numbers: tuple[str, str] = ("_lines", "_removed")) -> DataFrame:
    """`docs` with the repeated lines gone from its text, plus the numbers of its lines and of those removed.

    A run of lines that repeats an earlier run with `min_words` words or more loses all its lines; the
    first copy, in the order of doc_id and place, stays, with what overlaps it. Lines without a word take
    no part and stay. Null texts stay null with 0 lines; null ids come last; rows that repeat both id and
    text count as one document and are rewritten alike; a long text must fit in a task some times over; an
    empty table gives an empty table. Other columns pass through, whatever their names; `numbers` names
    the two new ones and must be free.
    """
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in numbers}:
        raise ValueError(f"the table has a column {min(taken)}: give other names for the numbers of lines")
    removed = _removed(_keyed(docs, id_col, text_col), min_words)
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.select("row", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"))
    held = removed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    if held["n"] + held["lines"] <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(removed.drop("rows")), ["id", "h"], "left")
    else:
        joined = common.join_with_heavy(rows, removed, ["id", "h"], "rows", docs.select(F.lit(1)).count())
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    # The one-element explode makes the lines and the places that stay once for each row that loses any.
    joined = joined.withColumn("x", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.struct(lines.alias("lines"), stay.alias("stay"))))))
    left = F.array_join(F.transform("x.stay", lambda i: F.col("x.lines")[i]), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns], n_lines.alias(numbers[0]), n_gone.alias(numbers[1]))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and the text that stays, for every row; cases as in `rewrite`."""
    return rewrite(common.id_and_text(docs, id_col, text_col), min_words, numbers=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", "text")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '[^\x20\x09-\x0D]')) AS pos, ls FROM d),
p AS (SELECT doc_id, text, pos, list_transform(pos, lambda i: ls[i]) AS l,
             list_transform(pos, lambda i: len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+'))) AS n FROM w),
s AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p),
u AS (
  SELECT *, list_filter(range(i, least(i + 50, len(l) + 1)), lambda j: list_sum(n[i:j]) >= 50)[1] AS up,
         list_filter(range(i, greatest(i - 50, 0), -1), lambda j: list_sum(n[j:i]) >= 50)[1] AS down FROM s),
win AS (
  SELECT DISTINCT doc_id, text, a, b, l[a:b] AS run
  FROM (SELECT doc_id, text, l, i AS a, up AS b FROM u UNION ALL SELECT doc_id, text, l, down, i FROM u)
  WHERE a IS NOT NULL AND b IS NOT NULL),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS d1, first_value(text) OVER w AS t1, first_value(b) OVER w AS b1 FROM win
                 WINDOW w AS (PARTITION BY run ORDER BY doc_id NULLS LAST, text, a))
  WHERE r > 1 AND NOT (doc_id IS NOT DISTINCT FROM d1 AND text = t1 AND a <= b1)),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS q FROM later),
cut AS (SELECT gone.doc_id, gone.text, list(p.pos[q]) AS lines FROM gone JOIN p ON p.text = gone.text AND p.doc_id IS NOT DISTINCT FROM gone.doc_id GROUP BY ALL)
SELECT documents.doc_id, coalesce(len(string_split(documents.text, chr(10))), 0) AS n_lines, coalesce(len(lines), 0) AS n_removed,
       CASE WHEN lines IS NULL THEN documents.text
            ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(documents.text, chr(10))) + 1), lambda i: NOT list_contains(lines, i)),
                                                lambda i: string_split(documents.text, chr(10))[i]), chr(10)) END AS text
FROM documents LEFT JOIN cut ON cut.text = documents.text AND cut.doc_id IS NOT DISTINCT FROM documents.doc_id
"""

import math

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, token_counts
from tessera.llm.exact_dedup import QuotientFilter

PATH = P.path("word_bpe_49k.json")


def test_token_counts(spark):
    texts = [None, "", "one", "two words", "two words", "many " * 700, *["w " * (i * 13 % 1500) for i in range(60)]]
    docs = spark.createDataFrame([(t, 1) for t in texts], "text string, n_docs int")
    lengths = [len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) for t in texts]
    out = token_counts.limits(token_counts.histogram(docs, PATH))
    rows = {r.context_limit: r for r in out.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for k, r in rows.items():
        assert r.n_docs == lengths.count(k)
        assert r.docs_within == sum(n <= k for n in lengths) and r.docs_over == sum(n > k for n in lengths)
        assert r.tokens_within == sum(n for n in lengths if n <= k) and r.tokens_over == sum(n for n in lengths if n > k)
        assert r.truncated_tokens == sum(min(n, k) for n in lengths)
        assert r.share_within == pytest.approx(r.docs_within / len(lengths))
    for limit in (0, 1, 77, 512, 10**6):
        assert token_counts.total_at(out, limit) == sum(min(n, limit) for n in lengths)
    for share in (0.01, 0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(out, share) == sorted(lengths)[math.ceil(share * len(lengths)) - 1], share
    empty = token_counts.limits(token_counts.histogram(docs.limit(0), PATH))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**58 - 1) | st.integers(0, 20), max_size=30), min_size=1, max_size=4), st.integers(0, 63))
def test_filters_merge_without_loss(parts, prefix):
    arrays = [np.array(p, np.uint64) | np.uint64(prefix << 58) for p in parts]
    filters = [QuotientFilter.unpack(QuotientFilter.build(a, skip=6).pack()) for a in arrays]
    merged = QuotientFilter.build(np.concatenate([f.fingerprints() for f in filters]), np.concatenate([f.counts for f in filters]), 6)
    keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
    assert merged.fingerprints(prefix, 6).tolist() == keys.tolist() and merged.counts.tolist() == counts.tolist()


def test_ranges_follow_the_rows(spark, monkeypatch):
    assert [exact_dedup.range_bits(n) for n in (0, 10**6, 10**9, 10**10)] == [6, 6, 10, 14]
    monkeypatch.setattr(exact_dedup, "PRINTS", 2)
    rows = [(k, f"t{k % 700}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    documents = docs.toArrow()  # noqa: F841  read by duckdb
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect())) == sorted(duckdb.sql(exact_dedup.OP6_SQL).fetchall())


def test_large_counts_survive():
    f = QuotientFilter.unpack(QuotientFilter.build(np.array([5] * 1000 + [6], np.uint64)).pack())
    assert f.fingerprints().tolist() == [5, 6] and f.counts.tolist() == [1000, 1]


ROWS = [(1, "a b"), (2, "ab "), (3, "a\n b"), (4, "a b"), (5, None), (6, ""), (7, " \t"), (None, "a b  x"), (8, "abx"), (8, "abx"), (9, "é" * 40000), (10, "é" * 40000), (11, "x\x1cy"), (12, "xy"), *[(100 + i, "hot text") for i in range(60)]]


@pytest.mark.parametrize("limit", [1 << 21, 0])
def test_dedup(spark, limit):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, group_size int").repartition(3)
    out = exact_dedup.dedup(docs, broadcast_fingerprints=limit)
    documents = docs.toArrow()  # noqa: F841  read by duckdb
    want = duckdb.sql(exact_dedup.OP6_SQL)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_dedup_of_nothing(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    """With one fingerprint for all texts, the comparison of bytes alone must find the groups."""
    docs = spark.createDataFrame(ROWS[:12], "doc_id long, text string")
    want = sorted(map(str, exact_dedup.dedup(docs).collect()))
    slim = exact_dedup.fingerprint

    def same(batch):
        out = slim(batch)
        return out.set_column(2, "print", [7] * out.num_rows).cast(out.schema)

    class Route(exact_dedup.Normalise):
        def __init__(self, _):
            pass

    monkeypatch.setattr(exact_dedup, "fingerprint", same)
    monkeypatch.setattr(exact_dedup, "Route", Route)
    assert sorted(map(str, exact_dedup.dedup(docs).collect())) == want


def test_rows_are_numbered_once(spark, tmp_path, resplit):
    rows = [(k, f"text {k % 150} {'x ' * (k % 7)}") for k in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    documents = docs.toArrow()  # noqa: F841  read by duckdb
    want = sorted(duckdb.sql(exact_dedup.OP6_SQL).fetchall())
    resplit()
    assert sorted(map(tuple, exact_dedup.dedup(docs).collect())) == want

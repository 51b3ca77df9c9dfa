import glob
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import common, packing, token_files
from tessera.llm.word_tokens import WordTokens

PATH = P.path("word_bpe_49k.json")
ORACLE = Tokenizer.from_file(PATH)
ORACLE.encode_special_tokens = True
TOKENS = WordTokens(PATH)
TEXTS = ["", " ", "It's A\x1ctest ÉCOLE é ΣΑΣ İ ſ <|endoftext|>", "x" * 300 + " y\n\nz", "1234 5.6 !!!? don't we'LL", "漢字 🙂 ﬁ Å ½", "\x00 \x85a\xa0b", "Straße ÄÖÜ"]


def ids(text):
    return ORACLE.encode(text or "", add_special_tokens=False).ids


def test_agrees_with_the_library():
    for _ in range(2):
        for text in TEXTS:
            assert np.frombuffer(TOKENS.encode(text), "<u4").tolist() == ids(text), repr(text)


def test_small_tables_are_emptied_and_grow():
    small = WordTokens(PATH, capacity=10)
    texts = [" ".join(f"word{i * k % 37}x{k}" for i in range(40)) for k in range(30)] + TEXTS + [None]
    for limit in (16, 200, 1 << 19):
        for text, got in zip(texts, small.encode_batch(texts, limit), strict=True):
            assert got.tolist() == ids(text), (limit, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n'stmdrevlAaÉß1!#<|>")), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    assert np.frombuffer(TOKENS.encode(text), "<u4").tolist() == ids(text)


ROWS = [(3, "one two three", 1), (None, "no id", 1), (1, None, 1), (2, "", 1), (3, "one two three", 1), (9, "long " * 9000, 1), (7, "Été " * 2000, 1)]


@pytest.mark.parametrize("empty", [False, True])
def test_token_files(spark, tmp_path, empty):
    docs = spark.createDataFrame([] if empty else ROWS, "doc_id long, text string, start int")
    shards = token_files.write(docs, str(tmp_path / "t"), PATH, shards=3, frame_bytes=4096)
    out = sorted(map(tuple, token_files.read(spark, shards).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text, _ in [] if empty else sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = np.array([*ids(text), 1], "<u4")
        want.append((doc_id, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert out == want
    if not empty:
        found = [(d, r) for path, *_ in shards for r in [token_files.Reader(path)] for d in r.get(9)]
        assert len(found) == 1 and found[0][0].tolist() == [*ids("long " * 9000), 1]
        assert not [f for f in glob.glob(str(tmp_path / "t/_*"))]


def saved(path, documents, frame_bytes=64):
    with open(path, "wb") as f:
        w = token_files.Writer(f, frame_bytes)
        for doc_id, n in documents:
            w.add(doc_id, np.arange(n, dtype="<u4").tobytes())
        w.close()
    return path


def test_damage_is_seen(tmp_path):
    path = saved(str(tmp_path / "x.tok"), [(i, i * 3) for i in range(20)])
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1
    open(path, "wb").write(data)
    reader = token_files.Reader(path)
    assert reader.get(15)[0].tolist() == list(range(45))
    with pytest.raises(ValueError, match="checksum"):
        list(reader.scan())
    for place, what in ((-30, "seek table"), (-50, "seek table"), (-36, "seek table"), (-1, "no token file")):
        worse = data.copy()
        worse[place] ^= 1
        open(path, "wb").write(worse)
        with pytest.raises(ValueError, match=what):
            token_files.Reader(path)


def test_only_the_frames_asked_for(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_DOCUMENTS", 4)
    documents = [(None, 2), (None, 0), (-5, 3), *[(7, k) for k in range(9)], (8, 1), (9, 100), (12, 0), (13, 1)]
    reader = token_files.Reader(saved(str(tmp_path / "y.tok"), documents))
    assert [(d, len(ids)) for d, _, ids in reader.scan()] == documents and reader.documents == len(documents) and reader.ids == sum(n for _, n in documents)
    read, frame = [], reader.frame
    reader.frame = lambda k: read.append(k) or frame(k)
    for wish in (None, -5, 7, 8, 9, 10, 12, 13, 99):
        read.clear()
        assert [len(x) for x in reader.get(wish)] == [n for d, n in documents if d == wish], wish
        assert len(read) < len(reader.frames)
    with pytest.raises(ValueError, match="after"):
        saved(str(tmp_path / "z.tok"), [(2, 1), (1, 1)])
    assert list(token_files.Reader(saved(str(tmp_path / "e.tok"), [])).scan()) == []


def test_shards_follow_the_size(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id AS doc_id", "sha2(string(id), 512) AS text").coalesce(1).write.parquet(str(tmp_path / "d"))
    rows = spark.read.parquet(str(tmp_path / "d"))
    assert token_files._shards(rows) <= 2
    monkeypatch.setattr(token_files, "SHARD_BYTES", 10_000)
    assert 10 < token_files._shards(rows) < 100
    assert token_files._shards(spark.createDataFrame([(1, "x" * 95)], "doc_id long, text string").rdd.toDF()) >= 1


def test_files_go_with_the_results(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, start int").write.parquet(str(tmp_path / "documents.parquet"))
    before = len(common._written[0])
    assert token_files.op9_token_files(spark, str(tmp_path)).count() == len(ROWS)
    (place,) = common._written[0][before:]
    assert glob.glob(place.removeprefix("file://") + "/*.tok")
    common.discard(spark)
    assert not glob.glob(place.removeprefix("file://") + "*") and not common._written[0]


def thue_morse(steps):
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("steps", [10, 11, 13])
def test_chunks_that_look_alike(steps):
    """Words that the lookup's numbers can't tell apart, in one batch and in later ones."""
    a, b = thue_morse(steps)
    body = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    assert len(set(common.span_places(body, *common.words(body)).tolist())) == 1
    tokens = WordTokens(PATH)
    for texts in ([a, b], [b], [f"x {b} y {a}", None, f"{a}{b}"]):
        assert [x.tolist() for x in tokens.encode_batch(texts)] == [ids(t) for t in texts]


def test_equal_numbers_are_told_apart():
    """With one number for all chunks, and with one for each length, the comparison of bytes decides."""
    texts = [*TEXTS, " ".join(f"w{i % 7} v{i % 5}x" for i in range(50)), "", " a b a c a"]
    for numbers in (lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: (e - s).astype(np.uint64)):
        tokens = WordTokens(PATH)
        tokens._numbers = numbers
        for _ in range(2):
            assert [x.tolist() for x in tokens.encode_batch(texts)] == [ids(t) for t in texts]


def test_a_tool_goes_when_another_is_used():
    gone = []
    common.cached_tool("a", lambda: gone.append("a"))
    common.cached_tool("b", lambda: gone.append("b"))
    for tool in ("a", "a", "b", "", "", "a", "b"):
        list(common.tidy(iter, tool)([1]))
    common.use()
    assert gone == ["a", "b", "a", "b"]
    del common._tools["a"], common._tools["b"]


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default=None: default)
        set = staticmethod(lambda key, value: None)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session, "x")
    Session.sparkContext.master = "local[2]"
    assert "tessera-x-" in common.shared_dir(Session, "x")


def test_a_chunk_much_longer_than_a_run():
    texts = ["one two", "x" * 500 + " y", "a b"]
    assert [x.tolist() for x in WordTokens(PATH).encode_batch(texts, 16)] == [ids(t) for t in texts]


def brute_fill(lengths, room):
    sums = {0}
    for n, k in lengths.items():
        sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 120))
def test_best_fill(lengths, room):
    got = packing.best_fill(lengths, room)
    assert all(0 < k <= lengths[n] for n, k in got.items())
    assert sum(n * k for n, k in got.items()) == brute_fill(lengths, room)


def check_packed(rows, table, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (_, size), parts in by_doc.items():
        spans = sorted((p.start, p.length) for p in parts)
        copies = sum(s == 0 for s, _ in spans)
        assert sum(n for _, n in spans) == copies * size
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing(spark):
    docs = spark.createDataFrame([*ROWS, *[(100 + i, "word " * (i * 37 % 900), 1) for i in range(300)]], "doc_id long, text string, start int").repartition(2)
    rows = packing.pack(docs, PATH, pool=32, keep_ids=True).collect()
    assert check_packed(rows, docs, 4096) == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        whole = np.array([*ids(texts[r.doc_id]), 2], "<u4")
        part = whole[r.start : r.start + r.length]
        assert len(whole) == r.doc_tokens and bytes(r.ids) == part.tobytes() and r.ids_crc32 == zlib.crc32(part.tobytes())
    assert packing.pack(docs.limit(0), PATH).count() == 0

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
CODER = bpe.Coder(PATH)
CASES = ["", " ", "\n", "a", "it's", "'s's 's \n's  's", "x'll've're'LL 'llama 've", "''s '' '''t", "a  b \n\n c\t\t", "1234 12a3 ½²", "  lead and trail  ", "é́ ñ漢字 　 x y", "!!! ###a###  $$$", "\x00\x1c\x85a", "word" * 500, "#" * 3000, "🙂🙃 don't", "'", " '", "l'r", "'re", "'r", "a'", " x"]


def test_agrees_with_tiktoken():
    for text, ids in zip(CASES, CODER.encode(CASES), strict=True):
        assert ids.tolist() == ORACLE.encode_ordinary(text), repr(text)
        assert CODER.decode(ids.tolist()) == text.encode()
        offsets = CODER.offsets(ids)
        assert offsets[-1] == len(text.encode())
        for i in range(0, len(ids), 7):
            assert text.encode()[offsets[i] :].startswith(CODER.bytes_of[ids[i]])


def test_ranges_decode_by_offsets():
    for text, ids in zip(CASES, CODER.encode(CASES), strict=True):
        body, offsets = text.encode(), CODER.offsets(ids)
        assert CODER.decode_at(ids, offsets) == CODER.decode_at(ids, offsets, block=3) == body
        for a in range(0, min(len(body), 30) + 2):
            for b in (a, a + 1, a + 5, a + 700):
                assert CODER.decode_at(ids, offsets, a, b, block=4) == body[a:b], (text, a, b)


def test_round_trip_decodes_by_offsets():
    class Wrong(bpe.Coder):
        def offsets(self, ids):
            return np.concatenate([[0], np.cumsum(np.roll(self.size_of[ids], 1))])

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a text of words, unlike in length"]})
    digest = lambda coder: bpe.RoundTrip(PATH)(batch, coder).column("decoded_sha256")[0].as_py()
    assert digest(CODER) == hashlib.sha256(batch.column("text")[0].as_py().encode()).hexdigest() != digest(Wrong(PATH))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'stmdrevl aAé1½!# 　漢")), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_any_text(texts):
    assert [x.tolist() for x in CODER.encode(texts)] == [ORACLE.encode_ordinary(t) for t in texts]


def test_long_pieces_merge_alike():
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=CODER.ranks, special_tokens={})
    for piece in ("abcd" * 40, "#" * 200, "".join(map(chr, range(1, 300))), "é" * 90, "ththereinon" * 30):
        assert CODER._merge_long(piece.encode()) == whole.encode_ordinary(piece)
    assert bpe.pieces(["a" * 5000])[1].tolist() == [1]


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_long_texts_go_in_parts(monkeypatch, limit):
    monkeypatch.setattr(bpe, "LONG", limit)
    texts = [*CASES, "don't stop\n\n  now, it's 12 o'clock\tor 'so' \u00e9 x" * 9, "no" * 50 + "\u6f22 \u5b57"]
    for text, parts in zip(texts, CODER.encode_in_parts(texts), strict=True):
        parts = list(parts)
        assert [i for p in parts for i in p.tolist()] == ORACLE.encode_ordinary(text), text
    assert len(list(bpe.parts_of(texts[-2]))) > 5
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = bpe.RoundTrip(PATH)(batch, CODER).to_pylist()
    for r, text in zip(out, texts, strict=True):
        want = ORACLE.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'stmdrevl aA\u00e91\u00bd!\u3000\u6f22")), max_size=60))
def test_any_text_in_parts(text):
    assert [i for part in bpe.parts_of(text, 3) for i in CODER.encode([part])[0].tolist()] == ORACLE.encode_ordinary(text)


@pytest.mark.parametrize("empty", [False, True])
def test_frame(spark, empty):
    rows = [] if empty else [(1, "it's  here\n", 5), (None, None, 6), (1, "it's  here\n", 5), (3, "", 7), (4, "x " * 30000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.round_trip(docs, PATH).collect()
    want = [(i, len(ids := ORACLE.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(str((r.doc_id, bytes(r.bytes))) for r in back) == sorted(str((i, (t or "").encode())) for i, t, _ in rows)
    for start, stop in ((3, 9), (0, 0), (5, None), (10**6, None)):
        part = bpe.decode(bpe.encode(docs, PATH), PATH, start, stop).collect()
        assert sorted(str((r.doc_id, bytes(r.bytes))) for r in part) == sorted(str((i, (t or "").encode()[start:stop])) for i, t, _ in rows)

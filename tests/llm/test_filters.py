import math
import re
import time
import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import langid, quality, urls

TEXTS = [None, "", " \n\t", "one", "a b c a b c\n", "x\x1cy z\u00a0w\n\nx\x1cy z\u00a0w\n", "ÄÖ ß 漢字 🙂 #*$%&|<>\r\n" * 30, "buy now! " * 400, "\n".join(f"line {i % 7} of words" for i in range(40)), " ".join(f"word{i}" for i in range(300)), " ".join(f"WORD{i}" for i in range(80)), " | ".join(f"w{i}" for i in range(80)), "word" * 9000 + " end"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_counts():
    for text in TEXTS:
        doc = quality.Doc(text)
        assert tuple(getattr(doc, c) for c in quality.COUNTS) == brute(text), repr(text)[:60]
    assert quality.repeat_words(np.arange(200) % 9) == 200


def test_counts_of_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "PART", 16)
    test_counts()


def test_words_with_letters_like_numerals():
    words = {"ABC": (True, True), "Abc": (False, True), "\u2167": (False, False), "\u24b6": (False, False), "\u01c5": (False, True), "\u00c9T\u00c9": (True, True), "12": (False, False), "A1\u2167": (True, True)}
    assert {w: (quality.shouts(w), quality.has_letter(w)) for w in words} == words
    for w, want in words.items():
        assert duckdb.sql(f"SELECT regexp_matches('{w}', '\\p{{Lu}}') AND NOT regexp_matches('{w}', '\\p{{Ll}}'), regexp_matches('{w}', '\\p{{L}}')").fetchall() == [want], w


@pytest.mark.parametrize("empty", [False, True])
def test_quality_frame_and_sql(spark, empty):
    rows = [] if empty else [(i if i != 3 else None, t, 1) for i, t in enumerate(TEXTS + TEXTS[4:6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = quality.judge(docs).drop("rejected_by")
    documents = docs.toArrow()  # noqa: F841  read by duckdb
    want = duckdb.sql(quality.OP3_SQL)
    assert out.columns == want.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)
    kept = quality.keep(docs)
    assert kept.schema == docs.schema and kept.count() == out.filter("kept").count()


def test_order_follows_measure():
    cascade = [quality.Rule(n, lambda d: False) for n in "abcd"]
    # d rejects most, but nothing that c leaves; a rejects little, but what c leaves
    measured = quality.Measured([1e-3, 1e-6, 1e-4, 1e-4], {0b1100: 50, 0b0100: 10, 0b0001: 5, 0: 100})
    assert [r.name for r in quality.order(cascade, measured)] == ["c", "a", "b", "d"]
    assert [r.name for r in quality.order(cascade, quality.Measured([0.0] * 4, {}))] == list("abcd")


def test_measure_finds_cost_and_rejections(spark):
    texts = [" ".join(f"word{i}" for i in range(60))] * 3 + [" ".join(f"WORD{i}" for i in range(60)), "short", None]
    slow = quality.Rule("slow", lambda d: time.sleep(0.002) or False)
    got = quality.measure(spark.createDataFrame([(t,) for t in texts], "text string"), [slow, quality.rules()[4]])
    assert got.rows == {0: 3, 2: 1} and got.seconds[0] > 0.002 > got.seconds[1]


def test_language(spark):
    texts = {"en": "the quick brown fox and the lazy dog were walking there", "de": "der schnelle braune Fuchs und der faule Hund sind schön", "fr": "le renard brun et le chien paresseux étaient là déjà"}
    rows = [(i, (t + " ") * (1 + i % 3), x, "s") for i in range(60) for x, t in texts.items()] + [(None, None, "en", "s"), (999, "123 !?", None, "s"), (998, "", "de", "s"), (997, "DER HUND UND DER FUCHS " * 3000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.learned(docs)
    assert model[0] == ["de", "en", "fr"]
    out = {(r.doc_id, r.lang_pred): r.score for r in langid.predict(docs, model).collect()}
    assert all((i, x) in out for i in range(60) for x in texts) and all(0 <= s <= 1 for s in out.values())
    assert out[(None, "und")] == out[(999, "und")] == out[(998, "und")] == 0 and (997, "de") in out
    assert langid.keep(docs, model).count() == 181 and langid.keep(docs, model).schema == docs.schema
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learned(docs.limit(0))).collect()} == {"und"}


def naive_grams(text):
    """Buckets of the n-grams, one by one."""
    symbols = []
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            symbols.append(ord(c))
        elif symbols and symbols[-1]:
            symbols.append(0)
    out = []
    for size in langid.ORDERS:
        for at in range(len(symbols) - size + 1):
            h = size * 0x27D4EB2F & 0xFFFFFFFF
            for k, x in enumerate(symbols[at : at + size]):
                h = (h ^ x) * int(langid._MIX[k]) & 0xFFFFFFFF
                h ^= h >> 15
            if any(symbols[at : at + size]):
                out.append(h % langid.BUCKETS)
    return sorted(out)


GRAM_TEXTS = ["Ab, cd", "", "x\ny", "\u0130\u00e9 12 z", "__", "a", " a", "\u039f\u0394\u039f\u03a3 \u03a3\u0391\u03a3. x-y--z  ", "\u24b6b 1\u0130", "\n\n"]


def test_grams_match_brute_force():
    doc, bucket = langid.grams(GRAM_TEXTS)
    for i, text in enumerate(GRAM_TEXTS):
        assert sorted(bucket[doc == i].tolist()) == naive_grams(text), text


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 50])
def test_long_texts_go_part_by_part(limit):
    for text in [" ".join(GRAM_TEXTS), "abc" * 40, "ab1" * 30 + " , . " * 9 + "c", "1" * 30 + "a", "a b\tc\nd  " * 9]:
        parts = [b for x in langid.long_grams(text, limit) for b in x.tolist()]
        assert sorted(parts) == naive_grams(text), (limit, text)


def test_model_against_naive_bayes(spark, monkeypatch):
    """Counts, priors and posteriors, computed text by text with dictionaries."""
    monkeypatch.setattr(langid, "CHUNK", 40)  # so that texts are long ones here
    rows = [(i, t, x) for i, (t, x) in enumerate([("the house is here", "en"), ("das Haus ist hier und da, nicht dort " * 4, "de"), ("the river", "en"), (None, "en"), ("ohne Sprache", None), ("la maison", "fr"), ("", "fr"), ("1 2", "de")])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = [(t, x) for _, t, x in rows if t is not None and x is not None]
    langs = sorted({x for _, x in held})
    counts = {x: Counter(g for t, y in held if y == x for g in naive_grams(t)) for x in langs}
    priors = Counter(x for _, x in held)
    assert model.langs == langs
    asked = ["the Haus", "hier la maison " * 30, "", "zz", "9"]
    named, scores = langid.score(asked, model, temperature=2.0)
    for text, name, got in zip(asked, named, scores, strict=True):
        logs = [sum(math.log((counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)) for g in naive_grams(text)) / 2.0 + math.log(priors[x] / len(held)) for x in langs]
        odds = [math.exp(v - max(logs)) for v in logs]
        want = (langs[logs.index(max(logs))], max(odds) / sum(odds)) if naive_grams(text) else ("und", 0.0)
        assert name == want[0] and got == pytest.approx(want[1], rel=1e-4), text
    two = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=2)
    assert two.langs == ["de", "en"] and two.priors.tolist() == pytest.approx([math.log(0.5)] * 2)


def test_languages_without_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 2.0), (2, "12", None, "b", 1.0), (3, None, None, "c", 0.0)], "doc_id long, text string, lang string, lang_pred string, score double")
    kept = langid.keep(docs, langid.learned(docs))
    assert kept.schema == docs.schema and [r.doc_id for r in kept.collect()] == [1]
    assert langid.keep(docs.limit(0), langid.learned(docs.limit(0))).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, langid.learned(docs)).collect()} == {("und", 0.0)}


def test_urls(spark):
    cases = {
        "https://A.Example.ORG/en/1x?q#f": ("a.example.org", "/en/1x", "example.org/en/1", "block"),
        "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://casino-win.com/de/a://b": ("casino-win.com", "/de/a://b", "com/de/", "block"),
        "http://m.casino-win.example.com/fr/1": ("m.casino-win.example.com", "/fr/1", "com/fr/", "allow"),
        "http://free-bets.example.net/en/5": ("free-bets.example.net", "/en/5", None, "block"),
        "http://library.example.net/en/5": ("library.example.net", "/en/5", None, "allow"),
        "http://x.org": ("x.org", "", None, "allow"),
        "http://x.org?a/b": ("x.org", "", None, "allow"),
        "ÄB://ÄB.com#x": ("Äb.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(None, "http://" + "a" * 50000 + ".org/", "h")]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    by = {r.page_id: r for r in out}
    for i, (u, want) in enumerate(cases.items()):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == want, u
    assert by[None].rule == "org/" and len(out) == len(rows)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_grams(host, path):
    """Buckets of the n-grams of host and path, one by one."""
    out = set()
    for salt, text in enumerate((host, path)):
        body = b"^" + text.encode("utf-8", "surrogatepass") + b"$"
        for size in urls.SIZES:
            for at in range(len(body) - size + 1):
                h = 8 * salt + size
                for x in body[at : at + size]:
                    h = (h ^ x) * int(urls._MULTIPLIER) & 0xFFFFFFFF
                    h ^= h >> 15
                out.add(h % urls.DIMENSIONS)
    return out


def test_url_model_against_brute_force():
    """Features, fit and verdicts, each one number at a time."""
    table = [("http://casino.example.com/en/1", True), ("http://library.example.com/en/1", False), ("https://poker.ex.org", True), ("x://\u00e4b.org/\u00e4?", False), ("none", False)]
    parts = [urls.split(u) for u, _ in table]
    row, bucket = urls.features(parts)
    sets = [url_grams(*p) for p in parts]
    assert [set(bucket[row == k].tolist()) for k in range(len(parts))] == sets and len(row) == sum(map(len, sets))
    w, b = dict.fromkeys(set().union(*sets), 0.0), 0.0
    for _ in range(40):
        errors = [(1 / (1 + math.exp(-(sum(w[f] for f in s) / math.sqrt(max(1, len(s))) + b))) - bad) / len(table) for s, (_, bad) in zip(sets, table, strict=True)]
        w = {f: v - 20.0 * (sum(e / math.sqrt(len(s)) for s, e in zip(sets, errors, strict=True) if f in s) + 1e-5 * v) for f, v in w.items()}
        b -= 2.0 * sum(errors)
    model = urls.fit(table, rounds=40)
    assert model[1] == pytest.approx(b) and np.flatnonzero(model[0]).tolist() == sorted(f for f, v in w.items() if v)
    assert all(model[0][f] == pytest.approx(v) for f, v in w.items())
    asked = [*parts, ("poker.library.org", "/q"), ("", ""), ("", "/x")]
    for p, score in zip(asked, urls.unwanted(asked, model), strict=True):
        own = url_grams(*p)
        assert score == pytest.approx(1 / (1 + math.exp(-(sum(w.get(f, 0.0) for f in own) / math.sqrt(max(1, len(own))) + b))) if p[0] else 0.0)
    assert urls.fit([])[1] == 0 and urls.unwanted([], model).tolist() == []


def test_url_model_on_names_it_has_not_seen():
    """The test tables' names are held out: none is in the labelled table."""
    held_out = ["casino-win", "free-bets", "cheap-pills", "spam-farm", "adult-x", "ads-track"]
    table = urls.labelled()
    assert not [u for u, _ in table if any(x in u for x in held_out)]
    pages = [urls.split(u) for (u,) in duckdb.sql("SELECT url FROM '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    assert not {h for h, _ in pages} & {urls.split(u)[0] for u, _ in table}
    scores = urls.unwanted(pages, urls.fit(table))
    truth = np.array([any(x in h for x in held_out) for h, _ in pages])
    blocked = scores >= 0.5
    assert (truth & blocked).sum() >= 0.85 * truth.sum() and (truth & blocked).sum() >= 0.95 * blocked.sum()


def test_url_clashing_names(spark):
    rows = spark.createDataFrame([(1, "http://a.org/x", "u", 2)], "page_id long, url string, text string, doc_id long")
    assert [tuple(r)[:5] for r in urls.judge(rows).collect()] == [(1, "a.org", "/x", "org/", "allow")]
    assert urls.judge(rows, id_col="doc_id", url_col="text").first().page_id == 2

import random
import re

import corpus_pipeline as P
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_near_join import brute as near_classes
from tests.llm.test_word_tokens import ids

from tessera.llm import common, langid, quality


def corpus():
    rng = random.Random(3)
    words = {"en": "the of and to in that with house river walking".split(), "de": "der und die nicht schön mit Haus Fluss gehen über".split()}
    rows, passage = [], " ".join(f"passage{i}" for i in range(70))
    for k in range(80):
        lang = "en" if k % 2 else "de"
        text = lambda n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefg") * rng.randint(0, 9) for _ in range(n))  # noqa: B023, E731
        body = "\n".join(text(rng.randint(20, 90)) for _ in range(3))
        rows.append((k, body if k % 5 else f"{body}\n{passage}", lang, "s", len(body)))
    copy = "\n".join(f"changed {line}" for line in rows[7][1].split("\n"))
    rows += [(206, f"a few words of its own\n{passage}", "en", "s", 0)]
    rows += [(200, copy, "en", "s", 0), (201, rows[9][1], "en", "s", 0), (202, None, "en", "s", 0), (203, "123 456", None, "s", 0), (204, "### $$$ the of " * 60, "en", "s", 0), (205, "short text", "en", "s", 0), (None, rows[11][1] + " more", None, None, None)]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns).coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.learned(docs)
    steps = {}
    for name, stage in P.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = [(r.doc_id, r.text) for r in before], [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]

    def check(name, want):
        assert sorted(map(str, steps[name][1])) == sorted(map(str, want)), name

    before, _ = steps["language_id"]
    named, scores = langid.score([t or "" for _, t in before], model)
    check("language_id", [r for r, x, s in zip(before, named, scores, strict=True) if x != "und" and s >= 0.5])
    assert {i for i, _ in before} - {i for i, _ in steps["language_id"][1]} == {202, 203}
    before, _ = steps["quality_rules"]
    kept = [r for r in before for d in [quality.Doc(r[1])] if not d.base_failed and not any(x.rejects(d) for x in quality.rules())]
    check("quality_rules", kept)
    assert 204 not in dict(kept) and 205 not in dict(kept) and len(kept) >= 80
    before, after = steps["line_dedup"]
    left = lines_left(before, 50)
    stay = [(i, t, "\n".join(left[i, t])) for i, t in before]
    check("line_dedup", [(i, new) for i, t, new in stay if new == t or len(re.findall(r"[^\x20\x09-\x0D]+", new)) >= 50])
    assert any(0 < len(new.split()) < 50 and new != t for _, t, new in stay)  # what is left of 206 is too short
    assert sum("passage5 " in t for _, t in after) == 1 and 201 not in dict(after)
    before, _ = steps["ngram_jaccard_join"]
    check("ngram_jaccard_join", [r for r, c in zip(before, near_classes(before), strict=True) if c[3]])
    assert 200 not in dict(steps["ngram_jaccard_join"][1])

    pieces = P.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in steps["ngram_jaccard_join"][1]}
    assert sum(p.length for p in pieces) == sum(len(ids(t)) + 1 for _, t in steps["ngram_jaccard_join"][1])


def written(spark):
    return [p for scope in common._written for p in scope]


def test_only_the_last_input_is_left(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    common.discard(spark)
    P.run(spark, str(tmp_path)).collect()
    assert [p for p in written(spark) if "ngram_jaccard_join" in p] == written(spark) and len(written(spark)) == 1
    common.discard(spark)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_no_labels_and_clashing_names(spark, tmp_path):
    """Columns with the names that the operators use inside pass through every stage."""
    rows = [(i, t, None, "s", 0, 7, 8, 9, "g", 1, "c") for i, t, *_ in corpus()[:30]] + [(301, "12 34", None, "s", 0, 7, 8, 9, "g", 1, "c"), (302, None, None, "s", 0, 7, 8, 9, "g", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long, _lines long, _removed long, gone string, row int, class string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert {(r._row, r._lines, r._removed, r.gone, r["class"]) for r in docs.collect()} == {(7, 8, 9, "g", "c")}
    assert 20 <= docs.count() <= 30 and P.STAGES[-1][1](spark, docs, "").count() >= 20

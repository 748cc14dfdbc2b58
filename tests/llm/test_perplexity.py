"""The perplexity model keeps every sequence, however few are broadcast."""

import random

import pytest

from keyquarry.llm import perplexity


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("aeiouübcdfglmnprst中") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(45, 110))), ["en", "de", None][i % 3]) for i in range(120)]
    rows += [(1000 + i, rows[4][1], rows[4][2]) for i in range(40)]                     # copies share their sequences
    rows += [(2000 + i, "".join(chr(33 + rnd.randrange(90)) if k % 9 else " " for k in range(900)), "en") for i in range(2)]
    rows += [(3000, None, "en"), (3001, "", None), (None, rows[7][1], "de"), (None, rows[7][1], "de")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_level_has_all_sequences(docs):
    rows, df = docs
    by: dict = {}
    for _, t, name in rows:
        by.setdefault(name or "", set()).add(t or "")
    models = {name: perplexity.KneserNey(*perplexity._merged([perplexity.ngrams(t) for t in sorted(some)])) for name, some in by.items()}
    expected = sorted((str(i), t or "", None if len((t or "").split()) < 50 else round(10_000 * models[name or ""].bits(t))) for i, t, name in rows)
    texts = {(str(i)): t or "" for i, t, _ in rows}
    for most in (400_000, 500, 0):
        found = sorted((str(r.doc_id), texts[str(r.doc_id)], r.level) for r in perplexity.judge(df, most=most).collect())
        assert found == expected


def test_rows_kept_do_not_depend_on_what_is_broadcast(docs, spark, tmp_path):
    _, df = docs
    df.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    narrow = perplexity.Limits(below=1, above=1)
    judged = perplexity.judge(df, narrow).collect()
    good = sorted(str(r.doc_id) for r in judged if r.kept)
    assert 0 < len(good) < sum(not r.base_failed for r in judged)      # rules and bands both reject rows
    for most, given, in_files in ((400_000, read, True), (500, read, True), (500, df, True), (0, read, False)):
        kept = perplexity.keep_good(given, narrow, in_files=in_files, most=most)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == good

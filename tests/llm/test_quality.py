import re
from collections import Counter

from pyspark.sql import functions as F

from flowrisk.llm.quality import Rule, base_stats, cascade_order, quality


def stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n, places = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            places.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(places))


def check(out, rows):
    want = Counter((doc_id, *stats(text)) for doc_id, text in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality(docs)
    check(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    share = {r.quality: r.share for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_order_decides_nothing_and_follows_rejections(spark, docs_of):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(12)) + (" ###" * 5 if i % 2 else "")) for i in range(200)]
    docs = docs_of(rows)
    rare, often = Rule("rare", F.col("n_words") > 10**6), Rule("often", F.col("n_symbols") > 3)
    sample = base_stats(docs.withColumn("__text", F.col("text")), "__text").cache()
    sample.count()
    assert [r.name for r in cascade_order(sample, [rare, often])] == ["often", "rare"]
    for rules in ([rare, often], [often, rare]):
        assert {r.doc_id for r in quality(docs, rules).collect() if r.kept} == set(range(0, 200, 2))


def test_odd_rows(docs_of, odd_rows):
    repeats = [(30, "a b c d e a b c d e a b c d e"), (31, "x " * 5000), (32, "l\nl\n\nl \nm"), (33, "a b c d"), (34, "a b c d e")]
    rows = [(r[0], r[1]) for r in odd_rows] + repeats
    check(quality(docs_of(rows, extra=True)).collect(), rows)
    assert quality(docs_of([])).collect() == []

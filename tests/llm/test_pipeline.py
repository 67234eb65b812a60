from collections import Counter, defaultdict

import pytest
from brute import fingerprint, groups, truth, wanted, whole

import corpus_pipeline as P
from flowrisk.llm.language import language
from flowrisk.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        after = materialize(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(steps):
    assert [name for name, _, _ in steps] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(after.schema.names == before.schema.names for _, before, after in steps[:-1])


def test_language_stage(steps):
    _, before, after = steps[0]
    kept = {r.doc_id for r in after.collect()}
    assert kept == {r.doc_id for r in language(before).collect() if r.lang_pred != "und" and r.score >= P.LEAST_SCORE}
    assert len(kept) >= 0.97 * before.count()


def test_one_of_each_group_stays(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, fingerprint(r.text)) for r in before.collect()]
    of = groups({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for doc_id, fp in rows:
        least[of[fp]] = min(doc_id, least.get(of[fp], doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())


def test_secrets_go_and_the_rest_stays(steps):
    _, before, after = steps[2]
    texts = {r.doc_id: r for r in after.collect()}
    assert len(texts) == before.count()
    for r in before.collect():
        want = r.text
        for start, value in sorted(truth(r.text), reverse=True):
            want = want[:start] + "[SECRET]" + want[start + len(value):]
        assert texts[r.doc_id].text == want and texts[r.doc_id].n_chars == len(want)


def test_mix_repeats_documents(steps):
    _, before, after = steps[3]
    size = {r.doc_id: (len(r.text.encode().split()), r.source) for r in before.collect()}
    share, taken, most = wanted(_sums(size.values())), Counter(), defaultdict(int)
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 3
    for doc_id, (n, source) in size.items():
        taken[source] += n * copies[doc_id]
        most[source] = max(most[source], n)
    assert all(abs(taken[s] - share[s]) <= most[s] for s in share)
    assert set(after.distinct().collect()) <= set(before.collect())


def _sums(sizes):
    out = Counter()
    for n, source in sizes:
        out[source] += n
    return out


def test_packing_stage_and_run(steps, spark):
    _, before, after = steps[4]
    whole(after.collect(), [(r.doc_id, r.text) for r in before.collect()])
    assert P.ORACLE_SQL is None and sorted(P.run(spark, SF).collect()) == sorted(after.collect())


def test_odd_rows(docs_of, odd_rows, spark):
    """Nulls, blanks and repeated rows pass every stage."""
    rows = [(r[0], r[1], "s1", "en") for r in odd_rows] + [(50 + i, f"the cat and the dog number {i} of them", "s2", "en") for i in range(30)]
    docs = docs_of(rows)
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, SF), f"odd-{name}")
    assert docs.count() > 0
    empty = docs_of([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).collect() == []
    mixed = P.mix_sources(spark, docs_of([(8, "repeated row")] * 4 + [(8, "other text")] + [(None, None)]), SF).collect()
    assert Counter(r.text for r in mixed) == {"repeated row": 4, "other text": 1}
    assert Counter(r.text for r in P.drop_near_duplicates(spark, docs_of([(8, "repeated row")] * 4 + [(None, None)]), SF).collect()) == {"repeated row": 1, None: 1}


def test_columns_that_clash(docs_of, spark):
    """Columns with names that the stages use themselves come through as they were."""
    from pyspark.sql import functions as F
    rows = [(i, f"the cat and the dog number {i} went over there with that thing password=Hunter2x{i}", "s1", "en") for i in range(40)] + [(99, None), (98, "")]
    names = ["__k1", "__k2", "__key", "__row", "__lang", "__score", "__sure", "__copies", "__copy", "__findings", "__candidates", "component_id", "taken", "other_3"]
    docs = docs_of(rows, extra=True).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    plain = docs_of(rows)
    for name, stage in P.STAGES[:-1]:
        docs, plain = (materialize(stage(spark, d, SF), f"clash-{name}") for d in (docs, plain))
        assert docs.columns[:5] == plain.columns and set(names) < set(docs.columns)
        assert sorted(map(str, docs.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[c] == f"{c}{r.doc_id}" for r in docs.collect() for c in names) and docs.count() > 0
    assert docs.where("size <> 'x'").count() == 0
    assert len(P.pack_sequences(spark, docs, SF).collect()) == docs.count()


def test_clean_texts_in_several_languages_stay(docs_of, spark):
    """Planted documents that mix two or three languages in similar parts; those without a letter go."""
    of = {"en": "the cat and the dog went over there with that thing", "de": "der Hund und die Katze sind nicht schön gewesen",
          "fr": "le chat est avec une autre chose dans la maison", "es": "el perro está con los otros para siempre aquí"}
    rows = [(i, t, "s", lang) for i, (lang, t) in enumerate(list(of.items()) * 20)]
    mixed = [(1000, " ".join(of[k] for k in ("en", "de"))), (1001, " ".join(of[k] for k in ("en", "de", "fr"))),
             (1002, " ".join(of[k] for k in ("fr", "es", "de") * 3)), (1003, " ".join(of.values())), (1004, "!!! 123 ---")]
    kept = {r.doc_id for r in P.identify_language(spark, docs_of(rows + [(*r, "s", None) for r in mixed]), SF).collect()}
    assert {1000, 1001, 1002, 1003} <= kept and 1004 not in kept and len(kept) == len(rows) + 4

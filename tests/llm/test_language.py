import itertools
import zlib

import numpy as np

from flowrisk.llm.language import NO_LETTER, Emissions, features, fit, identify, language, lattice, mean_marginals, stripped, training_sample, words_of


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_accuracy_on_documents_kept_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in language(docs).collect()}
    rows = docs.collect()
    assert len(out) == len(rows) and all(out[r.doc_id].held_out == held(r.doc_id) for r in rows)
    asked = [r for r in rows if r.lang is not None and held(r.doc_id)]
    right = sum(out[r.doc_id].lang_pred == r.lang for r in asked)
    assert right >= 0.97 * len(asked)
    assert all(0 <= r.score <= 1 for r in out.values())


def test_lattice_equals_all_paths():
    rng, lengths, k = np.random.default_rng(1), np.array([5, 3, 1]), 3
    emission, move, start = rng.normal(size=(9, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gamma, expected, log_z = lattice(emission, move, start, lengths)
    at, want, z_all, pairs = 0, np.zeros((9, k)), 0.0, np.zeros((k, k))
    for n in lengths:
        e, total = emission[at:at + n], 0.0
        marg, two = np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = np.exp(start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, y in enumerate(path):
                marg[i, y] += p
            for a, b in zip(path, path[1:]):
                two[a, b] += p
        want[at:at + n], z_all, pairs, at = marg / total, z_all + np.log(total), pairs + two / total, at + n
    assert np.allclose(gamma, want) and np.allclose(expected, pairs) and np.isclose(log_z, z_all)


def test_words_of_code_switched_text():
    sample = [("the cat and the dog went over there with that thing", "en"), ("der Hund und die Katze sind nicht schön gewesen", "de")] * 20
    model = fit(sample)
    emissions, words = Emissions(model), b"the dog and the thing und die Katze nicht".split()
    at = emissions.indexes([words])[0]
    gamma, _, _ = lattice(emissions.rows[at][:, :2], model.transition, model.start, np.array([9]))
    assert [model.labels[k] for k in gamma.argmax(axis=1)] == ["en"] * 5 + ["de"] * 4
    assert (model.transition.diagonal() > model.transition[[0, 1], [1, 0]]).all()
    mean = mean_marginals(emissions.indexes([words, [], [b"123"]]), model, emissions)
    assert mean[0].min() > 0.3 and not mean[1:].any() and features(stripped(b"12!")) == {NO_LETTER}


def test_odd_rows(docs_of, odd_rows):
    labelled = [(100 + i, "the cat and the dog", "s", "en") for i in range(20)] + [(200 + i, "der Hund und die Katze", "s", "de") for i in range(20)]
    rows = [(*r[:2], "s", None) for r in odd_rows]
    out = language(docs_of(rows + labelled, extra=True)).collect()
    assert len(out) == len(rows) + 40
    by = {r.doc_id: r for r in out}
    for i in (1, 2, 3, 10):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[100].lang_pred == "en" and by[200].lang_pred == "de" and by[5].lang_pred in ("en", "de")
    assert language(docs_of([])).collect() == []
    assert {r.lang_pred for r in language(docs_of(rows)).collect()} == {"und"}


def test_only_learns_from_labels_it_may_see(docs_of):
    rows = [(i, "der Hund und die Katze", "s", "xx" if held(i) else "de") for i in range(60)]
    assert {r.lang_pred for r in language(docs_of(rows)).collect()} == {"de"}


def test_identify_keeps_columns(docs_of):
    model = fit([("the cat", "en"), ("der Hund", "de")] * 10)
    docs = docs_of([(1, "the cat"), (None, None)])
    assert identify(docs, model).columns == [*docs.columns, "lang_pred", "score"]


def test_every_character_of_unspaced_text_counts(docs_of):
    """Japanese inside ends of another script: the whole run decides, not its first and last characters."""
    ja, zh = "これはとてもながいぶんしょうです", "我们今天在学校里学习中文的语法"
    model = fit([(ja * 8, "ja"), (zh * 8, "zh")] * 10)
    text = zh * 2 + ja * 40 + zh * 2
    out = identify(docs_of([(1, text), (2, "\u00a0".join(["これは", "とても"] * 30))]), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "ja", 2: "ja"}
    pieces = [p.decode() for p in words_of("ab " + text + " cd")]
    assert pieces[0] == "ab" and pieces[-1] == "cd" and max(map(len, pieces)) <= 22
    whole = pieces[1] + "".join(p[2:] for p in pieces[2:-1])
    assert whole == text and words_of("-" * 50 + "word") == [b"-" * 50 + b"word"]


def test_sample_brings_windows_only(docs_of):
    free = [i for i in range(60) if not held(i)]
    rows = [(i, f"word{i} " * 30_000, "s", "en") for i in free[:20]] + [(i, "kurz und gut", "s", "de") for i in free[20:24]] + [(free[25], "漢" * 90_000, "s", "zh")]
    got = training_sample(docs_of(rows), 5, "doc_id", "text", "lang")
    assert sorted(lang for _, lang in got) == ["de"] * 4 + ["en"] * 5 + ["zh"]
    assert all(len(words_of(t)) == (3 if lang == "de" else 200) for t, lang in got) and max(len(t) for t, _ in got) < 5_000

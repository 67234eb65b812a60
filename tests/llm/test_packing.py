
import numpy as np
from tokenizers import Tokenizer

from brute import whole

from flowrisk.llm.packing import Encoder, FirstFit, pack_documents, sequences, write_sequences
from flowrisk.llm.queries import VOCABULARY


def test_pack_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pack_documents(docs, VOCABULARY)
    out = packed.collect()
    whole(out, [(r.doc_id, r.text) for r in docs.collect()])
    sums = sequences(packed).collect()
    used, padded = sum(s.tokens for s in sums), sum(s.padded for s in sums)
    assert padded - used <= 0.02 * used + 4096
    assert sorted(packed.collect()) == sorted(out)
    write_sequences(packed, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == len(out)


def test_first_fit_equals_a_scan():
    rng, free, bins = np.random.default_rng(1), [], FirstFit(4096, 500)
    for n in sorted(rng.integers(1, 4097, 500).tolist(), reverse=True):
        k = next((i for i, f in enumerate(free) if f >= n), len(free))
        free += [4096] * (k == len(free))
        assert bins.put(n) == (k, 4096 - free[k])
        free[k] -= n


def test_odd_rows(docs_of, odd_rows):
    out = pack_documents(docs_of(odd_rows, extra=True), VOCABULARY, group_docs=4).collect()
    whole(out, [(r[0], r[1]) for r in odd_rows])
    assert [p.length for p in out if p.doc_id == 1] == [1]
    assert pack_documents(docs_of([]), VOCABULARY).collect() == []


def test_words_give_the_ids_of_the_text():
    tokenizer, encoder = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    text = ("plain, words. and more!? don't it's 42nd été straße ÉTÉ éte naïve?! ÿ ß the.the ... , a,b c.d x_y <|endoftext|> <|ENDOFTEXT|> "
            " odd space z\u0085w ªº µm ﬁne Ǆ 漢字 😀😀 İstanbul ΣΑΣ don't. l'été: (word) ́lone a­b")
    words = text.encode().split()
    encoder.learn(set(words))
    encoder.learn(set(words) | {b"again,", b"again"})
    assert list(np.frombuffer(b"".join(encoder.seen[w] for w in words), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids
    encoder.learn(set())

from flowrisk.llm.queries import VOCABULARY
from flowrisk.llm.token_counts import END, Automaton, token_counts, vocabulary

PIECES = set(vocabulary(VOCABULARY))
LONGEST = max(map(len, PIECES))


def greedy(word):
    symbols, at, n = (*word, END), 0, 0
    while at < len(symbols):
        size = next((k for k in range(min(LONGEST, len(symbols) - at), 0, -1) if symbols[at:at + k] in PIECES), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_automaton_needs_links():
    pieces = [tuple(p) for p in (b"a", b"ab", b"abcd", b"bc", b"c", b"cde")] + [(END,)]
    automaton = Automaton(pieces)
    assert automaton.count(b"abcd") == 2 and automaton.count(b"abcc") == 4
    assert automaton.count(b"abz") == 1 and automaton.count(b"") == 0 and automaton.count(b"abcde") == 1


def test_counts_equal_greedy_matching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in token_counts(docs, VOCABULARY).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = r.text.encode().lower().split()
        assert (got[r.doc_id].n_words, got[r.doc_id].n_bytes) == (len(words), len(r.text.encode()))
        assert got[r.doc_id].n_tokens == sum(map(greedy, words))


def test_odd_rows(docs_of, odd_rows):
    out = token_counts(docs_of(odd_rows, extra=True), VOCABULARY).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 0 and by[3].n_bytes == 4
    assert by[2**60].n_words == 5 and by[5].n_words == 60_000
    assert token_counts(docs_of([]), VOCABULARY).collect() == []

"""Brute-force forms that several test files hold results against."""

import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from flowrisk.llm.queries import VOCABULARY


def wanted(size_of):
    """Targets by repeated sharing."""
    names = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(size_of.values())
    while True:
        left = total - sum(3 * size_of[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        share = {s: 3.0 * size_of[s] if s in full else left * weight[s] / free for s in names}
        over = {s for s in names if s not in full and share[s] > 3 * size_of[s]}
        if not over:
            return share
        full |= over


def whole(out, rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = defaultdict(list)
    for doc_id, text in rows:
        ids[doc_id].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    pieces, bins = defaultdict(list), defaultdict(list)
    for p in out:
        pieces[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
    assert pieces.keys() == ids.keys()
    for doc_id, texts in ids.items():
        want = sorted((s, len(t[s:s + 4096]), zlib.crc32(t[s:s + 4096].tobytes()), len(t)) for t in texts for s in range(0, len(t), 4096))
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc_id]) == want
    for parts in bins.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


FORMS = [r"(?<![A-Za-z0-9+/_-])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9+/_-])", r'token = "([0-9a-f]{40})"', r"password=([0-9a-f]{18})(?![A-Za-z0-9+/_-])"]

def truth(text):
    """(start, value) of the forms of secret that the tables hold."""
    return [(m.start(1), m.group(1)) for form in FORMS for m in re.finditer(form, text)]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """Smallest reachable value of each, by search over all pairs."""
    left, of = set(values), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        found = list(todo)
        while todo:
            x = todo.pop()
            near = [y for y in left if linked(x, y)]
            left.difference_update(near)
            todo += near
            found += near
        of.update(dict.fromkeys(found, min(found)))
    return of

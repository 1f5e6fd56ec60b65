"""Source divergence: pointer sort against Python's, whole results against a plain restatement."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from auditlake.llm import divergence
from auditlake.llm.divergence import sorted_pointers, source_divergence, token_starts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("small", [1, 4, 512, 1 << 14])
def test_pointers_are_sorted(monkeypatch, small):
    monkeypatch.setattr(divergence, "SMALL", small)
    rng = random.Random(small)
    words = ["a", "A", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 9, "abcdefgh" * 9 + "z", "é", "日本語", "🙂", "Zz", "aÉ", "x" * 500]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(80)] + ["", None, "…", "a1b2_c", "end", "start"]
    data, at, length, row = token_starts(pa.array(texts).slice(1))
    got = [(int(r), data[a : a + n].tobytes().decode()) for r, a, n in zip(row, at, length)]
    want = [(r, t) for r, text in enumerate(texts[1:]) for t in TERM.findall(lowered(text))]
    assert got == want
    order, heads = sorted_pointers(data, at, length)
    terms = [got[i][1] for i in order]
    assert order.tolist() == sorted(range(len(got)), key=lambda i: (got[i][1].encode(), i))
    assert heads.tolist() == [i == 0 or terms[i] != terms[i - 1] for i in range(len(terms))]


def plain(rows, least, top):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(lowered(text))
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        mine = {s: c for (la, s), c in groups.items() if la == lang}
        whole = sum(mine.values(), Counter())

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return [1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept]

        p, q = {s: shares(c) for s, c in mine.items()}, shares(whole)
        for s in mine:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o]))) for o in mine if o != s]
            terms = [(t, a - b) for t, a, b in zip(kept, p[s], q) if mine[s][t] and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items) if part == "pair" or r < top]
    return sorted(out)


@pytest.mark.parametrize("block_rows, cells", [(200_000, 1 << 21), (7, 9)])
def test_divergence(spark, make_docs, monkeypatch, block_rows, cells):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rng = random.Random(8)
    vocab = ["the", "The", "of", "é", "日本", "rare", "x" * 40, *[f"w{c}" for c in "abcdefghijklmnop"]]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "b", "c", None])
        rows.append((" ".join(rng.choices(vocab, k=rng.randint(0, 40))), lang, source))
    rows += [(None, "en", "a"), ("", "xx", "only"), (None, None, "z"), ("the of", "yy", "p"), ("12 34", "yy", "q"), rows[0], rows[0]]
    rows += [("word " * 3000, "en", "hot")] * 3
    docs = make_docs([(i, t, la, s) for i, (t, la, s) in enumerate(rows)])
    got = sorted(tuple(r) for r in source_divergence(docs, 6, 5).collect())
    want = plain(rows, 6, 5)
    assert got == want and {"pair", "term"} == {r[2] for r in got}
    assert (np.array([r[4] for r in got if r[0] == "yy"]) == 0).all()


def test_no_documents(spark, make_docs):
    assert source_divergence(make_docs([])).collect() == []

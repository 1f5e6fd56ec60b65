from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from auditlake.llm.lines import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, most_docs, least_left):
    docs = defaultdict(set)

    def normal(text):
        text = re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub(r"[0-9]+", "0", (text or "").lower()))
        return [x.strip(" ") for x in text.split("\n")]

    for i, text, _, source in rows:
        for line in normal(text):
            docs[source, line].add((i, source, text))
    out = []
    for i, text, _, source in rows:
        words = WORD.findall(text or "")
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        again = {p for k, w in enumerate(windows) if count[w] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        lost = sum(len(x.split(" ")) for x in normal(text) if x and len(docs[source, x]) > most_docs)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        out.append((
            i, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(again), failed, lost, not failed and len(words) - lost >= least_left * len(words),
        ))
    return sorted(out, key=repr)


def test_rows(spark, make_docs):
    rng = random.Random(6)
    lines = ["Shared  line number %d" % k for k in range(5)] + ["the end", "a b c a b c", " \t ", "", "É ß # | x", "w " * 60]
    rows = []
    for i in range(300):
        own = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randint(1, 40))) for _ in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(rng.sample(own + rng.choices(lines, k=rng.randint(0, 6)), k=len(own))), "en", rng.choice(["a", "a", "b", None])))
    rows += [(900, None, None, None), (901, "", "en", "a"), (None, rows[1][1], "en", "a"), rows[2], rows[2], (902, "one two three four " * 9000, "en", "a")]
    rows += [(903, "\x0b a\x0cb\r c \n\n", "en", "b")]
    docs = make_docs(rows).repartition(3)
    got = line_quality(docs, most_docs=8, least_left=0.5).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 8, 0.5)
    assert line_quality(docs.limit(0)).collect() == []
    plan = line_quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

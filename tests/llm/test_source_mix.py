"""Words that the pipeline keeps of each source against the mix's targets."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from auditlake.llm.mixing import mix, whole_copies


def test_kept_words_follow_the_targets(spark, make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(150, 600)), "en", f"s{i % 6}") for i in range(900)]
    docs = make_docs(rows)
    plan = mix(docs).collect()
    target = {r.source: r.target for r in plan}
    taken = Counter()
    for r in plan:
        taken[r.source] += r.taken
    kept = Counter()
    for r in corpus_pipeline.source_mix(spark, docs, "").collect():
        kept[r.source] += len(r.text.split())
    for source, words in target.items():
        assert abs(kept[source] - words) <= 700 < 0.05 * words, (source, kept[source], words)
        assert abs(kept[source] - taken[source]) <= 600
    assert all(0 <= r.times - r.taken // r.size <= 1 and r.times <= 3 for r in whole_copies(mix(docs)).collect())

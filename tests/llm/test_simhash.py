from __future__ import annotations

import random

import xxhash

from auditlake.llm.simhash import chain_holds, fingerprint, near_duplicates, near_links
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit=2):
    """Union by all pairs."""
    lowest = {p: p for p in prints}

    def root(p):
        while lowest[p] != p:
            p = lowest[p]
        return p

    for a in prints:
        for b in prints:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= limit:
                x, y = sorted((root(a), root(b)))
                lowest[y] = x
    return {p: root(p) for p in prints}


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_fingerprint():
    rng = random.Random(1)
    for text in [None, "", " \n", "A", "a b", "É B c D", "x y z\tq", *(" ".join(rng.choices("abc de fG".split(), k=k)) for k in range(1, 40))]:
        assert fingerprint(text) == signed(plain_fingerprint(text))


def test_links_connect_what_all_pairs_connect(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:30]:  # chains and dense groups
        for _ in range(12):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(p)
    hot = rng.getrandbits(64)
    prints |= {hot ^ (1 << i) ^ (1 << j) for i in range(20, 40) for j in range(20, 40) if i <= j}
    prints = sorted(map(signed, prints))
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    for bucket in (4, 64):
        from auditlake.llm.common import components

        links = near_links(frame, bucket=bucket)
        assert links.where("bit_count(a ^ b) > 2").count() == 0
        got = {r.node: r.component for r in components(links).collect()}
        groups, want = {}, plain_components(prints)
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
        for members in groups.values():
            assert {got.get(p, p) for p in members} == {min(members)}


def test_chain_never_loses_a_near_pair(spark):
    rng = random.Random(9)
    rows = [(signed(sum(1 << b for b in rng.sample(range(64), k))),) for k in (0, 1, 2) for _ in range(300)]
    x = spark.createDataFrame(rows, "x bigint")
    some = F.lit(False)
    for start in range(7):
        some = some | chain_holds(F.col("x"), start, 7, 2)
    assert x.where(~some).count() == 0


def test_documents(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d", "en", "s"), (3, "A b\nc d", "en", None), (9, None, None, None), (7, "  ", None, "s"), (None, "a b c d", "en", "s"), (None, "q r s", "en", "s"), (2, long, "en", "s"), (4, long + " tail", "en", "s"), (4, long + " tail", "en", "s")]
    got = {(r.doc_id, r.fp): r.component_id for r in near_duplicates(make_docs(rows)).collect()}
    fp = lambda t: signed(plain_fingerprint(t))
    assert got[5, fp("a b c d")] == got[3, fp("a b c d")] == got[None, fp("a b c d")] == 3
    assert got[9, 0] == got[7, 0] == 7
    assert got[None, fp("q r s")] is None
    assert got[4, fp(long + " tail")] == 2
    assert near_duplicates(make_docs(rows)).count() == len(rows)
    assert near_duplicates(make_docs(rows).limit(0)).count() == 0

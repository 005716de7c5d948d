import random
from itertools import combinations

import xxhash
from memlake.llm import neardup


def slow_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in prints}


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r["doc_id"]: slow_print(r["text"]) for r in docs.collect()}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in neardup.op10_near_duplicates(docs).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def dense_prints(seed, n=3000):
    """Fingerprints that differ in few places, so that buckets are crowded and chains are long."""
    rng = random.Random(seed)
    spots = rng.sample(range(64), 14)
    return sorted({sum(rng.getrandbits(1) << s for s in spots) for _ in range(n)} | {1 << 63, (1 << 63) | 1, 0})


def test_links_miss_nothing_in_crowded_buckets(spark):
    prints = dense_prints(1)
    signed = [neardup._signed(x) for x in prints]
    got = {tuple(r) for r in neardup.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(min(p), max(p)) for p in combinations(signed, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 2}
    assert got == want


def test_masks_cover_all_pairs_and_bound_buckets():
    rounds = neardup.masks(2)
    for made in rounds:
        for bits in combinations(range(64), 2):
            assert any(not any(m >> b & 1 for b in bits) for _, _, m in made)
    assert all(64 - bin(m).count("1") <= 6 for _, _, m in rounds[-1])


def test_components_of_chains(spark):
    rng = random.Random(3)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(1000, 1001), (1001, 1002), (2000, 2000)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in chain} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_nulls_and_keep_one(spark):
    rows = [(3, "a b c d"), (1, "A  b\tc d"), (2, None), (5, " \n"), (5, " \n"), (None, "z z"), (None, "z z"), (9, "long " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted((r["doc_id"], r["component_id"]) for r in neardup.op10_near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == [(1, 1), (2, 2), (3, 1), (5, 2), (5, 2), (9, 9)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect() if r["text"]) == [(-1, "z z"), (-1, "z z"), (1, "A  b\tc d"), (9, "long " * 5000)]
    assert neardup.op10_near_duplicates(docs.limit(0)).count() == 0 and neardup.keep_one(docs.limit(0)).count() == 0

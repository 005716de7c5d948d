"""The near-duplicate stage against brute force on all pairs."""

import random
from itertools import combinations

import corpus_pipeline
from memlake.llm import neardup


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_kept(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def test_small_table_loses_its_edited_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = slow_kept(texts)
    assert {1, 6} <= want and not {177, 145} & want  # edited copies, 11 and 7 bits of SimHash away
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want


def test_edits_around_the_limit_in_crowded_text(spark):
    """Copies with 1 to 12 words changed, cut or added, some sharing a long common head, and chains of them."""
    rng = random.Random(5)
    head = [f"h{k}" for k in range(60)]
    texts, now = {}, 0
    for k in range(40):
        words = (head if k % 2 else []) + [f"w{k}_{j}" for j in range(rng.choice([4, 5, 6, 25, 80, 200]))]
        texts[now] = " ".join(words)
        now += 1
        for _ in range(rng.randrange(5)):
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**9)}"] * rng.randrange(2)
                words = words or ["x"]
            texts[now] = " ".join(words).upper() if now % 3 == 0 else " ".join(words)
            now += 1
    texts |= {now: None, now + 1: " \n", now + 2: " ".join(head), now + 3: " ".join(head[:-1])}
    want = slow_kept(texts)
    assert 40 < len(want) < len(texts) - 10
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_one(docs).collect()} == want


def test_long_texts_have_short_prefixes_and_lose_no_link(spark):
    """Chains and stars of edited copies of long texts, half of them with a long passage that all have."""
    rng = random.Random(11)
    passage, texts = [f"p{k}" for k in range(400)], {}
    for k in range(25):
        words = (passage if k % 2 else []) + [f"w{k}_{j}" for j in range(rng.choice([300, 900]))]
        for n in range(12):
            texts[len(texts)] = " ".join(words)
            changed = [w if rng.random() > (0.004, 0.02)[k % 2] else f"x{rng.randrange(10**9)}" for w in words]
            words = changed if n % 3 else words
    want = slow_kept(texts)
    assert 25 <= len(want) < len(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.keep_one(docs).collect()} == want
    h = neardup.shingle_hashes(texts[299], 5)
    none = neardup.np.empty(0, neardup.np.uint64)
    short, wide = neardup.prefix(neardup.np.unique(h), none, none)
    assert wide and len(short) == neardup.enough(25) < 50 and neardup.enough(60) > 80

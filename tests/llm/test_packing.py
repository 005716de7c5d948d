import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from memlake.llm import packing
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def lay(counts, capacity):
    """The bins that a plan's runs stand for: bin -> [(offset, length)]."""
    runs, bins = packing.plan(counts, capacity)
    seen, out = Counter(), defaultdict(list)
    for length, first, pieces, a_bin, each, offset in runs:
        assert first == seen[length]
        seen[length] += pieces
        for k in range(pieces):
            out[a_bin + k // each].append((offset + k % each * length, length))
    assert seen == Counter({k: v for k, v in counts.items() if v})
    assert set(out) == set(range(bins))
    for held in out.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return out


def test_plans_are_gapless_and_tight():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 64, 300])
        counts = {rng.randint(1, capacity): rng.randint(0, 40) for _ in range(rng.randint(0, 60))}
        bins = lay(counts, capacity)
        total = sum(n * c for n, c in counts.items())
        if total > 40 * capacity and min(counts) * 6 < capacity:
            assert len(bins) <= 1.25 * (total / capacity) + 1 or max(counts) * 2 > capacity


def test_matching_takes_the_longest_partner():
    bins = lay({7: 1, 6: 1, 5: 1, 4: 2}, 11)
    assert sorted(sorted(n for _, n in b) for b in bins.values()) == [[4, 7], [4], [5, 6]] or len(bins) == 3


def test_ids_are_the_librarys():
    library, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    texts = [
        "", " ", "Hello, World. It's 'tis we'll 12,5 3.14!", "Éçou ß Straße ÀÉ é áb. ́x", "a b c\x1cd\x0be　f", "ΣΑΣ ΟΔΟΣ.", "İstanbul",
        "x<|endoftext|>y <|STARTOFTEXT|>", "日本語。テスト, ok.", "....,,, a., .b ,", "tab\tline\r\nnext", "🙂👍🏽 é.", "ǅ ﬁ ª º ² ½", "a\x00b‍c", "don't DON'T 's", "﻿abc", "ªb., ªb.",
    ]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    rng = random.Random(2)
    alphabet = "abzABZ éÉßñ.,'!|<>-_0 9\n\t́ΣσİıſK­ 日"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_combined_letters_are_the_librarys():
    library, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    rng = random.Random(4)
    letters, marks = "ATHJWYÅ\u1e97tjwyK\u03a5\u0399", "\u0308\u0331\u030c\u030a\u0301\u0323\u0345"
    texts = ["T\u0308", "H\u0331adith", "J\u030c", "W\u030a"]
    texts += ["".join(rng.choice(letters) + rng.choice(marks) * (rng.random() < 0.6) + rng.choice(["", " ", ".", "b"]) for _ in range(rng.randint(1, 5))) for _ in range(30_000)]
    for text, made in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own(text), "<u4").tolist() == made.ids, ascii(text)


def test_ids_stay_the_same_when_chunks_are_forgotten(monkeypatch):
    library, own = Tokenizer.from_file(PATH), packing.WordIds(PATH)
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    rng = random.Random(9)
    for _ in range(200):
        text = " ".join(f"word{rng.randrange(40)}" + rng.choice(["", ".", ","]) for _ in range(12))
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.known) + len(own.before) < 60


def test_other_vocabularies_go_to_the_library_whole():
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    own, text = packing.WordIds(other), "Two  words,\n and A line."
    assert not own.by_chunk and packing.WordIds(PATH).by_chunk
    assert np.frombuffer(own(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.op4_packing(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    for d in docs.collect():
        ids = np.array([*library.encode(d["text"], add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in own) == len(ids)


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "word " * 9000, 1), (None, "word " * 9000, 1)], "doc_id long, text string, rank int")
    got = packing.pack_documents(docs, PATH).collect()
    assert Counter(r["length"] for r in got) == Counter({1: 2, 2048: 8, 809: 2})
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.op4_packing(docs.limit(0), PATH).count() == 0


def test_places_are_the_same_by_both_ways_and_no_piece_is_shuffled(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    pieces = packing.token_pieces(docs, PATH).drop("ids")
    made = []
    for most in (packing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(packing, "BROADCAST_BYTES", most)
        placed = packing.place(pieces)
        plan = placed._jdf.queryExecution().sparkPlan().toString()
        assert ("Join" in plan) == (not most)
        made.append(sorted(map(tuple, placed.collect())))
    assert made[0] == made[1] and len(made[0]) == pieces.count()


def test_what_a_worker_remembers_is_dropped_by_another_operator():
    packing.turn_to("packing")
    packing.word_ids(PATH)("some words")
    packing.turn_to("packing")
    assert PATH in packing._LOADED
    packing.turn_to("langid")
    assert not packing._LOADED

import hashlib
import random
import re

from memlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, body in items:
            v = words(body)
            n = min(10, len(v))
            for j in range(len(v) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add(str(item_id) if item_id is not None else "")
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["É", "é", "one", "Two", "3", "ab", "日本"]
    say = lambda n: rng.choice([" ", "-", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([10, 11, 14, 25, 40]))) for i in range(25)]
    items += [(100, say(3)), (101, say(7)), (102, "unheard"), (103, None), (104, "..."), (None, say(12)), (25, items[0][1]), (0, say(13)), (7, "same " * 30)]
    docs = [(None, None), (1, ""), (1, ""), (2, "same " * 9), (3, "same " * 50 + say(20)), (4, "unheard")]
    for k in range(60):
        t = items[rng.randrange(25)][1].split(" ")
        at = rng.randrange(max(1, len(t) - 5))
        docs.append((10 + k, say(rng.randint(0, 30)) + " " + " ".join(t[at : at + rng.randint(5, 30)]).upper().replace("É", "é") + " " + say(rng.randint(0, 300))))
        docs.append((10 + k, say(5) + " ; " + " ".join(t)))
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, w string, k1 int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sorted(map(tuple, decontam.op5_decontamination(d, b).collect()), key=str) == want
    assert sum(r[5] for r in want) > 40
    clean = decontam.keep_clean(d, b)
    assert clean.columns == d.columns
    hit = {t for t in (r[1] for r in docs) if brute([(0, t)], items)[0][5]}
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in clean.collect()))) == sorted(str(r) for r in docs if r[1] not in hit)


def test_spans_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "x " + " ".join("abcdefghijkl") + " y " + " ".join("abcdefghij"))], "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join("abcdefghijkl"))], "item_id long, text string")
    (r,) = decontam.contamination(d, b).collect()
    assert [tuple(s) for s in r["spans"]] == [(1, 12), (14, 10)] and r["n_hit"] == 22 and r["items"] == ["5"]
    assert decontam.op5_decontamination(d.limit(0), b).count() == 0
    (r,) = decontam.op5_decontamination(d, b.limit(0)).collect()
    assert (r["n_hit"], r["contaminated"]) == (0, False)
    assert decontam.keep_clean(d, b.limit(0)).count() == 1

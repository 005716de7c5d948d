import hashlib
import random
from collections import defaultdict

import public_tokenizers
from memlake.llm import chat
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))

SAY = ["\\### Assistant: </turn> ok", "", None, "a\nb", "\\", "<", "</turn", "####", "\\n </turn>\n### user\n", "word " * 300, "<<</turn>>>", "é 日本 " * 20]


def expect(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, *t[2:]))
        all_, loss = [(t[3], t[5]) for t in turns], "".join(t[5] for t in turns if t[3] == "assistant")
        out[conv] = (len(all_), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in all_).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows(seed):
    rng = random.Random(seed)
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 30)):
            role = "system" if turn == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", "tool\n\\x", None, "system"])
            out.append((conv, turn if rng.random() > 0.05 else None, role, rng.choice(SAY)))
    return out + out[:3]


def test_round_trip(spark):
    data = rows(1)
    table = spark.createDataFrame([(*r, 1, "w") for r in data], "conv_id long, turn long, role string, text string, window int, spans string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op9_chat(table, PATH).collect()}
    want = expect([*data, (-7, 0, "user", SAY[0]), (-7, 1, "assistant", SAY[0])])
    assert got == want


def test_windows_keep_budget_system_and_history(spark):
    data = rows(2)
    table = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = chat.format_conversations(table, PATH, budget=700, history=2).collect()
    by = defaultdict(list)
    for w in windows:
        by[w["conv_id"]].append(w)
    several, library = 0, Tokenizer.from_file(PATH)
    for held in by.values():
        assert [w["window"] for w in held] == list(range(len(held)))
        first = chat.parse(held[0]["text"])
        for w in held:
            turns = chat.parse(w["text"])
            new = len(turns) - w["repeated"]
            assert new >= 1
            assert len(library.encode(w["text"], add_special_tokens=False).ids) <= 700 or new == 1
            if w["window"] and first[0][0] == "system":
                assert turns[0][:2] == first[0][:2]
            assert w["repeated"] <= 3
            assert [tuple(s) for s in w["spans"]] == [(a, b) for role, _, a, b in turns[w["repeated"] :] if role == "assistant"]
        several += len(held) > 1
    assert several > 20


def test_whole_table_and_empty(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    data = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op9_chat(table, PATH).collect()}
    assert got == expect([*data, (-7, 0, "user", SAY[0]), (-7, 1, "assistant", SAY[0])])
    assert [r["conv_id"] for r in chat.op9_chat(table.limit(0), PATH).collect()] == [-7]


def test_escapes():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "#", "###", "</turn>", "<", "/turn>", "n", "\n", "é"]) for _ in range(rng.randint(0, 12)))
        made, a, b = chat.format_turn("r" + text, text)
        assert chat.unescape(made[a:b]) == text
        assert [x[:2] for x in chat.parse(made + made)] == [("r" + text, text)] * 2


def test_very_long_turn(spark):
    said = "a < b \\ " * 200_000 + "日" * 1000
    table = spark.createDataFrame([(1, 0, "user", said), (1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op9_chat(table, PATH).collect()}
    assert got[1] == expect([(1, 0, "user", said), (1, 1, "assistant", said)])[1]
    assert chat.count_tokens("日" * 1000, PATH) > 500

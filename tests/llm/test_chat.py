import hashlib

from readloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t if t is not None else 1 << 63, r or "", x or ""))
    return {c: sorted(v) for c, v in by.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    for r in chats.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        assert got[r.conv_id].formatted_chars == len(r.formatted)
    return {r.conv_id: r.formatted for r in chats.collect()}


ODD = ["", "<", "|", "<|", "\\", "\\|", "<\\|", "<|end|>", "<|next|>x<|text|>", "a\\", "</s>[INST] ok [/INST]", "\n\n", "é😀" * 3, None, "$1 \\1"]


def test_round_trip_of_odd_texts(spark):
    rows = [(k % 5, k // 5, ["user", "assistant", "assistant", None, "<|x", "a\\"][k % 6], ODD[k % len(ODD)], "clash") for k in range(120)]
    check(spark, rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None, None), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "assistant", "z", ""), (1, 0, "assistant", "b", "")]
    out = check(spark, rows)
    assert out[1] == "<|turn|>assistant<|text|>b<|end|><|turn|>user<|text|>a<|next|>a<|end|><|turn|>assistant<|text|>z<|end|>"


def test_hot_conversation_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "HOT_TURNS", 10)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 4)
    check(spark, [(7, k, "user" if k % 7 < 3 else "assistant", f"t{k}", "") for k in range(50)] + [(8, 0, "user", "x", "")])


def test_empty_table(spark):
    assert chat.digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0

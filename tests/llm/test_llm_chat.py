import hashlib
import random

from stackloom.llm import chat

PARTS = ["\\", "###", "### ", ":\n", " </turn>", "</turn>\n", "\n", " ", "#", "<", "</tu", "rn>", ":", "a", "é", "\U0001f600"]


def test_round_trip_and_loss_mask():
    rng, t = random.Random(1), chat.Template()
    for _ in range(5000):
        turns = []
        for i in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 3)))])
            turns.append((1, i, role, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))))
        reader, back = chat.Reader(t), []
        segments = list(chat.format_turns(turns, t))
        for _, _, text, loss, _ in segments:
            back += reader.feed(text, loss)
        assert back == [(r, x, x if r == "assistant" else "") for _, _, r, x in turns]
        whole = "".join(s[2] for s in segments)
        assert sum(m.group(1) == t.closing for m in reader.mark.finditer(whole)) == len(turns)


def test_state_machine():
    def problem(*roles):
        return list(chat.format_turns([(1, i, r, "x") for i, r in enumerate(roles)], chat.Template()))[-1][4]

    assert problem("user", "assistant") == problem("system", "user", "assistant", "user", "assistant") == ""
    assert problem("user") == "user -> <end>" and problem("assistant") == "<start> -> assistant"
    assert problem("user", "user", "assistant") == "user -> user" and problem("user", "tool") == "user -> tool"
    assert problem("user", "assistant", "system") == "assistant -> system"


def test_another_template():
    t = chat.Template(before="<|{role}|>", after="<|end|>", opening="<|", role_end="|>", closing="<|end|>", learnt=frozenset({"user"}))
    turns = [(1, 0, "user", "a <|end|> |> \\ b"), (1, 1, "assistant", "<|user|>")]
    reader, back = chat.Reader(t), []
    for _, _, text, loss, _ in chat.format_turns(turns, t):
        back += reader.feed(text, loss)
    assert back == [("user", "a <|end|> |> \\ b", "a <|end|> |> \\ b"), ("assistant", "<|user|>", "")]


def test_awkward_conversations(spark):
    rows = [
        (1, 1, "assistant", "b" * 50_000),
        (1, 0, "user", None),
        (2, 0, None, "x"),
        (2, 0, None, "x"),
        (None, 0, "user", "n"),
        (None, None, "assistant", "first"),
        (3, 5, "user", "q"),
    ]
    df = spark.createDataFrame([(*r, True, 9) for r in rows], "conv_id long, turn long, role string, text string, loss boolean, place int")
    got = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    assert len(got) == 4 and got[1]["valid"] and got[1]["loss_chars"] == 50_000 and not got[2]["valid"]
    text = "user\n\nassistant\n" + "b" * 50_000 + "\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[None]["n_turns"] == 2 and got[None]["problem"] == "<start> -> assistant" and got[2]["n_turns"] == 2
    segments = chat.format_chat(df).collect()
    assert {r["conv_id"] for r in segments} == set(got)
    joined = "".join(r["text"] for r in sorted((r for r in segments if r["conv_id"] == 1), key=lambda r: r["place"]))
    assert len(joined) == got[1]["formatted_chars"]
    assert chat.chat_digest(df.limit(0)).count() == 0

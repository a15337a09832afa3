import itertools
import random

import numpy as np
import pytest

from docweave.llm.chat import ROLES, ChatModel, fitted, format_chats, marker, observed, rendered, transcripts


@pytest.mark.parametrize(
    "line, role, rest",
    [("User: hi", "user", "hi"), ("### Assistant:", "assistant", ""), ("<|im_start|>system", "system", ""), ("[BOT] x", "assistant", "x"), ("**Q:** y", "user", "y"), ("<|user|>", "user", ""), ("> Human : z", "user", "z")],
)
def test_markers(line, role, rest):
    found, at = marker(line)
    assert ROLES[found] == role and line[at:] == rest


def test_no_markers_in_prose():
    for line in ("users: many", "A man walks", "", "the user said", "system", "Note: this", "###Userland"):
        assert marker(line) == (-1, 0)


def test_viterbi_is_the_best_path():
    rng, model = random.Random(1), ChatModel.default()
    lines = ["User: a?", "", "Assistant: b", "- list", "You are kind", "what?", "x" * 300, "Q: quoted"]
    for _ in range(15):
        own = [rng.choice(lines) for _ in range(rng.randrange(1, 6))]
        seen = [observed(x, i > 0 and not own[i - 1].strip()) for i, x in enumerate(own)]

        def score(path):
            total = model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:]))
            return total + sum(model.emit[f][s, v] for s, o in zip(path, seen) for f, v in enumerate(o))

        best = max(itertools.product(range(6), repeat=len(own)), key=score)
        assert score(model.viterbi(own)) == pytest.approx(score(best))


def test_unmarked_and_quoted_lines():
    model = ChatModel.default()
    turns = model.parse("You are a helpful guide.\n\nUser: where is it?\nI looked already.\n\nAssistant: Here:\n1. left\n2. right\n\nand what then?\n\nAssistant: Straight on.".split("\n"))
    assert [r for r, _ in turns] == ["system", "user", "assistant", "user", "assistant"]
    assert turns[1][1] == "where is it?\nI looked already." and turns[2][1] == "Here:\n1. left\n2. right"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        led = rng.random() < 0.3
        for t in range(rng.randrange(1, 7)):
            role = "system" if t == 0 and led else ROLES[1 + (t - led) % 2]
            rows.append((c, t, role, "\n".join(" ".join(rng.choice(["lorem", "Ipsum,", "dolor."]) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 4)))))
    return rows


def test_roles_and_texts_come_back(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, Rendered string")
    out = format_chats(transcripts(df), "conv_id", "turn", "text").collect()
    assert sorted((r["id"], r["turn"], r["role"], r["content"]) for r in out) == sorted(rows)
    assert all(r["rendered"] == rendered(r["role"], r["content"]) for r in out)
    again = format_chats(transcripts(df), "conv_id", "turn", "text", most_lines=4).collect()
    assert sorted((r["id"], r["turn"], r["content"]) for r in again) == sorted((r["id"], r["turn"], r["content"]) for r in out)


def test_long_transcripts_are_dealt_out_in_stretches(spark):
    rows = [(1, t, f"{'User' if t % 2 else 'Bot'}: text {t}") for t in range(50)] + [(2, None, "User: first"), (2, 3, "Bot: then")]
    df = spark.createDataFrame(rows, "id long, turn long, text string")
    out = sorted((r["id"], r["stretch"], r["turn"], r["content"]) for r in format_chats(df, "id", "turn", "text", per_stretch=20).collect())
    assert out == [(1, t // 20, t % 20, f"text {t}") for t in range(50)] + [(2, 0, 0, "first"), (2, 0, 1, "then")]


def test_fit_follows_the_counts():
    model = ChatModel.fit([[("user", "Q: a"), ("user", "Q: b")]] * 500)
    assert np.exp(model.move[2, 2]) > 0.99 and np.allclose(np.exp(model.move).sum(axis=1), 1)


def test_odd_rows(spark):
    rows = [(1, 0, "User: a"), (1, 0, "User: a"), (1, 1, None), (None, 0, "Bot: b"), (2, 0, ""), (3, 0, None), (4, None, "no marker at all")]
    df = spark.createDataFrame(rows, "id long, turn int, text string")
    out = {(r["id"], r["turn"], r["role"], r["content"]) for r in format_chats(df, "id", "turn", "text").collect()}
    assert out == {(1, 0, "user", "a"), (1, 1, "user", "a"), (None, 0, "assistant", "b"), (4, 0, "user", "no marker at all")}
    assert format_chats(df.limit(0), "id", "turn", "text").count() == 0


def test_stretches_and_streams_give_the_states_of_the_whole(spark):
    """Unmarked, blank and quoted lines at and over the edges, orders with wide gaps: as one Viterbi over the transcript."""
    rng, model = random.Random(7), ChatModel.default()
    texts = ["User: where?", "Bot: there", "so it goes on", "and on", "", "- listed\n- twice", "You are kind", "what?", "x" * 300, "  ", "System: be short\n", "he said\nQ: quoted\nlast"]
    rows = [(c, 1_700_000_000 + 5000 * t, rng.choice(texts[2:10] if c == 3 or t % 20 > 15 else texts)) for c in range(6) for t in range(130)]
    df = spark.createDataFrame(rows, "id long, turn long, text string")
    want = []
    for c in range(6):
        turns = [x for x in model.parse("\n".join(t for i, _, t in rows if i == c).split("\n")) if x[1]]
        want += [(c, k, *x) for k, x in enumerate(turns)]
    for stretch, most in ((7, 5000), (20, 3), (1000, 4)):
        out = format_chats(df, "id", "turn", "text", most_lines=most, per_stretch=stretch).collect()
        assert sorted((r["id"], r["place"], r["role"], r["content"]) for r in out) == want


def test_roles_come_back_where_markers_are_missing(spark, sf_dir):
    """Fitted on half of the conversations, read on the others: held-out shares of lines with the right role."""
    df = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/conversations.parquet")
    train, test = df.where("conv_id % 2 = 0"), df.where("conv_id % 2 = 1")
    model = fitted(train)
    truth = {}
    for r in test.orderBy("conv_id", "turn").collect():
        truth.setdefault(r["conv_id"], []).extend([r["role"]] * len((r["text"] or "").split("\n")))
    for share, least in ((0.0, 0.99), (0.1, 0.95), (0.3, 0.84)):
        lines = {}
        for r in transcripts(test, share).orderBy("conv_id", "turn").collect():
            own = lines.setdefault(r["conv_id"], ([], []))
            added = r["text"].split("\n")
            own[0].extend(added)
            own[1].extend([r["role"]] * len(added))
        right = [ROLES[s // 2] == want for texts, wanted in lines.values() for s, want in zip(model.viterbi(texts), wanted)]
        assert sum(right) >= least * len(right), (share, sum(right) / len(right))
    assert fitted(df.limit(0)).whole() == ChatModel.default().whole()

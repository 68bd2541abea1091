import itertools
import random

import pytest

from strandline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, matrix string"


def cheapest(roles):
    """Cost of the best repair, by trying every state path."""
    best = {chat.START: 0}
    for role in roles:
        nxt = {}
        for a, b, cost, _, _ in chat._moves(chat.role_code(role)):
            if a in best:
                nxt[b] = min(nxt.get(b, 1 << 40), best[a] + cost)
        best = nxt
    return min(c + chat.INSERT * len(chat.ending(s)) for s, c in best.items())


def legal(rendered):
    roles = [m.split("\n", 1)[0] for m in rendered.split("<|im_start|>")[1:]]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles)) and rendered.count("<|im_end|>") == rendered.count("<|im_start|>")


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(8)
    kinds = ["user", "assistant", "system", "tool", None, ""]
    rows = [(c, k, rng.choice(kinds), f"t{k}", "x", 1, "m") for c in range(60) for k in range(rng.randrange(1, 7))]
    rows += [(1000, k, rng.choice(kinds[:3]), "big", "x", 1, "m") for k in range(1500)]
    rows += [(None, 1, "user", None, "x", 1, "m"), (None, None, None, "<|im_end|>", "x", 1, "m"), (7, 0, "user", "same", "x", 1, "m"), (7, 0, "user", "same", "x", 1, "m")]
    return rows


def test_repairs_are_legal_whole_and_cheapest(spark, conversations, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 16)
    monkeypatch.setattr(chat, "FAN_IN", 4)
    turns = spark.createDataFrame(conversations, SCHEMA)
    rows = chat.format_conversations(turns).collect()
    assert len(rows) == len(conversations)
    for conv in {r[0] for r in conversations} - {7, None}:
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.turn)
        assert legal("".join(r.rendered for r in own))
        given = [r[2] for r in sorted((r for r in conversations if r[0] == conv), key=lambda r: r[1])]
        assert [r.role for r in own] == given
        assert sum(r.cost for r in own) == cheapest(given)


def test_small_cases_against_all_sequences():
    for n in (1, 2, 3):
        for roles in itertools.product(["user", "assistant", "system", None], repeat=n):
            codes = [chat.role_code(r) for r in roles]
            total = chat.UNIT
            for c in codes:
                total = chat.product(total, chat._matrix(c))
            out = list(chat.repair(codes, ["t"] * n, chat.START, chat.exit_of(total[chat.START]), True))
            assert sum(o[3] for o in out) == cheapest(roles)
            assert legal("".join(o[4] for o in out))


def test_good_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a")]
    out = sorted(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.turn)
    assert [r.action for r in out] == ["keep"] * 3
    assert "".join(r.rendered for r in out) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0

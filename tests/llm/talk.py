"""Conversations with every awkward case, for the tests of the conversation operators."""

import random

SCHEMA = "conv_id long, turn long, role string, text string, at long, seg int, `range` int, key string, n long, h int"


def conversations():
    rng = random.Random(5)
    words = ["Alpha.", "beta", "gamma!", "dél <turn", "</turn>", "\\l x", "e>f?", "...", "\n### user:"]
    roles = ["user", "assistant", "system", "tool", "", "User", "sage", "unit"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(0, 9)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.8 else rng.choice(roles)
            rows.append((c, t, role, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))))
    shared = [("system", "You help."), ("user", "Hi there."), ("assistant", "Hello!")]
    for c in range(100, 160):                                         # a very common beginning, many equal conversations
        told = shared + ([("user", f"{c % 7}?")] if c % 3 else [])
        rows += [(c, t, r, x) for t, (r, x) in enumerate(told)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"turn {t % 50}" + "." * (t % 3)) for t in range(301)]   # one long conversation
    rows += [(201, None, "user", "no number"), (201, None, None, None), (201, 3, "assistant", None), (201, 3, "assistant", "Tie."),
             (201, 3, "assistant", "Tie."), (201, -5, "user", "Before."), (202, 0, "user", "é" * 70_000 + "."), (203, 0, None, " \t\n"),
             (None, 0, "user", "No conversation."), (None, 1, "assistant", "None."), (-3, 0, "user", "Minus."), (-8, 0, "user", "Minus."),
             (-5, 0, "user", "Minus five."), (-5, 1, "assistant", "Yes."), (204, 7, "assistant", "x."), (204, 7, "assistant", "x."),
             (1 << 40, 0, "user", "Far."), (1 << 40, 1, "assistant", "Far.")]
    return [(*r, 1, 2, 3, "k", 4, 5) for r in rows]


def in_turn(rows):
    """conv_id to its (role, text) by turn (null first), role, text, nulls first."""
    found = {}
    for c, t, r, x, *_ in rows:
        found.setdefault(c, []).append(((t is not None, t or 0, r is not None, r or "", x is not None, x or ""), (r, x)))
    return {c: [y for _, y in sorted(v, key=lambda z: z[0])] for c, v in found.items()}

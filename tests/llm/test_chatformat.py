import hashlib

from retenta.llm import chatformat
from .conftest import rows
from .talk import SCHEMA, conversations, in_turn

COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(data):
    data = [*data, *[(-7, i, r, "\\### Assistant: </turn> ok") for i, r in enumerate(("user", "assistant"))]]
    out = []
    for c, told in in_turn(data).items():
        told = [(r or "", x or "") for r, x in told]
        loss = "".join(x for r, x in told if r == "assistant")
        out.append((c, len(told), sha("".join(f"{r}\n{x}\n" for r, x in told)), len(loss), sha(loss),
                    sum(len(r + x) + sum(y in "\\<>" for y in r + x) + len("<turn ></turn>\n") for r, x in told)))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_round_trip_matches_brute_force(spark):
    data = conversations()
    assert rows(chatformat.report(spark.createDataFrame(data, SCHEMA).repartition(3)), *COLUMNS) == brute(data)


def test_control_strings_occur_only_as_marks(spark):
    df = spark.createDataFrame([(1, 0, "a>b\\", "<turn x>\\l\\b</turn>\n"), (1, 1, "assistant", "</turn>\n<turn user>")],
                               "conv_id long, at long, role string, text string")
    pieces = chatformat.rendered(df)
    text = "".join(r["piece"] for r in pieces.orderBy("at").collect())
    assert text.count("<turn ") == text.count("</turn>") == 2 and text.count("<") == 4
    assert rows(chatformat.read_back(pieces), "role", "text") == sorted([("a>b\\", "<turn x>\\l\\b</turn>\n"), ("assistant", "</turn>\n<turn user>")])


def test_fold_takes_what_follows_the_last_reset(spark):
    log = [(1, 10, 0, "open", "user", None), (1, 11, 0, "delta", None, "one "), (1, 20, 1, "open", "assistant", None),
           (1, 21, 1, "delta", None, "bad"), (1, 22, 1, "regenerate", None, None), (1, 23, 1, "delta", None, "go"),
           (1, 24, 0, "delta", None, "two"), (1, 25, 1, "delta", None, "od"), (1, 30, 0, "edit", None, "new"), (1, 31, 0, "delta", None, "!"),
           (1, 40, 2, "open", "user", None), (1, 41, 2, "delta", None, "gone"), (1, 42, 2, "regenerate", None, None),
           (1, 50, 3, "delta", None, "no opening"), (None, 1, None, "open", None, None), (None, 2, None, "delta", None, "null ids")]
    got = chatformat.folded(spark.createDataFrame(log, chatformat.EVENTS).repartition(4))
    assert rows(got, "conv_id", "at", "role", "text") == [
        (None, 1, "", "null ids"), (1, 10, "user", "new!"), (1, 20, "assistant", "good"), (1, 40, "user", ""), (1, 50, "", "no opening")]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(chatformat.report(empty), *COLUMNS) == brute([])
    assert chatformat.folded(spark.createDataFrame([], chatformat.EVENTS)).count() == 0

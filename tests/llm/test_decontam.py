import collections
import re

import pytest
from pyspark.sql import functions as F

from retenta.llm import decontam
from retenta.llm.common import table
from .conftest import rows

ITEM = "When Alice bought 3 kg of red apples, at the old market she paid 12 dollars to Bob yesterday morning in town."


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts, 1)], "item_id long, text string, pos string")


def run(spark, items, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, share int")
    return rows(decontam.decontaminate(docs, bench(spark, *items)), "doc_id", "contaminated", "item_id")


def test_new_numbers_names_and_units_are_caught(spark):
    texts = [
        "Well. " + ITEM + " Then more.",
        ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("3 kg", "7 tons").replace("12", "19"),
        "Somebody said: " + ITEM,
        ITEM.replace("3 kg", "12 kg"),                       # one value for two numbers: no consistent reading
        ITEM.replace("Bob", "Alice"),                        # one name for two
        "When Alice bought 3 kg of red apples she went home.",
        "An old market is a place where people of the town meet in the morning to buy red apples.",
        None, "", "four words only here",
    ]
    want = [(0, True, 1), (1, True, 1), (2, True, 1)] + [(i, False, None) for i in range(3, 10)]
    got = run(spark, [ITEM, None, "", "short one"], texts)
    assert got == want


def test_plain_items_in_capitals(spark):
    item = "The heatou ononat to to the anor shheed eronnten. Is the was that of them all here."
    assert run(spark, [item], ["x y " + item.upper() + " z"]) == [(0, True, 1)]


def test_template_kinds(spark):
    df = spark.createDataFrame([("In 1999 Mr. Smith ran 5 km to McDonald. He won.",)], "text string")
    got = df.select(decontam.tokens(df["text"]).alias("w")).withColumn("p", F.transform("w", decontam.bare)).select(
        decontam.template("w", "p").alias("t")).first()["t"]
    assert got == ["in", "#", "@", "smith", "ran", "#", "%", "to", "@", "he", "won"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_planted_passages_are_found_and_others_left(spark, sf):
    """Against a plain search for each item's lower-case words in a row."""
    def words(t):
        return re.findall(r"\w+", (t or "").lower())

    docs, items = table(spark, sf, "documents"), rows(table(spark, sf, "benchmark"), "item_id", "text")
    got = {d: c for d, c in rows(decontam.decontaminate(docs, table(spark, sf, "benchmark")), "doc_id", "contaminated")}
    needles = [" " + " ".join(words(t)) + " " for _, t in items]
    want = {d: any(n in " " + " ".join(words(t)) + " " for n in needles) for d, t in rows(docs, "doc_id", "text")}
    assert sum(want.values()) > 5 and got == want


def test_clean_keeps_columns_rows_and_empty_tables(spark, docs, none):
    b = bench(spark, ITEM)
    assert rows(decontam.clean(docs, b), *docs.columns) == rows(docs, *docs.columns)
    assert decontam.clean(none, b).count() == 0
    assert decontam.decontaminate(docs, b.filter("false")).filter("contaminated").count() == 0
    again = docs.unionByName(docs.limit(1).selectExpr("doc_id", f"'{ITEM}' as text", *[f"`{c}`" for c in docs.columns[2:]]))
    assert collections.Counter(decontam.clean(again, b).columns) == collections.Counter(docs.columns)
    assert decontam.clean(again, b).count() == docs.count()


def test_copies_in_other_case_and_without_stops(spark):
    prose = "Here Alice met Bob near Rome. There Carol saw Dan. Then all of them went home again. Later on Eve came too."
    short = "Green apples were sold here"
    names = "Alice Bob Carol Dan Eve Frank"
    texts = []
    for item in (ITEM, prose, short, names):
        bare = re.sub("[.,!?]", "", item)
        texts += ["x y " + t + " z" for t in (item, item.lower(), item.upper(), bare, re.sub("[.,!?]", ",", item), re.sub("[.,!?] ?", "\n", item))]
    got = run(spark, [ITEM, prose, short, names], texts)
    assert got == [(i, True, i // 6 + 1) for i in range(24)]
    other = [prose.lower().replace("alice", "x").replace("dan", "y").replace("them", "us"), "Green apples were eaten here", "zoe bob carol dan eve max"]
    assert run(spark, [prose, short, names], other) == [(i, False, None) for i in range(3)]


def test_names_that_start_sentences_may_change(spark):
    item = ("Natalia sold 48 clips to her friends in April. Natalia then sold half as many clips in May. "
            "Weng helped her with 10 more. How many clips did they sell in all?")
    other = item.replace("Natalia", "Maria").replace("Weng", "Paul").replace("48", "36").replace("April", "June")
    mixed = other.replace("Maria then", "Olga then")            # one name for two: that sentence's windows only bind otherwise
    assert run(spark, [item], ["Well then " + other + " Yes.", other, "It says: " + other, mixed]) == [
        (0, True, 1), (1, True, 1), (2, True, 1), (3, False, None)]


def altered(text, how):
    """A copy as the readings are for: other case, no stops, other numbers and names."""
    words = {"lower": str.lower, "upper": str.upper, "stops": lambda t: re.sub("[.!?,]", "", t),
             "numbers": lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) + 7), t),
             "names": lambda t: re.sub(r"(?<=[a-z,] )[A-Z][a-z]+", lambda m: "Q" + m[0].lower(), t)}
    return words[how](text)


def test_probing_passes_over_no_text_that_holds_an_item(spark, monkeypatch):
    """The same rows with and without the word pairs, over all readings, on whole tables with altered copies among them."""
    sf = "/root/testdata/sf0.001"
    items = table(spark, sf, "benchmark")
    texts = [r["text"] for r in items.orderBy("item_id").limit(40).collect()]
    kinds = ["lower", "upper", "stops", "numbers", "names"]
    made = [(10_000 + 5 * i + j, f"Intro words {t and altered(t, k)} and more") for i, t in enumerate(texts) for j, k in enumerate(kinds)]
    # copies that lack a word in eight hold less than 0.8 of the windows; others lack one word
    made += [(20_000 + i, " ".join(w for j, w in enumerate(t.split()) if j % 8)) for i, t in enumerate(texts)]
    made += [(30_000 + i, " ".join(w for j, w in enumerate(t.split()) if j != 9)) for i, t in enumerate(texts)]
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    probed = rows(decontam.decontaminate(docs, items), "doc_id", "contaminated", "item_id", "share")
    seen = decontam.candidates(docs, items, decontam.written(decontam._items(items), "items"))
    assert seen.count() < docs.select("text").distinct().count()
    monkeypatch.setattr(decontam, "candidates", lambda docs, *_: docs.select(*decontam.text_keys(F.col("text")), "text"))
    assert probed == rows(decontam.decontaminate(docs, items), "doc_id", "contaminated", "item_id", "share")
    assert sum(c for i, c, *_ in probed if i >= 10_000) > 100


def test_items_without_pairs_leave_every_text_in(spark):
    names = "Alice Bob Carol Dan Eve Frank"
    items = bench(spark, ITEM, names)
    docs = spark.createDataFrame([(1, "nothing of that kind is in here"), (2, "well " + names.lower() + " they said")], "doc_id long, text string")
    assert decontam.candidates(docs, items, decontam.written(decontam._items(items), "items")).count() == 2
    assert rows(decontam.decontaminate(docs, items), "doc_id", "contaminated", "item_id") == [(1, False, None), (2, True, 2)]


def held(item, text):
    """Reading by reading in plain Python: the largest share of an item's windows that a text holds, for items without
    slots that conflict. Names are capitalised words (reading a: not at the start of a sentence, c: anywhere), literals in b."""
    def read(t, kind):
        out, before = [], "."
        for w in re.findall(r"[^\W_][\w.!?]*", t):
            plain = w.rstrip(".!?")
            name = plain != plain.lower() and plain != plain.upper() and (kind == "c" or kind == "a" and before[-1] not in ".!?")
            unit = plain.lower() in decontam.UNITS and before[0].isdigit()
            out.append("#" if plain[0].isdigit() else "%" if unit else "@" if name else plain.lower())
            before = w
        return out

    grams = lambda t, kind: [tuple(g) for g in zip(*[read(t, kind)[i:] for i in range(5)])]
    there = {g for kind in "abc" for g in grams(text, kind)}
    counted = [i for i, g in enumerate(grams(item, "a")) if sum(x not in "#@%" for x in g) >= 2]
    hit = {i for kind in "abc" for i, g in enumerate(grams(item, kind)) if g in there}
    return len(hit & set(counted)) / max(1, len(counted))


def test_all_readings_against_plain_python(spark):
    """Texts that hold one altered copy each: found where plain Python counts 0.8 of the windows, and only there."""
    items = table(spark, "/root/testdata/sf0.001", "benchmark").orderBy("item_id").limit(25)
    texts = [(r["item_id"], r["text"]) for r in items.collect()]
    made = [(100 * i + j, altered(t, k)) for i, (_, t) in enumerate(texts) for j, k in enumerate(["lower", "upper", "stops", "numbers"])]
    made += [(100 * i + 50 + cut, " ".join(t.split()[cut:])) for i, (_, t) in enumerate(texts) for cut in (2, 5, 9)]
    got = rows(decontam.decontaminate(spark.createDataFrame(made, "doc_id long, text string"), items), "doc_id", "contaminated")
    want = sorted((d, any(held(t, x) >= 0.8 for _, t in texts)) for d, x in made)
    assert got == want and {c for _, c in want} == {True, False}

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes tokens (runs of letters and digits) and a template: numbers,
names and units are typed placeholders, all other tokens lower-case literals.
The first word of a sentence is a literal, so that texts in capitals match too.
Five-token template windows of documents are hash-joined with those of the
benchmark. Windows on one diagonal (document position minus item position) are
one reading of the item; its slots must bind consistently: each item value
stands for one document value and the other way round. A document that holds at least
0.8 of an item's windows in consistent readings contains the item, whether
verbatim or with other numbers, names and units.

Whether a word is a name depends on its case and on the stop before it, which copies change. So each window is
read two more ways, in which names are lower-case literals, and in which capitalised words at the start of a
sentence are names, and an item's window is held if any reading of it is. The first reading decides where it
finds an item; the others serve the texts in which it finds none.

Templates cost far more than words, so texts are first probed with pairs of neighbouring words. Words of an item that have
no capitals are the same literals in every reading. For each item so many such pairs are taken, those of the longest
words first, that the windows which hold one are more than an item can lack: whatever text holds
0.8 of its windows holds one of these pairs, and texts without any are clean. Where an item
has too few such pairs, no text is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed, text_keys, written

WINDOW = 5
SIMILARITY = 0.8
LITERALS = 2      # a window of an item needs so many literal tokens to be one
# The unit words. One is a slot only right after a number.
UNITS = """
mm cm dm m km in inch inches ft foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons oz
ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute
minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree
degrees kmh mph hz khz mhz ghz w kw kwh v mv a ma kb mb gb tb byte bytes bit bits
""".split()
NUMBER, NAME, UNIT = "#", "@", "%"


STOPS = ".!?"


def tokens(text: Column) -> Column:
    """Runs of letters and digits; full stops and the like stay at the end of the run that they follow."""
    return F.array_remove(F.split(text, r"[^\p{L}\p{N}.!?]+|(?<![\p{L}\p{N}.!?])[.!?]+"), "")


def bare(token: Column) -> Column:
    return F.rtrim(token, F.lit(STOPS))


def template(words: str, plain: str) -> Column:
    """Literals and typed placeholders of array columns of tokens, as read and without their stops.

    Number: begins with a digit (a unit written to it is part of its value).
    Unit: a unit word after a number. Name: capital and small letters, not at the start of a sentence.
    """
    def number(w):
        return (w >= "0") & (w < ":")

    def one(w, i):
        low, before = F.lower(w), F.col(words)[i - 1]
        unit = (i > 0) & number(before) & low.isin(*UNITS)
        name = (w != F.upper(w)) & (i > 0) & ~F.substring(before, -1, 1).isin(*STOPS)
        # Most tokens have no capitals: they are told apart first.
        return F.when(w == low, F.when(number(w), NUMBER).when(unit, UNIT).otherwise(w)).when(
            number(w), NUMBER).when(unit, UNIT).when(name, NAME).otherwise(low)

    return F.transform(plain, one)


def readings(words: str, plain: str) -> dict[str, Column]:
    """Templates of a text: ``a`` as ``template`` reads it; ``b`` with names as lower-case literals, so that
    neither case nor stops matter; ``c`` with capitalised words as names at the start of a sentence too."""
    a = template(words, plain)

    def anywhere(k, i):
        w = F.col(plain)[i]
        return F.when(~k.isin(NUMBER, UNIT) & (w != F.lower(w)) & (w != F.upper(w)), NAME).otherwise(k)

    return {"a": a, "b": F.transform(a, lambda k, i: F.when(k == NAME, F.lower(F.col(plain)[i])).otherwise(k)),
            "c": F.transform(a, anywhere)}


def windows(texts: DataFrame, *keys: str, templates: bool = False) -> DataFrame:
    """Every template window of ``text`` in each reading, equal ones once; none for null or short texts.

    keys, pos, h (hash of the window), first (as the first reading has it), v (its tokens), t (its template, on demand).
    """
    read = texts.select(*keys, tokens(F.col("text")).alias("words")).filter(F.size("words") >= WINDOW)
    read = read.withColumn("plain", F.transform("words", bare))
    read = read.select(*keys, "plain", *[t.alias(f"t_{r}") for r, t in readings("words", "plain").items()])
    # Each token is hashed once. A window differs in the second and third reading where a token in it does.
    read = read.select("*", *[F.transform(f"t_{r}", lambda k: F.xxhash64(k)).alias(f"h_{r}") for r in "abc"])
    last = F.size("plain") - WINDOW

    def one(r: str, i: Column) -> Column:
        return F.struct(i.alias("pos"), F.xxhash64(*[F.col(f"h_{r}")[i + j] for j in range(WINDOW)]).alias("h"),
                        F.lit(r == "a").alias("first"), F.slice("plain", i + 1, WINDOW).alias("v"),
                        *([F.slice(f"t_{r}", i + 1, WINDOW).alias("t")] if templates else []))

    def other(r: str) -> Column:
        at = F.filter(F.transform(f"h_{r}", lambda h, i: F.when(h != F.col("h_a")[i], i)), lambda i: i.isNotNull())
        around = F.transform(at, lambda i: F.sequence(F.greatest(i - (WINDOW - 1), F.lit(0)), F.least(i, last), F.lit(1)))
        return F.transform(F.array_distinct(F.flatten(around)), lambda i: one(r, i))

    at_all = F.sequence(F.lit(0), last)
    every = F.concat(F.transform(at_all, lambda i: one("a", i)), other("b"), other("c"))
    return read.select(*keys, F.explode(every).alias("w")).select(*keys, "w.*")


def _items(benchmark: DataFrame) -> DataFrame:
    """Windows of distinct item texts, with the item's smallest item_id and number of windows.

    Positions count (``counts``) where the first reading has enough literals; in items without such a one,
    where another has.
    """
    texts = benchmark.filter("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    rows = windows(texts.withColumn("item", F.xxhash64("text")), "item", "item_id", templates=True)
    rows = rows.withColumn("literal", F.transform("t", lambda k: ~k.isin(NUMBER, NAME, UNIT)))
    rows = rows.filter(F.size(F.filter("literal", lambda x: x)) >= LITERALS)
    totals = rows.groupBy("item").agg(F.collect_set(F.when(F.col("first"), F.col("pos"))).alias("one"),
                                      F.collect_set("pos").alias("two"))
    totals = totals.select("item", F.when(F.size("one") > 0, F.col("one")).otherwise(F.col("two")).alias("places"))
    return rows.join(totals, "item").select(
        "h", "item", "item_id", F.size("places").alias("total"), F.col("pos").alias("ipos"), F.col("v").alias("iv"),
        "literal", F.col("first").alias("ifirst"), (~F.array_contains("t", NAME)).alias("plain"),
        F.array_contains("places", F.col("pos")).alias("counts"))


def probes(benchmark: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """item, pairs (hashes of neighbouring words, one of which every text that holds the item has), enough (whether they suffice)."""
    places = items.groupBy("item").agg(F.collect_set(F.when(F.col("counts"), F.col("ipos"))).alias("places"), F.max("total").alias("total"))
    read = benchmark.filter("text is not null").select("text").distinct().select(F.xxhash64("text").alias("item"), tokens(F.col("text")).alias("words"))
    read = read.withColumn("plain", F.transform("words", bare)).withColumn("t", template("words", "plain")).join(places, "item")

    def steady(i: Column) -> Column:
        w = F.col("plain")[i]
        return (F.col("t")[i] == w) & (w == F.lower(w)) & w.rlike(r"^[\p{Ll}\p{Lo}\p{N}]+$") & ~w.rlike("[σς]")

    def weight(i: Column) -> Column:
        return -(F.length(F.col("plain")[i]) + F.length(F.col("plain")[i + 1]))

    both = F.filter(F.sequence(F.lit(0), F.size("plain") - 2), lambda i: steady(i) & steady(i + 1))
    ranked = F.array_sort(F.transform(both, lambda i: F.struct(weight(i).alias("weight"), i.alias("i"))))
    # fewer windows than this can be missing from a text that holds the item
    need = F.col("total") - F.ceil(F.col("total") * similarity - F.lit(1e-9)) + 1
    none = F.expr("cast(array() as array<int>)")

    def take(state: Column, pair: Column) -> Column:
        more = F.array_union(state["covered"], F.array_intersect(F.col("places"), F.sequence(pair["i"] - (WINDOW - 2), pair["i"])))
        useful = (F.size(state["covered"]) < need) & (F.size(more) > F.size(state["covered"]))
        return F.when(useful, F.struct(more.alias("covered"), F.concat(state["used"], F.array(pair["i"])).alias("used"))).otherwise(state)

    chosen = F.aggregate(ranked, F.struct(none.alias("covered"), none.alias("used")), take)
    picked = read.select("item", "plain", need.alias("need"), chosen.alias("c"))
    return picked.select("item", F.transform("c.used", lambda i: F.xxhash64(F.col("plain")[i], F.col("plain")[i + 1])).alias("pairs"),
                         (F.size("c.covered") >= F.col("need")).alias("enough"))


def candidates(docs: DataFrame, benchmark: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """__k1, __k2, text of the distinct texts that may hold an item."""
    named = docs.filter("text is not null").select(*text_keys(F.col("text")), "text")
    chosen = written(probes(benchmark, items, similarity), "benchmark-probes")
    if chosen.filter("not enough").limit(1).count():
        return named
    pairs = written(chosen.select(F.explode("pairs").alias("h")).distinct(), "benchmark-pairs")
    words = named.withColumn("words", F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    near = words.select("__k1", "__k2", "text", F.explode(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))).alias("h"))
    return near.join(broadcast_if_small(pairs, 16), "h", "left_semi").groupBy("__k1", "__k2").agg(F.first("text").alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """__k1, __k2 (names of a text), item_id, share: the contained item of highest share (ties: smallest id) of each text that has one.

    Items found in the first reading go before those that take the others to be found.
    """
    items = written(_items(benchmark), "benchmark-windows")
    texts = written(candidates(docs, benchmark, items, similarity), "candidates")
    found = windows(texts, "__k1", "__k2").join(broadcast_if_small(items, 400), "h")
    # What the window binds: slots only. Equal texts repeat their windows; sets keep one of each.
    bound = F.filter(F.transform("iv", lambda x, j: F.when(~F.col("literal")[j], F.struct(
        x.alias("item"), F.col("v")[j].alias("doc")))), lambda x: x.isNotNull())
    read = (found.select("__k1", "__k2", "item", "item_id", "total", (F.col("pos") - F.col("ipos")).alias("diagonal"),
                         F.struct("ipos", "counts", (F.col("first") & F.col("ifirst")).alias("first"),
                                  "ifirst", "plain", bound.alias("bound")).alias("hit"))
            .groupBy("__k1", "__k2", "item", "item_id", "total", "diagonal").agg(F.collect_set("hit").alias("hits")))

    def consistent(hits: str) -> Column:
        pairs = F.array_distinct(F.flatten(F.col(f"{hits}.bound")))
        return (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))) & (
            F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["doc"]))))

    read = read.select("*", F.filter("hits", lambda x: x["first"]).alias("once"),
                       F.filter("hits", lambda x: x["plain"] | x["ifirst"]).alias("initials"),
                       F.filter("hits", lambda x: x["plain"]).alias("words"))
    none = F.lit(None).cast("array<int>")
    # A reading whose slots conflict doesn't void the one that has fewer slots.
    ways = F.when(consistent("hits"), F.filter("hits", lambda x: x["counts"])).when(
        consistent("initials"), F.filter("initials", lambda x: x["counts"])).when(
        consistent("words"), F.filter("words", lambda x: x["counts"]))
    read = read.select("__k1", "__k2", "item", "item_id", "total",
                       F.when(consistent("once"), F.col("once.ipos")).otherwise(none).alias("one"),
                       F.transform(ways, lambda x: x["ipos"]).alias("any"))
    places = F.size(F.array_distinct(F.flatten(F.collect_list("one"))))
    every = F.size(F.array_distinct(F.concat(F.flatten(F.collect_list("one")), F.flatten(F.collect_list("any")))))
    held = (read.groupBy("__k1", "__k2", "item", "item_id", "total").agg(places.alias("n1"), every.alias("n2"))
            .withColumn("first", F.col("n1") / F.col("total") >= similarity)
            .withColumn("share", F.when(F.col("first"), F.col("n1")).otherwise(F.col("n2")) / F.col("total"))
            .filter(F.col("share") >= similarity))
    best = F.max(F.struct("first", "share", (-F.col("item_id")).alias("minus"), "item")).alias("b")
    return held.groupBy("__k1", "__k2").agg(best).select("__k1", "__k2", (-F.col("b.minus")).alias("item_id"), "b.share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, contaminated, item_id, share.

    item_id and share are null for clean documents. Null and short texts (under five
    tokens) are clean. Items without text, or with no window of enough literals in any reading, match nothing; an item
    without id can match, with null item_id; items of equal text count as one. Null doc_ids and
    repeated rows are kept; other columns are ignored. Empty benchmark: all clean.
    """
    marks = leaks(docs, benchmark, similarity)
    named = docs.select("doc_id", *text_keys(F.col("text")))
    return named.join(marks, ["__k1", "__k2"], "left").select(
        "doc_id", F.col("share").isNotNull().alias("contaminated"), "item_id", "share")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with its own columns, without the contaminated rows."""
    marks = written(leaks(docs, benchmark, similarity).select("__k1", "__k2"), "leaks")
    return packed(docs, *text_keys(F.col("text"))).join(
        broadcast_if_small(marks, 64), ["__k1", "__k2"], "left_anti").select("__row.*")

"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, names and units become typed placeholders; what is left of a text is its template. Windows of
template tokens, and of the words as they stand, are matched by hash join against those of the
benchmark. Matches of one text and item
at distances close to each other are put together, so words put in or left out do no harm; if they
cover enough of the item, the slots are compared along them: a slot
value of the item must stand for the same value wherever it occurs. So an item with other numbers and
names is found, and a text that only shares a phrase is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.shared import cut

#: Units that may follow a number.
UNITS = (
    "km|cm|mm|kg|mg|ml|lbs?|oz|ft|miles?|metres?|meters?|inch(?:es)?|feet|litres?|liters?|grams?|kilograms?|"
    "hours?|hrs?|minutes?|mins?|seconds?|secs?|days?|weeks?|months?|years?|dollars?|euros?|cents?|pounds?|usd|eur|percent|m|g|l|h|s"
)
#: Words that sentences begin with and that are no names, in the four languages of the texts.
ORDINARY = (
    "The|An|If|In|On|At|As|By|Of|To|For|From|With|And|But|Or|So|Then|Than|Thus|There|Here|This|That|These|Those|It|Its|He|She|"
    "They|We|You|His|Her|Their|Our|My|Your|What|When|Where|Which|Who|Whose|Whom|Why|How|Is|Are|Was|Were|Be|Do|Does|Did|Has|"
    "Have|Had|Can|Could|Will|Would|Should|May|Might|Must|Not|No|Yes|All|Each|Every|Some|Any|Many|Both|After|Before|While|"
    "Since|Because|Suppose|Let|Given|Find|Compute|Calculate|Compare|Solve|Now|Also|One|Two|Three|"
    "Der|Die|Das|Den|Dem|Ein|Eine|Einen|Und|Oder|Aber|Wenn|Wie|Was|Wer|Wo|Wann|Warum|Welche|Welcher|Welches|Es|Er|Sie|Wir|"
    "Ist|Sind|Im|Am|Auf|Mit|Von|Zu|Nach|"
    "Le|La|Les|Un|Une|Des|Du|De|Et|Ou|Mais|Si|Il|Elle|Ils|Elles|Nous|Vous|Que|Qui|Quel|Quelle|Quels|Quelles|Quand|Comment|"
    "Pourquoi|Combien|Dans|Pour|Avec|Est|Sont|"
    "El|Los|Las|Una|Unos|Unas|Pero|Qué|Quién|Cuál|Cuándo|Cuánto|Cuántos|Cuántas|Cómo|Dónde|Por|Con|En|Es|Son"
)
CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?:{ORDINARY})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
#: A capitalised word is a name wherever it stands, also first in a sentence, unless it is an ordinary one.
#: Possessive groups: nothing behind them can fail, and the JVM loops over them, where it runs others by recursion.
NAME = rf"{CAPITAL}(?: {CAPITAL})*+"
NUMBER = r"\d(?<![\p{L}\p{N}]\d)\d*(?:[.,:/]\d+)*+"
UNIT = rf" ?(?i:{UNITS})(?![\p{{L}}\p{{N}}])"
#: Between tokens: everything but digits, lower-case letters, and what is not ASCII and no punctuation.
BETWEEN = "[^a-z0-9\u0001\u00aa-\u2000\u2070-\uffff]+"
SLOT = "\u0001[^\u0002]*\u0002"


@dataclass(frozen=True)
class Matching:
    """``literal`` tokens of a benchmark window must be words, else the window says too little and is
    left out. ``share`` of the item's windows must match, and of the slots ``agree``. Tokens put in or
    left out may shift matches by up to ``window`` tokens, or ``drift`` of the item if that is more."""

    window: int = 8
    literal: int = 4
    share: float = 0.5
    agree: float = 0.75
    drift: float = 0.25
    broadcast_rows: int = 500_000


def _unmarked(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(plain, F.lit("\u0001"), F.lit("")), F.lit("\u0002"), F.lit(""))


def marked(text: Column) -> Column:
    """The text with every slot set apart between marks of its own."""
    return F.regexp_replace(_unmarked(text), f"{NAME}|{NUMBER}(?:{UNIT})?", " \u0001$0\u0002 ")


def tokens(marked_text: Column) -> Column:
    """Template tokens: lower-case words without marks, and one placeholder for each slot: ``n`` for a
    name, ``q`` for a number, ``u`` for a number with a unit."""
    out = F.regexp_replace(marked_text, "\u0001\\d[^\u0002]*[\\p{L}][^\u0002]*\u0002", "\u0001u")
    out = F.regexp_replace(out, "\u0001\\d[^\u0002]*\u0002", "\u0001q")
    # Numbers are open by now: a name begins at its own mark, not at theirs.
    out = F.regexp_replace(out, "\u0001[^\u0001\u0002]+\u0002", "\u0001n")
    return F.array_remove(F.split(F.lower(out), BETWEEN), "")


def words(text: Column) -> Column:
    """Literal tokens: lower-case words and runs of digits, without any slot."""
    return F.array_remove(F.split(F.lower(_unmarked(text)), BETWEEN), "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def slots(marked_text: Column) -> Column:
    """The value of each token's slot, null for words; as many entries as there are tokens."""
    parts = F.regexp_extract_all(F.lower(marked_text), F.lit(f"{SLOT}|[{BETWEEN[2:]}"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.startswith("\u0001"), p))


def _hashes(template: Column) -> Column:
    return F.transform(template, lambda t: F.xxhash64(t))


def _key(hashes: Column, at: Column, length, literal) -> Column:
    return F.xxhash64(F.lit(literal), F.slice(hashes, at + 1, length))


def _windows(texts: DataFrame, template: Column, lengths: list[int], literal: bool) -> DataFrame:
    """``doc_id, tag, at, key`` of every window of so many tokens. One row for each token first: its
    windows' keys are then compiled code on the array of hashes, where a lambda would be interpreted."""
    # With the outer form no filter is derived that would compute all hashes once more.
    each = texts.select("doc_id", "tag", _hashes(template).alias("hashes")).select("doc_id", "tag", "hashes", F.posexplode_outer("hashes").alias("at", "one"))
    key = lambda n: F.xxhash64(F.lit(literal), *(F.get("hashes", F.col("at") + i) for i in range(n)))
    fits = lambda n: F.col("at") + n <= F.size("hashes")
    if len(lengths) == 1:
        return each.filter(fits(lengths[0])).select("doc_id", "tag", "at", key(lengths[0]).alias("key"))
    keys = F.array(*(F.when(fits(n), key(n)) for n in lengths)).cast("array<bigint>")
    return each.select("doc_id", "tag", "at", F.explode_outer(keys).alias("key")).filter("key IS NOT NULL")


def benchmark_windows(benchmark: DataFrame, how: Matching) -> DataFrame:
    """Windows of the items: ``item_id, literal, length, total, drift, nth, at, key``. Shorter items are
    one window. Of templates those that say something, of ``literal`` tokens all."""

    def says_something(window: Column) -> Column:
        literals = F.size(F.filter(window, lambda t: ~t.startswith("\u0001")))
        return literals * how.window >= F.size(window) * how.literal

    def of(template: Column, literal: bool) -> DataFrame:
        items = benchmark.select("item_id", template.alias("template")).filter("item_id IS NOT NULL AND size(template) > 0")
        every = F.sequence(F.lit(0), F.size("template") - F.col("length"))
        starts = every if literal else F.filter(every, lambda i: says_something(F.slice(F.col("template"), i + 1, F.col("length"))))
        return (
            items.withColumn("length", F.least(F.size("template"), F.lit(how.window)))
            .withColumn("starts", starts)
            .withColumn("drift", F.greatest(F.lit(how.window), F.floor(F.size("template") * how.drift).cast("int")))
            .withColumn("hashes", _hashes(F.col("template")))
            .select("item_id", "length", F.size("starts").alias("total"), "drift", "hashes", F.posexplode("starts").alias("nth", "at"))
            .select(
                "item_id", F.lit(literal).alias("literal"), "length", "total", "drift", "nth", "at",
                _key(F.col("hashes"), F.col("at"), F.col("length"), literal).alias("key"),
            )
            .distinct()
        )

    return of(tokens(marked(F.col("text"))), False).unionByName(of(words(F.col("text")), True))


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Matching = Matching()) -> DataFrame:
    """Pairs of texts and items: ``doc_id, tag, item_id, matched, total, slots``.

    ``tag`` tells apart rows that share an id. Empty and null texts and items match nothing; items
    without an id are left out. Repeated rows give one pair.
    """
    tagged = docs.select("doc_id", F.hash("text").alias("tag"), "text")
    windows = cut(benchmark_windows(benchmark, how))
    lengths = [tuple(r) for r in windows.select("literal", "length").distinct().collect()]  # at most 2 * how.window rows
    small = windows.count() <= how.broadcast_rows
    items = windows.select("item_id", "literal", "total", "drift", F.struct(F.col("at").alias("item_at"), "nth").alias("place"), "key")

    def hits_of(template: Column, literal: bool) -> DataFrame:
        own, wanted = sorted(n for kind, n in lengths if kind == literal), items.filter(F.col("literal") == literal)
        return _windows(tagged, template, own, literal).join(F.broadcast(wanted) if small else wanted, "key")

    hits = hits_of(tokens(marked(F.col("text"))), False).unionByName(hits_of(words(F.col("text")), True))
    shifts = hits.groupBy("doc_id", "tag", "item_id", "literal", "total", "drift", (F.col("at") - F.col("place.item_at")).alias("shift")).agg(
        F.collect_set("place").alias("places")
    )
    # Each shift is in two bands of twice the drift: shifts no further apart than the drift share one.
    band = F.floor(F.col("shift") / F.col("drift"))
    pair = ["doc_id", "tag", "item_id", "literal", "total", "band"]

    def reach(places: Column) -> Column:
        # Windows that one change has torn count where those on both sides of it match.
        step = lambda p, before: F.when(p["item_at"] - before["item_at"] <= how.window + 1, p["nth"] - before["nth"]).otherwise(1)
        steps = F.transform(places, lambda p, i: step(p, F.get(places, i - 1)))
        return F.struct(F.size(places).alias("matched"), F.aggregate(steps, F.lit(0), lambda a, b: a + b).alias("bridged"))

    runs = (
        shifts.withColumn("band", F.explode(F.array(band, band + 1)))
        .groupBy(*pair)
        .agg(F.collect_list(F.struct("shift", "places")).alias("parts"))
        .withColumn("reach", _once(F.array_sort(F.array_distinct(F.flatten("parts.places"))), reach))
        .filter(F.col("reach.bridged") >= F.col("total") * how.share)
        .select(*pair, "parts", F.col("reach.matched").cast("long").alias("matched"))
    )
    runs = cut(runs)
    # A place that several shifts match belongs to the one with most places.
    aligned = (
        runs.filter("NOT literal").select(*pair, "matched", F.explode("parts").alias("p"))
        .select(*pair, "matched", F.size("p.places").alias("n"), F.col("p.shift").alias("shift"), F.explode("p.places.item_at").alias("item_at"))
        .groupBy(*pair, "matched", "item_at")
        .agg(F.max(F.struct("n", -F.abs("shift"), "shift"))["shift"].alias("shift"))
        .groupBy(*pair, "matched")
        .agg(F.array_sort(F.collect_list(F.struct("item_at", "shift"))).alias("steps"))
    )
    turns = F.filter("steps", lambda s, i: ~s["shift"].eqNullSafe(F.get(F.col("steps"), i - 1)["shift"]))

    whole = _once(marked(F.col("text")), lambda m: F.struct(tokens(m).alias("t"), slots(m).alias("v")))
    items_in_full = benchmark.select("item_id", whole.alias("item"))
    found = tagged.alias("d").join(
        runs.filter("NOT literal").select("doc_id", "tag").distinct().alias("r"),
        F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.tag") == F.col("r.tag")),
        "left_semi",
    )
    texts = found.select("doc_id", "tag", whole.alias("doc"))
    both = (
        aligned.withColumn("turns", turns).alias("r")
        .join(texts.alias("d"), F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("r.tag") == F.col("d.tag")))
        .join(items_in_full.alias("i"), F.col("r.item_id") == F.col("i.item_id"))
        .select("r.*", "d.doc", "i.item")
    )
    # Each token of the item beside one of the text, at the shift of the last matched window begun by then.
    first = F.get(F.col("turns"), 0)["shift"]
    shift_at = lambda at: F.aggregate("turns", first, lambda now, s: F.when(s["item_at"] <= at, s["shift"]).otherwise(now))

    def facing(at: Column) -> Column:
        beside = lambda k: F.struct(
            F.get(F.col("item.t"), at).alias("it"), F.get(F.col("item.v"), at).alias("iv"),
            F.get(F.col("doc.t"), k).alias("dt"), F.get(F.col("doc.v"), k).alias("dv"),
        )
        return _once(at + shift_at(at), beside)

    pairs = F.transform(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.size("item.t") - 1), facing),
            lambda p: p["iv"].isNotNull() & p["dv"].isNotNull() & (p["it"] == p["dt"]),
        ),
        lambda p: F.struct(p["iv"].alias("iv"), p["dv"].alias("dv")),
    )

    def compared(p: Column) -> Column:
        torn = F.size(F.array_distinct(p)) - F.size(F.array_distinct(F.transform(p, lambda x: x["iv"])))
        return F.struct(F.size(p).alias("slots"), torn.alias("torn"))

    checked = (
        both.select("doc_id", "tag", "item_id", "total", "matched", _once(pairs, compared).alias("c"))
        .filter(F.col("c.torn") <= F.col("c.slots") * (1 - how.agree))
        .select("doc_id", "tag", "item_id", "matched", "total", "c.slots")
    )
    # What agrees word by word has no slots to compare.
    verbatim = runs.filter("literal").select("doc_id", "tag", "item_id", "matched", "total", F.lit(0).alias("slots"))
    return (
        checked.unionByName(verbatim)
        .groupBy("doc_id", "tag", "item_id")
        .agg(F.max(F.struct("matched", "slots", "total")).alias("best"))
        .select("doc_id", "tag", "item_id", "best.matched", F.col("best.total").cast("long").alias("total"), F.col("best.slots").cast("long").alias("slots"))
    )


def flagged(docs: DataFrame, benchmark: DataFrame, how: Matching = Matching()) -> DataFrame:
    """One row per document: ``doc_id, contaminated, item_ids`` (ascending)."""
    found = contaminated(docs, benchmark, how).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = docs.select("doc_id", F.hash("text").alias("tag"))
    same = F.col("l.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("l.tag") == F.col("f.tag"))
    none = F.array().cast("array<bigint>")
    return rows.alias("l").join(found.alias("f"), same, "left").select(
        "l.doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", none).alias("item_ids")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: Matching = Matching()) -> DataFrame:
    """The rows of ``docs`` that match no item, all columns unchanged."""
    found = contaminated(docs, benchmark, how).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.hash("text") == F.col("_tag"))
    return docs.join(found, same, "left_anti")

"""Benchmark decontamination by canonical templates.

A text becomes a sequence of tokens in which numbers, names (capitalised
words inside a sentence) and units behind numbers are typed slots. Names show
by their case only, so a text has a second form in which they are words like
others; a pair that holds in either form is reported. Items and documents
give all their windows of ``WINDOW`` template tokens, at every position. A
document is proposed for an item if enough of the item's different windows
stand in it, by their hashes; no pair that holds is left out. Proposed pairs
are then checked in full:

* coverage: the share of the item's windows that stand anywhere in the document;
* slots: in windows that match, one value of the item should always have
  become the same value in the document; up to ``CONFLICTS`` of the slots may
  break that, as an item can use one number for several things. A
  re-parameterised question passes; a template that matches by chance does not,
  unless enough of its windows match without slots, or nearly all of them match,
  or the item stands there word for word. Where only windows without any word
  match, half of the slots must have kept their values.

Items with fewer than ``2 * WINDOW - 1`` tokens have too few windows for that. They
are looked up word for word, numbers included, at every position of a document.

All of it is SQL expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.llm.shared import Scratch, key_filter, pick, unused

WINDOW = 5
#: Share of an item's windows that must stand in a document.
COVERAGE = 0.5
#: Share of an item's windows from which on slots are no longer asked, if the item has ``WINDOW`` different words beside its slots.
COMPLETE = 0.9
#: Share of the slots found that may be in conflict.
CONFLICTS = 1 / 3
#: Windows of all items that are sent to every executor, at most (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_WINDOWS = 500_000
#: Proposed pairs (about 60 bytes each) and items (about 2 KB each) that are sent to every executor, at most; beyond it the joins are shuffled.
BROADCAST_PAIRS, BROADCAST_ITEMS = 1_000_000, 20_000

# Units that make a slot behind a number.
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|miles|feet|inches|dollars|euros|percent|meters|kilometers|grams|liters"

_NAME = r"(?<=[\p{Ll},;] )(\p{Lu}\p{L}*)"


#: The forms of a text: with names as slots, and as words.
FORMS = 2


def surface(text: Column) -> Column:
    """Tokens of a text as one blank-separated string; slots are ``~p`` (name), ``~n`` (number) or ``~u`` (unit) with their value."""
    folded = F.regexp_replace(text, r"[\s\p{Z}~]+", " ")
    named = F.regexp_replace(folded, _NAME, "~p$1")
    numbered = F.when(named.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(named, r"[0-9]+", " ~n$0 "), rf"(?i)(~n[0-9]+) +({UNITS})\b", "$1 ~u$2")).otherwise(named)
    return F.trim(F.regexp_replace(F.lower(numbered), r"[^\p{L}0-9~]+", " "))


def _drop(tokens: Column, *marks: str) -> Column:
    for mark in marks:
        tokens = F.replace(tokens, F.lit(mark), F.lit(""))
    return tokens


def forms(tokens: Column) -> list[Column]:
    """A surface in its ``FORMS``."""
    return [tokens, _drop(tokens, "~p")]


def literal(tokens: Column) -> Column:
    """Tokens of a surface without slots."""
    return _drop(tokens, "~p", "~n", "~u")


def template(tokens: Column) -> Column:
    """The same with the values of slots left out."""
    return F.regexp_replace(tokens, r"~([pnu])\S*", "~$1")


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(tokens: Column) -> Column:
    """Every window of ``WINDOW`` tokens as a string, each token with a blank behind."""
    count = F.size(tokens) - (WINDOW - 1)
    each = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (WINDOW - 1)), lambda i: F.concat(F.array_join(F.slice(v, i, WINDOW), " "), F.lit(" ")))
    return F.when(count >= 1, let(tokens, each)).otherwise(F.array().cast("array<string>"))


def _window_hashes(tokens: Column) -> Column:
    """The 64-bit hash of every window of ``WINDOW`` tokens: a token is hashed once, and a window from the hashes of its tokens."""
    each = lambda h: F.transform(h, lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda h: F.slice(each(h), 1, F.greatest(F.lit(0), F.size(h) - (WINDOW - 1))))


def _items(benchmark: DataFrame) -> DataFrame:
    return pick(benchmark, "item_id", "text").filter("text IS NOT NULL").distinct()


def prepare_short(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, n) per distinct item that ``prepare`` leaves out as short; texts without a letter or digit hold no token."""
    spoken = _items(benchmark).select("item_id", surface(F.col("text")).alias("spoken"))
    short = spoken.filter(F.size(F.split("spoken", " ")) < 2 * WINDOW - 1)
    return short.select("item_id", literal(F.col("spoken")).alias("words")).filter("words != ''").distinct().withColumn("n", F.size(F.split("words", " ")))


def prepare(benchmark: DataFrame) -> DataFrame:
    """(item_id, forms) per distinct item, a form with its tokens and windows; null and short texts are left out."""
    spoken = _items(benchmark).select("item_id", surface(F.col("text")).alias("spoken"))
    long = spoken.filter(F.size(F.split("spoken", " ")) >= 2 * WINDOW - 1)
    both = [F.struct(F.split(f, " ").alias("tokens"), _windows(F.split(template(f), " ")).alias("windows")) for f in forms(F.col("spoken"))]
    return long.select("item_id", F.array(*both).alias("forms"))


def doc_key() -> Column:
    """64-bit hash of doc_id and text. With doc_id beside it, it is the identity of a row; equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.lit("/"), F.col("text"))


def _few_windows(posted: DataFrame) -> bool:
    return posted.count() <= BROADCAST_WINDOWS


def _posted(items: DataFrame) -> DataFrame:
    """(item, item_form, place, hash, enough) per window of an item and form; ``enough`` different ones must stand in a document."""
    each = items.select("item", F.posexplode("forms").alias("item_form", "f"))
    hashes = each.select("item", "item_form", _window_hashes(F.split(template(F.array_join("f.tokens", " ")), " ")).alias("hashes"))
    return hashes.select("item", "item_form", (F.size(F.array_distinct("hashes")) * COVERAGE).alias("enough"), F.posexplode("hashes").alias("place", "hash"))


def _probes(docs: DataFrame) -> DataFrame:
    """(key, form, at, hash) per window of a document and form, at every position; the form is null where all forms are the same."""
    spoken = docs.select(doc_key().alias("key"), surface(F.col("text")).alias("spoken"))
    both = [F.struct(F.lit(i).alias("form"), f.alias("tokens")) for i, f in enumerate(forms(F.col("spoken")))]
    alike = F.struct(F.lit(None).cast("int").alias("form"), F.col("spoken").alias("tokens"))
    each = spoken.select("key", F.explode(F.when(F.col("spoken").contains("~p"), F.array(*both)).otherwise(F.array(alike))).alias("f"))
    return each.select("key", "f.form", F.posexplode(_window_hashes(F.split(template(F.col("f.tokens")), " "))).alias("at", "hash"))


def _proposed(scratch: Scratch, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, shift0, shift1): documents with enough windows of an item in one of the forms. Thin rows throughout: no hit carries its document."""
    posted, probes = scratch.table(_posted(items)), _probes(docs)
    if _few_windows(posted):
        posted = F.broadcast(posted)
    else:
        probes = key_filter(scratch, posted.select("hash"))(probes, "wanted", "hash").filter("wanted").drop("wanted")
    hit = probes.join(posted, "hash").filter(F.coalesce(F.col("form") == F.col("item_form"), F.lit(True)))
    of = lambda i, name: F.when(F.col("item_form") == i, F.col(name))
    hit = hit.select("key", "item", "item_form", "hash", "enough", (F.col("at") - F.col("place")).alias("shift"))
    shifts = [F.mode(of(i, "shift"), True).alias(f"shift{i}") for i in range(FORMS)]
    covered = [(F.size(F.collect_set(of(i, "hash"))) >= F.max(of(i, "enough"))).alias(f"covered{i}") for i in range(FORMS)]
    pairs = hit.groupBy("key", "item").agg(*shifts, *covered)
    return pairs.filter(" OR ".join(f"covered{i}" for i in range(FORMS))).drop(*[f"covered{i}" for i in range(FORMS)])


def _short_pairs(docs: DataFrame, short: DataFrame) -> DataFrame:
    """(key, doc_id, item_id) of documents that hold a short item: all their runs of as many tokens as some short item has are looked up."""
    lengths = sorted(r["n"] for r in short.select("n").distinct().collect())  # below 2 * WINDOW - 1
    run = lambda v, i, n: F.array_join(F.slice(v, i, n), " ")
    runs = lambda v, n: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - (n - 1))), lambda i: run(v, i, n))).otherwise(F.array().cast("array<string>"))
    every = let(F.split(literal(surface(F.col("text"))), " "), lambda v: F.array_distinct(F.flatten(F.array(*[runs(v, n) for n in lengths]))))
    spoken = docs.select(doc_key().alias("key"), "doc_id", F.explode(every).alias("words"))
    asked = short.select("item_id", "words")
    return spoken.join(F.broadcast(asked) if short.count() <= BROADCAST_WINDOWS else asked, "words").select("key", "doc_id", "item_id").distinct()


def _with_texts(scratch: Scratch, docs: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, doc_id, item, shift0, shift1, forms, text) of all pairs.

    Few pairs and items are sent to the texts. Else the thin pairs fetch their items
    first, and then their texts, by the document, so that no popular item gathers texts.
    """
    texts = docs.select(doc_key().alias("key"), "doc_id", "text")
    if pairs.count() <= BROADCAST_PAIRS and items.count() <= BROADCAST_ITEMS:
        return texts.join(F.broadcast(pairs), "key").join(F.broadcast(items), "item")
    wanted = key_filter(scratch, pairs.select("key"))(texts, "wanted").filter("wanted").drop("wanted").dropDuplicates(["key", "doc_id"])
    return wanted.join(pairs.join(items, "item"), "key")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, item_id, n_windows, n_found, slots_consistent): pairs of a document and an item it contains.

    Null and empty texts contain nothing. Repeated documents share ``key`` and
    are reported once; items that repeat a text are reported each under their
    item_id. A short item counts as one window. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").filter("text IS NOT NULL")
    items = scratch.table(prepare(benchmark).withColumn("signature", F.xxhash64(F.concat_ws(" ", F.col("forms")[0]["tokens"]))))
    # Items of one text are one item until the end.
    unique = scratch.table(items.groupBy(F.col("signature").alias("item")).agg(F.first("forms").alias("forms")))
    pairs = scratch.table(_proposed(scratch, docs, unique))
    spoken = _with_texts(scratch, docs, pairs, unique).withColumn("spoken", surface(F.col("text"))).drop("text")
    judged = [_judged(F.col("forms")[i], f, F.coalesce(f"shift{i}", F.lit(0))) for i, f in enumerate(forms(F.col("spoken")))]
    # The form that holds, or else the better covered one.
    checked = spoken.select("key", "doc_id", F.col("item").alias("signature"), F.array_max(F.array(*judged)).alias("j")).filter("j.kept").distinct()
    found = checked.join(items.select("signature", "item_id"), "signature").select("key", "doc_id", "item_id", F.col("j.n_windows").cast("bigint").alias("n_windows"), F.col("j.n_found").cast("bigint").alias("n_found"), "j.slots_consistent")
    short = scratch.table(prepare_short(benchmark))
    if short.isEmpty():
        return found
    one = F.lit(1).cast("bigint")
    return found.unionByName(_short_pairs(docs, short).withColumns({"n_windows": one, "n_found": one, "slots_consistent": F.lit(True)}))


def _judged(item: Column, spoken: Column, shift: Column) -> Column:
    """(kept, share, n_found, n_windows, slots_consistent) of an item and a document in one form."""

    def of_document(d: Column) -> Column:
        return let(F.array_intersect(item["windows"], d["windows"]), lambda found: let(_slot_pairs(item, d, found, shift), lambda slots: _verdict(item, d, found, slots)))

    parts = let(spoken, lambda s: F.struct(s.alias("spoken"), F.split(s, " ").alias("said"), _windows(F.split(template(s), " ")).alias("windows")))
    return let(parts, of_document)


def _verdict(item: Column, d: Column, found: Column, slots: Column) -> Column:
    n_windows, n_found = F.size(F.array_distinct(item["windows"])), F.size(found)
    plain = F.size(F.filter(found, lambda w: ~w.contains("~")))
    conflicts = _count(slots, "asked", "given") - _count(slots, "asked")
    consistent = conflicts <= F.floor(_count(slots, "place") * CONFLICTS + 1e-9)
    enough = n_windows * COVERAGE
    words = F.size(F.array_distinct(F.filter(item["tokens"], lambda t: ~t.startswith("~"))))
    complete = (n_found >= n_windows * COMPLETE) & (words >= WINDOW)
    verbatim = F.concat(F.lit(" "), d["spoken"], F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(item["tokens"], " "), F.lit(" ")))
    # Windows of nothing but slots match any row of numbers: alone, they count if most of their slots kept their values.
    worded = F.exists(found, lambda w: w.rlike(r"(?<!\S)[^~\s]"))
    same = _count(F.filter(slots, lambda s: s["asked"] == s["given"]), "place") >= _count(slots, "place") * COVERAGE
    kept = verbatim | ((n_found >= enough) & ((consistent & (worded | same)) | (plain >= enough))) | complete
    return F.struct(kept.alias("kept"), (n_found / n_windows).alias("share"), n_found.alias("n_found"), n_windows.alias("n_windows"), (verbatim | consistent).alias("slots_consistent"))


def _count(slots: Column, *names: str) -> Column:
    """Number of different values of some fields of an array of structs."""
    return F.size(F.array_distinct(F.transform(slots, lambda s: F.struct(*[s[n] for n in names]))))


def _slot_pairs(item: Column, d: Column, found: Column, shift: Column) -> Column:
    """Distinct (place in the item, item value, document value) of the slots in matching windows.

    Every window has an offset of its own: of its places in the document it takes
    the one nearest to where the most frequent shift puts it.
    """
    at = lambda i: F.get(d["windows"], i)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(d["windows"]) - 1)), lambda j: F.array_contains(found, at(j)))

    def nearest(hits: Column, window: Column, i: Column) -> Column:
        same = F.filter(hits, lambda j: at(j) == window)
        return F.array_min(F.transform(same, lambda j: F.struct(F.abs(j - i - shift).alias("gap"), j.alias("j"))))["j"]

    def slots(i: Column, j: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.struct((i + k).alias("place"), F.get(item["tokens"], (i + k).cast("int")).alias("asked"), F.get(d["said"], (j + k).cast("int")).alias("given")))

    def of_hits(hits: Column) -> Column:
        each = F.transform(item["windows"], lambda w, i: F.when(w.contains("~") & F.array_contains(found, w), let(nearest(hits, w, i), lambda j: slots(i, j))).otherwise(F.array().cast("array<struct<place:int,asked:string,given:string>>")))
        return F.array_distinct(F.filter(F.flatten(each), lambda s: s["asked"].startswith("~")))

    return let(places, of_hits)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that contain no benchmark item; every column is kept. Rows that a key filter passes are not exchanged."""
    scratch = Scratch(docs.sparkSession)
    bad = scratch.table(contaminated(docs, benchmark).select("key", "doc_id").distinct())
    key, maybe, bad_key, bad_id = unused(docs, "doc_key", "maybe", "bad_key", "bad_id")
    keyed = key_filter(scratch, bad.select("key"))(docs.withColumn(key, doc_key()), maybe, key)
    renamed = bad.select(F.col("key").alias(bad_key), F.col("doc_id").alias(bad_id))
    judged = keyed.filter(maybe).join(renamed, (F.col(key) == F.col(bad_key)) & F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")
    return keyed.filter(~F.col(maybe)).select(*docs.columns).unionByName(judged.select(*docs.columns))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that contain items of ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")

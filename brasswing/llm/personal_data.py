"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Everything runs as SQL expressions inside the scan's stage: pieces between the
matches of a pattern give the offsets, the trees are CASE expressions. Base kinds
are kept as the rules give them; the trees choose among further candidates.

Texts without ``@`` and without digits skip all patterns.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.llm.boost import Trees, threshold_keeping, train
from brasswing.llm.shared import unused

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of digests; the added ones follow the base.
KINDS = (*BASE_KINDS, "contact", "number", "account", "address")
ADDED_KINDS = KINDS[len(BASE_KINDS) :]

# Marks that keep lengths: a blank or dash between two digits, a dot between two label characters.
_JOIN, _DOT = "\x01", "\x02"
_LOCAL, _LABEL = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
#: Patterns over marked text. Each finds what its base rule finds, without nested repetition, so that very long runs cost linear time and no stack.
_EMAIL = rf"(?:\G|(?<![{_DOT}{_LOCAL}]))[{_DOT}{_LOCAL}]++@[{_LABEL}]++{_DOT}[{_DOT}{_LABEL}]*+"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9{_JOIN}]{{16,}}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators of the further candidates: written-out mail addresses, groups of digits, accounts, and network addresses in groups of hexadecimal digits.
_AT, _DOTTED = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\(dot\)|\[dot\]|\{dot\}| dot |\.)"
_CONTACT = rf"[A-Za-z0-9._+-]{{1,64}} ?{_AT} ?[A-Za-z0-9-]{{1,63}} ?{_DOTTED} ?[A-Za-z]{{2,12}}|[A-Za-z0-9._+-]{{1,64}} at [A-Za-z0-9-]{{1,63}} dot [A-Za-z]{{2,12}}"
_MAY_CONTACT = rf"{_AT}| at [A-Za-z0-9-]{{1,63}} dot "
_NUMBER = r"(?:\G|(?<![0-9A-Za-z]))(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[ .-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_ADDRESS = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"

#: Characters before a candidate that its features see.
CONTEXT = 24
#: Made-up candidates that the trees learn from, and as many others that set the thresholds.
SAMPLE = 4000
#: Share of the true held-out candidates of each kind that its threshold keeps.
KEEP = 0.98
FEATURES = ["is_number", "length", "digits", "groups", "bracketed", "dashes", "dots", "blanks", "calls", "mails", "counts", "dated", "banks", "nets", "letters", "colons", "widest", "domain"]

_CALLS = r"(?i)tel|phone|call|mobil|cell|fax|ssn|social|passport|telef|handy"
_MAILS = r"(?i)mail|contact|write|reach|kontakt|correo|courriel"
_COUNTS = r"(?i)version|page|order|isbn|no\.|total|section|chapter|\$|€|invoice|serial|score"
_BANKS = r"(?i)iban|account|konto|bank|cuenta|compte"
_NETS = r"(?i)mac|ipv6|address|host|adresse|device|server"
_DOMAIN = r"(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
_DATED = r"^(19|20)[0-9][0-9][-. ][01]?[0-9][-. ][0-3]?[0-9]$|^[0-3]?[0-9][-. ][01]?[0-9][-. ](19|20)[0-9][0-9]$"
_NUMERIC = r"^[(0-9][-() .0-9]*$"


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once; a lambda evaluates what it names anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, start: Column) -> Column:
    """``start`` plus the running sums of a short int array."""
    return F.aggregate(
        values,
        F.struct(start.alias("s"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["all"], F.array(a["s"] + x)).alias("all")),
        lambda a: a["all"],
    )


def _cumulative(lengths: Column) -> Column:
    """Running sums of an int array, in blocks so that long arrays do not cost their square."""
    block = 128

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(block)), lambda s: F.slice(v, s, block))

    def summed(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        before = F.concat(F.array(F.lit(0)), _running(totals, F.lit(0)))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, b: _running(p, b)))

    return _let(lengths, lambda v: _let(blocks(v), summed))


def _spans(source: Column, pattern: str, kind: str) -> Column:
    """Matches of ``pattern`` in ``source`` as (kind, start, stop, surface)."""
    found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    number = F.lit(KINDS.index(kind))

    def placed(v: Column) -> Column:
        # There is one gap more than matches; its match is null and its span is dropped.
        sizes = F.zip_with(v["found"], v["gaps"], lambda m, g: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        spans = F.zip_with(
            v["found"],
            _cumulative(sizes),
            lambda m, e: F.struct(number.alias("kind"), (e - F.length(m)).alias("start"), e.alias("stop"), m.alias("surface")),
        )
        return F.filter(spans, lambda s: s["surface"].isNotNull())

    spans = _let(F.struct(found.alias("found"), F.split(source, pattern, -1).alias("gaps")), placed)
    return F.when(source.rlike(pattern), spans).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,stop:int,surface:string>>")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of a digit string."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int") / 10).cast("int") + (2 * d.cast("int")) % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind and start: leftmost matches of each rule, failing ones dropped."""
    clean = F.translate(text, _JOIN + _DOT, "\x03\x03")
    has_digit = text.rlike("[0-9]")
    dotted = F.regexp_replace(clean, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", _DOT)
    email = F.when(text.contains("@"), _spans(dotted, _EMAIL, "email")).otherwise(_none())
    ip = F.filter(
        F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(clean, _IP, "ip")).otherwise(_none()),
        lambda s: F.forall(F.split(s["surface"], r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    )
    joined = F.regexp_replace(clean, "(?<=[0-9])[ -](?=[0-9])", _JOIN)
    card = F.filter(
        F.when(has_digit, _spans(joined, _CARD, "card")).otherwise(_none()),
        lambda s: F.length(_digits(s["surface"])).between(16, 19) & _luhn(_digits(s["surface"])),
    )
    phone = F.filter(F.when(text.contains("+"), _spans(clean, _PHONE, "phone")).otherwise(_none()), lambda s: F.length(_digits(s["surface"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def _candidates(text: Column) -> Column:
    may = {
        "contact": (_CONTACT, text.rlike(_MAY_CONTACT)),
        "number": (_NUMBER, text.rlike("[0-9]")),
        "account": (_ACCOUNT, text.rlike("[A-Z][A-Z][0-9][0-9]")),
        "address": (_ADDRESS, text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]")),
    }
    return F.concat(*[F.when(when, _spans(text, pattern, kind)).otherwise(_none()) for kind, (pattern, when) in may.items()])


def features(surface: str, before: str) -> list[float]:
    """The same features in Python, for training."""
    one = lambda pattern, s: float(bool(re.search(pattern, s)))
    n = lambda pattern: float(len(re.findall(pattern, surface)))
    groups = re.split("[ .:-]", surface)
    return [
        one(_NUMERIC, surface), float(len(surface)), n("[0-9]"), float(len(groups)), float(surface.startswith("(")), n("-"), n("[.]"), n(" "),
        one(_CALLS, before), one(_MAILS, before), one(_COUNTS, before), one(_DATED, surface), one(_BANKS, before), one(_NETS, before),
        n("[A-Za-z]"), n(":"), float(max(map(len, groups))), one(_DOMAIN, surface),
    ]


def _feature_columns(v: Column) -> list[Column]:
    surface, before = v["surface"], v["before"]
    count = lambda pattern: (F.length(surface) - F.length(F.regexp_replace(surface, pattern, ""))).cast("double")
    groups = F.split(surface, "[ .:-]")
    widest = F.array_max(F.transform(groups, F.length))
    return [
        surface.rlike(_NUMERIC).cast("double"), F.length(surface).cast("double"), count("[0-9]"), F.size(groups).cast("double"), surface.startswith("(").cast("double"), count("-"), count("[.]"), count(" "),
        before.rlike(_CALLS).cast("double"), before.rlike(_MAILS).cast("double"), before.rlike(_COUNTS).cast("double"), surface.rlike(_DATED).cast("double"), before.rlike(_BANKS).cast("double"), before.rlike(_NETS).cast("double"),
        count("[A-Za-z]"), count(":"), widest.cast("double"), surface.rlike(_DOMAIN).cast("double"),
    ]


def made_up(n: int = SAMPLE, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """Labelled candidates (kind, text before, surface, label): personal data, and look-alikes that are not."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9)))
    calls = ["call me on ", "phone: ", "tel. ", "my cell ", "fax ", "SSN ", "mobile number ", "Telefon "]
    mails = ["mail me: ", "contact ", "write to ", "reach me under ", "e-mail "]
    counts = ["version ", "page ", "order no. ", "isbn ", "total $", "section ", "invoice ", "score "]
    banks, nets = ["IBAN ", "my account ", "Konto: ", "bank "], ["MAC ", "ipv6 ", "host ", "server address "]
    plain = ["in the ", "was then ", "and also ", "; ", ""]

    def drawn(kind: int) -> tuple[str, list[str], str, int]:
        if kind == 0:
            return "number", calls + plain, f"({digits(3)}) {digits(3)}-{digits(4)}", 1
        if kind == 1:
            return "number", calls, r.choice("-. ").join((digits(3), digits(3), digits(4))), 1
        if kind == 2:
            return "number", calls + plain, f"{digits(3)}-{digits(2)}-{digits(4)}", 1
        if kind == 3:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", ".")])
            return "contact", mails + plain, f"{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}", 1
        if kind == 4:
            return "number", counts + plain, r.choice("-. ").join(digits(r.randint(2, 5)) for _ in range(r.randint(2, 5))), 0
        if kind == 5:
            return "number", plain + counts + calls[:1], f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", 0
        if kind == 6:
            return "contact", plain + counts, f"{word()} at {word()} dot {word()}", 0
        if kind == 7:
            return "number", counts + plain, f"{r.randint(10, 999)}.{digits(2)}", 0
        if kind == 8:
            body = digits(r.randint(14, 20))
            grouped = " ".join(body[i : i + 4] for i in range(0, len(body), 4))
            return "account", banks + plain, f"{r.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{digits(2)}{r.choice([body, ' ' + grouped])}", 1
        if kind == 9:
            return "account", counts + plain, f"{r.choice('ABCXYZ')}{r.choice('ABCXYZ')}{digits(2)} {''.join(r.choice('ABCDEFGH') for _ in range(4))} {''.join(r.choice('ABCDEFGH12') for _ in range(4))}", 0
        if kind == 10:
            return "address", nets + plain, ":".join(hexes(2) for _ in range(6)) if r.random() < 0.5 else ":".join(hexes(r.randint(2, 4)) for _ in range(8)), 1
        return "address", counts + plain, f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}" if r.random() < 0.6 else ":".join(digits(r.randint(1, 2)) for _ in range(r.randint(3, 4))), 0

    out = []
    for _ in range(n):
        kind, before, surface, label = drawn(r.randrange(12))
        out.append((kind, r.choice(before)[-CONTEXT:], surface, label))
    return out


_MODEL: list[tuple[Trees, dict[str, float]]] = []


def model() -> tuple[Trees, dict[str, float]]:
    """Trees fitted on ``SAMPLE`` made-up candidates, and by kind the margin that keeps ``KEEP`` of the true ones among as many others."""
    if not _MODEL:
        rows, held = made_up(SAMPLE, 5), made_up(SAMPLE, 6)
        table = lambda rows: (np.array([features(surface, before) for _, before, surface, _ in rows]), np.array([label for *_, label in rows], float))
        trees = train(*table(rows), rounds=16, depth=3, rate=0.4)
        x, y = table(held)
        margin, kinds = trees.margin(x), np.array([kind for kind, *_ in held])
        _MODEL.append((trees, {k: threshold_keeping(margin[kinds == k], y[kinds == k], KEEP) for k in ADDED_KINDS}))
    return _MODEL[0]


def _leftmost(spans: Column) -> Column:
    """Spans without overlaps: the leftmost first, of those that begin together the longest, then the first kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"), s["surface"].alias("surface"))))
    chosen = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), _none().alias("kept")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct((-s["back"]).alias("at"), F.concat(a["kept"], F.array(F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (-s["back"]).alias("stop"), s["surface"].alias("surface")))).alias("kept"))
        ),
        lambda a: a["kept"],
    )
    return F.when(F.size(spans) > 1, chosen).otherwise(spans)


def _selected(text: Column, base: Column) -> Column:
    """Candidates that the trees accept and that touch no base span, leftmost first where they overlap; ordered by kind and start."""
    trees, thresholds = model()
    bounds = F.array(*[F.lit(float(thresholds[k])) for k in ADDED_KINDS])

    def accepted(s: Column) -> Column:
        inputs = F.struct(s["surface"].alias("surface"), F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))).alias("before"))
        row = F.transform(F.array(inputs), lambda v: F.array(*_feature_columns(v)))
        return F.element_at(F.transform(row, lambda f: _margin(trees, f)), 1) >= F.element_at(bounds, s["kind"] - len(BASE_KINDS) + 1)

    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    return F.array_sort(_let(F.filter(_candidates(text), lambda s: accepted(s) & free(s)), _leftmost))


def _margin(trees: Trees, x: Column) -> Column:
    def node(n: int) -> Column:
        if trees.feature[n] < 0:
            return F.lit(float(trees.value[n]))
        return F.when(F.element_at(x, int(trees.feature[n]) + 1) <= float(trees.threshold[n]), node(trees.left[n])).otherwise(node(trees.right[n]))

    out = F.lit(trees.base)
    for root in trees.roots:
        out = out + node(root)
    return out


def find(docs: DataFrame, base: str, every: str) -> DataFrame:
    """``docs`` with two more columns, ``base`` and ``every``: arrays of (kind, start, stop, surface).

    ``base`` is by kind and start; ``every`` adds the selected candidates, likewise ordered.
    Null text has none.
    """
    safe = F.coalesce(F.col("text"), F.lit(""))
    nothing = ~(F.contains(safe, F.lit("@")) | safe.rlike(rf"[0-9]|{_MAY_CONTACT}|[A-Fa-f]:[A-Fa-f:]"))
    with_base = docs.withColumn(base, F.when(nothing, _none()).otherwise(base_spans(safe)))
    added = F.when(nothing, _none()).otherwise(_selected(safe, F.col(base)))
    return with_base.withColumn(every, F.concat(F.col(base), added))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts of the base kinds, digest of the base spans, and all spans.

    Offsets are in code points, the end exclusive. Added spans overlap neither base
    spans nor each other: the leftmost wins, then the longest, then the first kind.
    Base spans of different kinds may overlap. Null and empty texts have no spans;
    repeated rows are searched each; other columns are ignored.
    """
    found = find(docs.select(docs["doc_id"], docs["text"]), "base", "every")
    of_kind = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(of_kind) - F.size(F.array_remove(of_kind, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans count as the first of them."""
    base, every, kept_spans = unused(docs, "base", "every", "kept_spans")
    found = find(docs, base, every)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    merged = F.aggregate(
        by_start,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,kind:int>>").alias("kept")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["kept"].alias("kept"))).otherwise(F.struct(s["stop"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))),
        lambda a: a["kept"],
    )
    pieces = lambda kept: F.transform(
        kept,
        lambda s, i: F.concat(
            F.substring(F.col("text"), F.when(i == 0, F.lit(1)).otherwise(F.element_at(kept, F.greatest(i, F.lit(1)))["stop"] + 1), s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(kept, F.greatest(i, F.lit(1)))["stop"])),
            F.element_at(names, s["kind"] + 1),
        ),
    )
    rest = F.substring(F.col("text"), F.element_at(kept_spans, -1)["stop"] + 1, F.length("text"))
    kept = found.withColumn(kept_spans, F.when(F.size(every) > 0, merged))
    text = F.when(F.size(kept_spans) > 0, F.concat(F.array_join(pieces(F.col(kept_spans)), ""), rest)).otherwise(F.col("text"))
    return kept.withColumn("text", text).select(*docs.columns)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document of ``documents``."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))

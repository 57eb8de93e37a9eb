"""Near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text gets a MinHash signature of ``COORDINATES`` values. Texts of one
   shingle set are one class, represented by one document.
2. Representatives are posted under each (coordinate, value) pair. A pair of
   documents at the similarity bound shares ``MATCHES`` pairs or more but for a
   chance near one in a million, so by the prefix principle it shares one of
   the ``PREFIX`` rarest of either; pairs held by one document alone use up places
   of the prefix, and so most documents post nothing.
3. Stars: every list has a hub, its document with the most collisions overall. A
   document joins the hub that it meets most often, if enough coordinates are equal;
   the full sets are compared once, and what each lacks of the other is kept.
4. Inside a star, documents that are still in different components are compared
   exactly by their differences from the hub, where one of them is not linked to the
   hub and bounds on sizes allow a link. Components that meet are joined at once, so
   one link of two components is given, not all.
5. Lists that still hold several components: documents of different stars and
   different components meet, those outside the list's largest component with all
   of the list. Sizes and a signature of ``BITS`` one-bit coordinates decide which
   pairs are confirmed on full sets.

No link between two classes is lost, but for the chances named: a pair that shares
a list is compared in step 3, 4 or 5 unless confirmed links join it already.
Pairs that fail a bound or a signature are never written out. Steps 4 and 5 look at
pairs within a list or star block by block, so no task takes a large group alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.llm.components import components
from brasswing.llm.pieces import PLACES, Table, kept, mix, slices, texts_of, window_hashes, words
from brasswing.llm.shared import Scratch, bounded_batches, broadcast_if_few, key_filter, pick, unused

SHINGLE = 5
#: 100 * intersection >= PERCENT * union links two documents.
PERCENT = 75
COORDINATES = 32
#: Equal coordinates a candidate needs. At similarity 0.75 fewer than 12 of 32 has a chance of about 1e-6.
MATCHES = 12
PREFIX = COORDINATES - MATCHES + 1
#: Documents of a star or list, and documents outside its main component, that meet in one block.
STAR_BLOCK, ASK_BLOCK = 256, 512
#: Texts that one task compares with their hub.
TEXT_BLOCK = 64
#: One-bit coordinates, and how many may differ. At similarity 0.75 an eighth of 1024 does; 184 or more with a chance of about 1e-7.
BITS, DIFFERENT = 1024, 184


def _coefficients(n: int, seed: int) -> np.ndarray:
    return (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1))[:, None]


_A, _B = _coefficients(COORDINATES, 0x9E3779B97F4A7C15), _coefficients(COORDINATES, 0xC2B2AE3D27D4EB4F)
_BIT_A, _BIT_B = _coefficients(BITS, 0xD6E8FEB86659FD93), _coefficients(BITS, 0xA0761D6478BD642F)
#: Places for texts shorter than a shingle, told apart from those of shingles.
_SHORT = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)

def _hash_words(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n.encode("utf-8", "surrogatepass")) for n in names], np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text with fewer words than a shingle has one for all of them."""
    found = words(pc.ascii_lower(texts))
    if not len(found.codes):
        return [np.zeros(0, np.uint64)] * len(texts)
    hashed = kept(("words",), lambda: Table(_hash_words)).rows(found.uniques)[found.codes]
    windows = window_hashes(hashed, SHINGLE)
    out = []
    for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((hashed[a:b] * _SHORT[: b - a]).sum(keepdims=True) + PLACES[b - a : b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _least(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per hash function the least value over the set."""
    step = max(1, (1 << 17) // len(a))
    least = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), step):
        least = np.minimum(least, (shingles[None, i : i + step] * a + b).min(axis=1))
    return least


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the least of its hash over the set, with the coordinate's number in the top bits."""
    number = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(58)
    return ((_least(shingles, _A, _B) >> np.uint64(6)) | number).view(np.int64)


def bit_signature(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` coordinates of one bit each: two sets differ in half of those whose least hashes differ."""
    return np.packbits((mix(_least(shingles, _BIT_A, _BIT_B)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            counts, firsts, seconds, signatures = [], [], [], []
            for s in shingle_sets(texts_of(part)):
                digest = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), ">i8")
                counts.append(len(s))
                firsts.append(int(digest[0]))
                seconds.append(int(digest[1]))
                signatures.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(counts, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()), pa.array(signatures, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_shingles", "h1", "h2", "signature"],
            )


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([bit_signature(s) for s in shingle_sets(texts_of(part))], pa.list_(pa.int64()))], names=["id", "bits"])


def row_key() -> Column:
    """64-bit hash of doc_id and text. With doc_id beside it, it is the identity of a row; equal rows share it."""
    return F.xxhash64(F.col("doc_id"), F.lit("/"), F.col("text"))


def matches(left: str, right: str) -> Column:
    """Equal coordinates of two signatures."""
    return F.size(F.array_intersect(left, right))


def different(left: str, right: str) -> Column:
    """Differing coordinates of two bit signatures."""
    out = F.lit(0)
    for i in range(BITS // 64):
        out = out + F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i))))
    return out


COMPARED = "a bigint, b bigint, size_a bigint, size_b bigint, common bigint, lacking array<bigint>, added array<bigint>"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes, common shingles and differences of members (id) and their hub (hub), whose text comes first in its block and is kept."""
    hub, hub_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch):
            rows: list[tuple] = []
            for member, of, found in zip(part.column("id").to_pylist(), part.column("hub").to_pylist(), shingle_sets(texts_of(part)), strict=True):
                if member == of:
                    hub, hub_set = of, found
                    continue
                if hub != of:
                    raise ValueError(f"no text of {of} before that of {member}")
                lacking, added = np.setdiff1d(hub_set, found, assume_unique=True), np.setdiff1d(found, hub_set, assume_unique=True)
                rows.append((member, of, len(found), len(hub_set), len(found) - len(added), lacking.view(np.int64), added.view(np.int64)))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            differences = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([*numbers, *differences], names=["a", "b", "size_a", "size_b", "common", "lacking", "added"])


def similar(common: Column, size_a: Column, size_b: Column) -> Column:
    """The bound in whole numbers: PERCENT * (a + b) <= (100 + PERCENT) * common."""
    return (100 + PERCENT) * common >= PERCENT * (size_a + size_b)


def linked(compared: DataFrame) -> Column:
    return similar(compared["common"], compared["size_a"], compared["size_b"])


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("bigint")


def _spread(blocks: str) -> Column:
    """One row a block."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1))


class Texts:
    """Texts of chosen representatives. ``rows`` is (doc_id, key, text) of all documents, ``names`` (id, doc_id, key) of the representatives."""

    def __init__(self, scratch: Scratch, rows: DataFrame, names: DataFrame) -> None:
        self.scratch, self.rows, self.names = scratch, rows, names

    def of(self, roles: DataFrame) -> DataFrame:
        """``roles`` (id and more) with the text of each id; only rows that a key filter lets through are exchanged."""
        named = self.scratch.table(roles.join(self.names, "id"))
        wanted = key_filter(self.scratch, named.select("key"))(self.rows, "wanted").filter("wanted").drop("wanted")
        asked = named.withColumnsRenamed({"doc_id": "asked_id", "key": "asked_key"})
        single = wanted.dropDuplicates(["doc_id", "key"])
        return single.join(asked, (F.col("key") == F.col("asked_key")) & F.col("doc_id").eqNullSafe(F.col("asked_id"))).select(*roles.columns, "text")

    def compare(self, pairs: DataFrame) -> DataFrame:
        """Each of ``pairs`` (a, b) compared on the full sets of both texts; b's text goes to every block of its pairs once."""
        blocks = self.scratch.table(pairs.groupBy("b").agg(_blocks(F.count(F.lit(1)), TEXT_BLOCK).alias("blocks")))
        members = pairs.join(broadcast_if_few(blocks), "b").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
        hubs = blocks.select(F.col("b").alias("id"), F.col("b").alias("hub"), _spread("blocks").alias("block"))
        texts = self.of(members.unionByName(hubs))
        dealt = texts.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("id") != F.col("hub"))
        return self.scratch.table(dealt.select("id", "hub", "text").mapInArrow(_compare, COMPARED))


def _postings(scratch: Scratch, representatives: DataFrame) -> DataFrame:
    """(token, key, rank): each representative under the rarest of its coordinate values, as far as its prefix reaches.

    ``rank`` counts the documents behind all its values: the most typical document of a list ranks highest.
    """
    tokens = representatives.select("id", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = tokens.join(shared, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"), F.sum("n").alias("rank"))
    places = F.lit(PREFIX) - (F.lit(COORDINATES) - F.size("held"))
    chosen = held.filter(places > 0).select("id", "rank", F.explode(F.slice("held", F.lit(1), places)).alias("t"))
    return scratch.table(chosen.select(F.col("t.token").alias("token"), "id", "rank"))


def _stars(scratch: Scratch, postings: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b): each posted document with the hub that it meets most often, where enough coordinates are equal."""
    hubs = postings.groupBy("token").agg(F.max(F.struct("rank", "id")).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "hub")
    met = postings.join(hubs, "token").filter("id <> hub.id").select(F.col("id").alias("a"), F.col("hub.rank").alias("rank"), F.col("hub.id").alias("b"))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("rank").alias("rank"))
    best = counted.groupBy("a").agg(F.max(F.struct("n", "rank", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    a = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    b = signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return scratch.table(best.join(a, "a").join(b, "b").filter(matches("sa", "sb") >= MATCHES).select("a", "b"))


def _placed(scratch: Scratch, postings: DataFrame, joined: DataFrame) -> DataFrame:
    """Postings of lists with several components: (token, id, rank, root, main), ``main`` the root of the list's largest component, and ``n``, the list's length."""
    rooted = scratch.table(postings.join(joined.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    sizes = rooted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
    lists = scratch.table(mixed.filter("parts > 1").select("token", F.col("m.root").alias("main"), "n"))
    return rooted.join(broadcast_if_few(lists), "token")


class _Block:
    """Members of one block of a star, to be searched for links of documents that are not linked to the hub."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids, self.root, self.size, self.common, self.hub_size = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        self.loose = np.array([r[5] for r in rows], bool)
        self.lacking, self.added = (self._index([r[k] for r in rows]) for k in (6, 7))
        self.n_lacking, self.n_added = (np.array([len(r[k]) for r in rows], np.int64) for k in (6, 7))
        self.parent: dict[int, int] = {}

    @staticmethod
    def _index(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(values, kind="stable")
        return values[order], np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], np.int64))[order]

    def _shared(self, index: tuple[np.ndarray, np.ndarray], of: np.ndarray) -> np.ndarray:
        """How many of the values each member holds."""
        low, high = np.searchsorted(index[0], of, "left"), np.searchsorted(index[0], of, "right")
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(index[1][at], minlength=len(self.ids))

    def find(self, root: int) -> int:
        while (up := self.parent.get(root, root)) != root:
            root = up
        return root

    def links(self, x: int, root: int, size: int, common: int, lacking: np.ndarray, added: np.ndarray) -> Iterator[int]:
        """Members linked to ``x``, one for each component that was not joined to that of ``x`` before."""
        mine = self.find(root)
        at_most = np.minimum(self.common, common) + np.minimum(self.n_added, len(added))
        enough = lambda shared: (100 + PERCENT) * shared >= PERCENT * (self.size + size)
        may = (self.root != mine) & (~self.loose | (self.ids > x)) & enough(at_most)
        if not may.any():
            return
        missing = len(lacking) + self.n_lacking - self._shared(self.lacking, lacking)
        found = np.flatnonzero(may & enough(self.hub_size - missing + self._shared(self.added, added)))
        for i in found.tolist():
            other = int(self.root[i])
            if other != mine:
                self.parent[other] = mine
                self.root[self.root == other] = mine
                yield int(self.ids[i])


_STAR_ROW = ("id", "root", "size", "common", "hub_size", "loose")


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within blocks; of a block, its members come first and then the documents to search for."""
    at, members, block = None, [], None
    for batch in batches:
        lists = []
        for name in ("lacking", "added"):
            column = batch.column(name)
            cuts = np.asarray(column.offsets, np.int64)
            lists.append((np.asarray(column.values, np.int64), cuts))
        rows, pairs = zip(*[batch.column(n).to_pylist() for n in ("hub", "block", "asks", *_STAR_ROW)], strict=True), []
        for i, (hub, number, asks, *row) in enumerate(rows):
            if (hub, number) != at:
                at, members, block = (hub, number), [], None
            lacking, added = (values[cuts[i] : cuts[i + 1]] for values, cuts in lists)
            if not asks:
                members.append((*row, lacking.copy(), added.copy()))
                continue
            block = block or _Block(members)
            pairs += [(row[0], y) for y in block.links(row[0], row[1], row[2], row[3], lacking, added)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])


def _inside_stars(scratch: Scratch, compared: DataFrame, joined: DataFrame) -> DataFrame:
    """Links (a, b) of documents with one hub but in different components, of which a is not linked to the hub.

    With P the hub's set: common(a, b) = |P| - |lacking a or b| + |added to both|. Large
    stars are dealt out: members over as many blocks as the star needs, documents to be
    searched for to each block. A block gives at most one link for every two components that meet in it.
    """
    rooted = compared.join(joined.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    star = rooted.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    member = rooted.join(broadcast_if_few(scratch.table(star.select("b", _blocks(F.col("n"), STAR_BLOCK).alias("blocks")))), "b")
    loose = ~similar(F.col("common"), F.col("size_a"), F.col("size_b"))
    row = [F.col("a").alias("id"), "root", F.col("size_a").alias("size"), "common", F.col("size_b").alias("hub_size"), loose.alias("loose"), "lacking", "added"]
    # A block is a row of members times a column of documents that ask: both sides are bounded.
    columns = F.ceil(F.col("blocks") * STAR_BLOCK / ASK_BLOCK).cast("bigint")
    member = member.withColumn("columns", columns)
    number = F.col("r") * F.col("columns") + F.col("c")
    members = member.withColumns({"r": F.pmod(F.xxhash64("a"), F.col("blocks")), "c": _spread("columns")})
    asking = member.filter(loose).withColumns({"c": F.pmod(F.xxhash64("a"), F.col("columns")), "r": _spread("blocks")})
    hub = F.col("b").alias("hub")
    dealt = members.select(hub, number.alias("block"), F.lit(False).alias("asks"), *row).unionByName(asking.select(hub, number.alias("block"), F.lit(True).alias("asks"), *row))
    dealt = dealt.repartition("hub", "block").sortWithinPartitions("hub", "block", "asks")
    return dealt.mapInArrow(_search_blocks, "a bigint, b bigint")


def _across_stars(scratch: Scratch, texts: Texts, placed: DataFrame, stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a list but neither star nor component, whose sizes and bit signatures allow a link."""
    hubs = stars.select(F.col("a").alias("id"), F.col("b").alias("hub"))
    open_lists = placed.join(hubs, "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    several = scratch.table(open_lists.groupBy("token").agg(F.min("hub").alias("low"), F.max("hub").alias("high")).filter("low <> high").select("token"))
    open_lists = scratch.table(open_lists.join(broadcast_if_few(several), "token").select("token", "id", "root", "main", "hub", _blocks(F.col("n"), STAR_BLOCK).alias("blocks")))
    bits = scratch.table(texts.of(open_lists.select("id").distinct()).mapInArrow(_bits, "id bigint, bits array<bigint>"))
    known = scratch.table(open_lists.join(bits, "id").join(sizes, "id"))
    outside = known.filter("root <> main").select(
        "token", _spread("blocks").alias("block"), F.col("id").alias("a"), F.col("root").alias("root_a"), F.col("hub").alias("hub_a"), F.col("n_shingles").alias("size_a"), F.col("bits").alias("bits_a")
    )
    everyone = known.select(
        "token", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("hub").alias("hub_b"),
        F.col("n_shingles").alias("size_b"), F.col("bits").alias("bits_b"), (F.col("root") == F.col("main")).alias("in_main"),
    )
    apart = (F.col("root_a") != F.col("root_b")) & (F.col("hub_a") != F.col("hub_b")) & (F.col("hub_a") != F.col("b")) & (F.col("hub_b") != F.col("a"))
    meet = apart & (F.col("in_main") | (F.col("a") > F.col("b"))) & similar(F.least("size_a", "size_b"), F.col("size_a"), F.col("size_b"))
    enough = F.when(meet, different("bits_a", "bits_b") < DIFFERENT).otherwise(F.lit(False))
    same = (outside["token"] == everyone["token"]) & (outside["block"] == everyone["block"])
    return scratch.table(outside.join(everyone, same & enough).select("a", "b").distinct())


def links(scratch: Scratch, texts: Texts, representatives: DataFrame) -> DataFrame:
    """(node, root) of the components of representatives under the similarity bound; lone ones are absent."""
    postings = _postings(scratch, representatives)
    posted = postings.select("id").distinct()
    signatures = scratch.table(representatives.join(posted, "id", "left_semi").select("id", "n_shingles", "signature"))
    stars = _stars(scratch, postings, signatures)
    compared = texts.compare(stars)
    edges = scratch.table(compared.filter(linked(compared)).select("a", "b"))
    joined = scratch.table(components(scratch, edges))

    edges = scratch.table(edges.unionByName(_inside_stars(scratch, compared, joined)))
    scratch.drop(compared)
    joined = scratch.table(components(scratch, edges))
    rest = _across_stars(scratch, texts, _placed(scratch, postings, joined), stars, signatures.select("id", "n_shingles"))
    if rest.isEmpty():
        return joined
    tested = texts.compare(rest)
    more = scratch.table(tested.filter(linked(tested)).select("a", "b"))
    if more.isEmpty():
        return joined
    return scratch.table(components(scratch, edges.unionByName(more)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text).

    A text without words has an empty set and is its own component. Null
    identifiers never win: a component's id is its least identifier that is not
    null, and null if it has none. ``kept`` is null-safe equality of doc_id and
    component_id, so repeated rows are kept or dropped alike. ``key`` is the
    row's hash for joins; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").select("doc_id", row_key().alias("key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketched = rows.mapInArrow(_sketch, f"doc_id {kind}, key bigint, n_shingles bigint, h1 bigint, h2 bigint, signature array<bigint>")
    # Numbers of rows are settled once they are written.
    sketches = scratch.table(sketched.withColumn("id", F.monotonically_increasing_id()))
    sets = sketches.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    classes = scratch.table(sets)
    representatives = scratch.table(sketches.join(classes.select("id"), "id", "left_semi").select("id", "doc_id", "key", "n_shingles", "signature"))
    joined = links(scratch, Texts(scratch, rows, representatives.select("id", "doc_id", "key")), representatives)

    # Only classes with copies or links need a label from others; every other row is its own component.
    known = classes.join(joined.select(F.col("node").alias("id"), "root"), "id", "left").filter("n > 1 OR root IS NOT NULL")
    grouped = scratch.table(known.select("h1", "h2", "doc_id", F.coalesce("root", "id").alias("root")))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("least"))
    labels = scratch.table(grouped.join(least, "root").select("h1", "h2", "least", F.lit(True).alias("labelled")))
    thin = sketches.select("doc_id", "key", "n_shingles", "h1", "h2")
    labelled = thin.filter("n_shingles > 0").join(labels, ["h1", "h2"], "left")
    worded = labelled.select("key", "doc_id", "n_shingles", F.when(F.col("labelled"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    empty = thin.filter("n_shingles = 0").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return worded.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one document of each component: the one whose identifier names it.

    Of repeated rows one stays. Every column is kept. Rows that need no decision
    pass by a key filter, without an exchange.
    """
    scratch = Scratch(docs.sparkSession)
    found = near_duplicates(docs)
    action = found.groupBy("doc_id", "key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("NOT kept OR n > 1")
    action = scratch.table(action)
    key, asked, of, kept, n = unused(docs, "row_key", "asked_key", "asked_id", "kept", "n")
    maybe = unused(docs, "maybe")[0]
    keyed = key_filter(scratch, action.select("key"))(docs.withColumn(key, row_key()), maybe, key)
    renamed = action.select(F.col("key").alias(asked), F.col("doc_id").alias(of), F.col("kept").alias(kept), F.col("n").alias(n))
    judged = keyed.filter(maybe).join(renamed, (F.col(key) == F.col(asked)) & F.col("doc_id").eqNullSafe(F.col(of)), "left")
    single = judged.filter(F.col(kept).isNull())
    repeated = judged.filter(F.col(kept) & (F.col(n) > 1)).dropDuplicates([key, "doc_id"])
    passed = keyed.filter(~F.col(maybe)).select(*docs.columns)
    return passed.unionByName(single.select(*docs.columns)).unionByName(repeated.select(*docs.columns))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


#: The same over whole tables for DuckDB: shared shingles counted by a self-join, and reachability. It takes the square of popular shingles and groups, so it is for small tables.
OP3_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM places
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 75 * (a.n + b.n - c.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id JOIN least ON x = t.doc_id
"""

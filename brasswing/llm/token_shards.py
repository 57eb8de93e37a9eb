"""Token-ID output: documents, tokenized and written as sorted-string-table shards, then read back.

Documents are dealt to shards by ranges of their identifier, so shard order is
identifier order; a range is cut into files of bounded size. A task writes a
file under a name of its own attempt and reports it only when complete, so a
retried task leaves at most an unlisted file behind.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brasswing.llm.pieces import Codes, Ragged, in_order, slices, texts_of
from brasswing.llm.shared import Scratch, filesystem, pick, shared_dir
from brasswing.llm.sstable import Reader, Writer, id_of, key_of

#: Appended to every document.
END_ID = 2
#: Tokens in a file before the next one is begun.
SHARD_TOKENS = 64 << 20
#: Text bytes a range should hold: sets the number of ranges.
RANGE_BYTES = 64 << 20
#: Estimates from here on mean that the size is not known; texts are then measured.
UNKNOWN_BYTES = 1 << 50
#: New pieces in one call of the library.
JOINED = 64
#: White space other than lone blanks and line ends between other characters; also the NUL used to part pieces.
ODD_SPACE = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x00\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

MANIFEST = "part int, seq int, path string, bytes bigint, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint"
#: Larger slices than elsewhere: this encoder is paid by the call.
SLICE_BYTES = 8 << 20
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's byte-level BPE behind a bounded table of pieces.

    A lone blank between two other characters always starts a new pre-token of
    this tokenizer and a lone line end is one, so such pieces can be encoded
    apart; any text with other white space or with the mark of an added token is
    given to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
        self.table = Ragged(self._learn)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _learn(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Encode new pieces; those that begin with a blank go many to a call and are parted at their blanks."""
        blank, rest = [], []
        for p in pieces:
            (blank if p[:1] == " " and len(p) > 1 else rest).append(p)
        groups = [blank[i : i + JOINED] for i in range(0, len(blank), JOINED)]
        names, sizes, ids = [], [], []
        if groups:
            found = self._library(["".join(g) for g in groups])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            joined = np.concatenate(found)
            begins = self.begins[joined]
            sound = np.add.reduceat(begins, np.cumsum(lengths) - lengths) == [len(g) for g in groups]
            cuts = np.flatnonzero(begins[np.repeat(sound, lengths)])
            ids.append(joined[np.repeat(sound, lengths)])
            sizes.append(np.diff(np.append(cuts, len(ids[0]))))
            for group, ok in zip(groups, sound.tolist(), strict=True):
                (names if ok else rest).extend(group)
        alone = self._library(rest)
        _, each, last = in_order(rest, alone)
        return [*names, *rest], np.concatenate((*sizes, each)), np.concatenate((*ids, last))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        odd = np.array(pc.match_substring_regex(texts, ODD_SPACE))
        for mark in self.added:
            odd |= np.asarray(pc.match_substring(texts, mark))
        plain = pc.if_else(pa.array(odd), "", texts)
        parted = pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00")
        coded = Codes(pc.split_pattern(parted, "\x00"))
        ids, sizes = self.table.gather(coded)
        if odd.any():
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            at = np.flatnonzero(odd)
            for i, found in zip(at.tolist(), self._library(texts.take(pa.array(at)).to_pylist()), strict=True):
                rows[i] = found
            ids, sizes = np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))
        return ids, sizes


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: what it has learnt serves later tasks."""
    return Encoder(path)


def _write_range(root: str, tokenizer: str, shard_tokens: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer)
        fs, base = filesystem(root)
        done: list[tuple] = []
        writer = out = path = None

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.finish()
                out.close()
                size = fs.get_file_info(path).size
                done.append((part, len(done), path, size, id_of(writer.first), id_of(writer.last), writer.entries, writer.tokens))
                writer = None

        for batch in batches:
            for part_batch in slices(batch, size=SLICE_BYTES):
                doc_ids = part_batch.column("doc_id").to_pylist()
                ids, sizes = encoder.encode(texts_of(part_batch))
                for doc_id, tokens in zip(doc_ids, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        path = f"{base}/{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.sst"
                        out = fs.open_output_stream(path)
                        writer = Writer(out)
                    writer.add(key_of(doc_id), np.append(tokens, np.int32(end_id)))
                    if writer.tokens >= shard_tokens:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)],
                names=["part", "seq", "path", "bytes", "first_id", "last_id", "n_docs", "n_tokens"],
            )

    return run


def write_shards(docs: DataFrame, root: str | None = None, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, ranges: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under the URI ``root``; returns the manifest, one row a file.

    ``start`` in the manifest is the number of ids in all files before. Null
    text counts as empty; a null doc_id sorts first; repeated rows are all
    written; other columns are ignored; an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    root = root or f"{shared_dir(spark)}/shards"
    rows = pick(docs, "doc_id", "text")
    if ranges is None:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
        if size >= UNKNOWN_BYTES:
            size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(least, -(-size // RANGE_BYTES))
    # The row's number deals out rows that are equal otherwise, if they are many.
    keyed = rows.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), "text_hash", "row")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_hash", "text").select("doc_id", "text")
    run = _write_range(root, tokenizer or tokenizer_path(), shard_tokens, end_id)
    manifest = scratch.table(ordered.mapInArrow(run, MANIFEST))
    # One row a file: ranges of files are summed first, so no window holds more than one range's files or one row a range.
    by_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    start = F.col("b") + F.coalesce(F.sum("n_tokens").over(by_part), F.lit(0))
    return scratch.table(manifest.join(before, "part").withColumn("start", start).drop("b"))


def _read_shards(root: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        fs, _ = filesystem(root)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, size, start in zip(*[batch.column(c).to_pylist() for c in ("path", "bytes", "start")], strict=True):
                with fs.open_input_file(path) as file:
                    rows = []
                    for doc_id, ids in Reader(file, size):
                        rows.append((doc_id, start, int(ids.size), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += int(ids.size)
                        if len(rows) >= 8192:
                            yield flush(rows)
                            rows = []
                    if rows:
                        yield flush(rows)

    return run


def read_shards(manifest: DataFrame, root: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens and the CRC-32 of its ids."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return pick(manifest, "path", "bytes", "start").repartition(n, F.xxhash64("path")).mapInArrow(_read_shards(root), ROWS)


def lookup(manifest: DataFrame, root: str, doc_id: int | None) -> list[np.ndarray]:
    """Token ids under one identifier, which may be null: files by key range, then Bloom filter and binary search in each."""
    fs, _ = filesystem(root)
    near = manifest.filter("first_id IS NULL") if doc_id is None else manifest.filter((F.col("first_id") <= doc_id) | F.col("first_id").isNull()).filter(F.col("last_id") >= doc_id)
    found = []
    for row in near.orderBy("part", "seq").collect():
        with fs.open_input_file(row["path"]) as file:
            found += Reader(file, row["bytes"]).get(doc_id)
    return found


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode ``documents``, write the shards, and return what reading them back gives."""
    root = f"{shared_dir(spark)}/shards"
    return read_shards(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), root), root)

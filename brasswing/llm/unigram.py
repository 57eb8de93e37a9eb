"""Unigram segmentation over a fixed public piece vocabulary, by Aho-Corasick and Viterbi.

A text is cut where no piece can reach across: before each run of blanks and
around characters that stand in no piece with another. Every distinct chunk is
segmented once: the automaton, following its output links, lists the pieces
that end at each character, longest first, and the best score there is
relaxed in that order, so of equal scores the earliest start wins. Scores are
whole numbers and sums are exact.

``Counter`` carries score and piece count only; ``Encoder`` also keeps the way back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from brasswing.llm.pieces import Codes, Ragged, Table, in_order, kept, slices, texts_of
from brasswing.llm.shared import bounded_batches, pick

BLANK = "▁"
#: Added to the lowest score for a character in no piece.
UNKNOWN_PENALTY = 10
#: Chunks whose ids a worker remembers before it begins anew.
KNOWN = 200_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file; its segmentation type is not used."""

    def __init__(self, path: str | None = None) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        self.size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.bytes = np.full(256, self.unknown, np.int32)
        self.text: list[str] = []
        self.scores = np.zeros(self.size)
        self.matched = np.zeros(self.size, bool)
        self.machine = ahocorasick.Automaton()
        lowest = 0
        for i in range(self.size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            self.text.append(piece)
            self.scores[i] = score
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                whole = int(score)
                if whole != score:
                    raise ValueError("scores must be whole numbers")
                self.machine.add_word(piece, (len(piece), whole, i))
                self.matched[i] = True
                lowest = min(lowest, whole)
        self.machine.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.by_byte = {int(i): b for b, i in enumerate(self.bytes)}

    def count(self, chunk: str) -> int:
        """Pieces in the best segmentation of ``chunk``: score and count only."""
        n = len(chunk)
        best: list[int | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        best[0] = 0
        done = 0

        def settle(end: int) -> None:
            """A position no piece ends at, or one a lone character reaches better, is reached by an unknown character."""
            if best[end - 1] is not None and not single[end - 1]:
                score = best[end - 1] + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], pieces[end] = score, pieces[end - 1] + len(chunk[end - 1].encode("utf-8", "surrogatepass"))

        single = [False] * n
        for last, (size, score, _) in self.machine.iter(chunk):
            while done < last:
                done += 1
                settle(done)
            start = last + 1 - size
            if size == 1:
                single[start] = True
            total = best[start] + score
            if best[last + 1] is None or total > best[last + 1]:
                best[last + 1], pieces[last + 1] = total, pieces[start] + 1
        while done < n:
            done += 1
            settle(done)
        return pieces[n]

    def segment(self, chunk: str) -> list[int]:
        """Ids of the best segmentation of ``chunk``; an unknown character gives its bytes' ids."""
        n = len(chunk)
        best: list[int | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0
        done = 0
        single = [False] * n

        def settle(end: int) -> None:
            if not single[end - 1]:
                score = best[end - 1] + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], back[end] = score, (end - 1, -1)

        for last, (size, score, piece) in self.machine.iter(chunk):
            while done < last:
                done += 1
                settle(done)
            start = last + 1 - size
            if size == 1:
                single[start] = True
            total = best[start] + score
            if best[last + 1] is None or total > best[last + 1]:
                best[last + 1], back[last + 1] = total, (start, piece)
        while done < n:
            done += 1
            settle(done)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(reversed([int(self.bytes[b]) for b in chunk[start:at].encode("utf-8", "surrogatepass")]))
            at = start
        return out[::-1]

    def decode(self, ids) -> str:
        """Text of ids: byte pieces as UTF-8, the blank mark as a blank, and no blank in front."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.by_byte.get(int(i))
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def chunks(texts: pa.Array) -> Codes:
    """Texts with a blank put in front and blanks marked, cut before runs of blanks and around line ends and tabs.

    An empty text has no chunk.
    """
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), marked)
    # A NUL of the text is no cut: it is escaped, and put back below.
    hidden = pc.replace_substring(pc.replace_substring(marked, "\x01", "\x01\x03"), "\x00", "\x01\x02")
    runs = pc.replace_substring(pc.replace_substring_regex(hidden, f"([ {BLANK}]+)", "\x00\\1"), " ", BLANK)
    cut = pc.replace_substring_regex(runs, "([\n\t])", "\x00\\1\x00")
    found = Codes(pc.split_pattern(cut, "\x00"))
    found.drop(np.asarray(pc.equal(pc.binary_length(found.uniques), 0)))
    found.uniques = pc.replace_substring(pc.replace_substring(found.uniques, "\x01\x02", "\x00"), "\x01\x03", "\x01")
    return found


class Counter:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.table = Table(lambda names: np.array([vocabulary.count(c) for c in names], np.int64))

    def counts(self, texts: pa.Array) -> np.ndarray:
        coded = chunks(texts)
        return coded.sums(self.table.rows(coded.uniques)[coded.codes]) if len(coded.codes) else np.zeros(len(texts), np.int64)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.table = Ragged(lambda names: in_order(names, [np.array(vocabulary.segment(c), np.int32) for c in names]), KNOWN)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        coded = chunks(texts)
        if not len(coded.codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        return self.table.gather(coded)


class Decoder:
    """Decodes many id sequences at once: piece bytes are gathered from one table."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        data = [bytes([vocabulary.by_byte[i]]) if i in vocabulary.by_byte else p.replace(BLANK, " ").encode() for i, p in enumerate(vocabulary.text)]
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 of each sequence, without the blank in front."""
        lengths = self.sizes[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        blob = self.data[where].tobytes()
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return [blob[a + 1 : b] if blob[a : a + 1] == b" " and b > a else blob[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def vocabulary_of(path: str | None) -> Vocabulary:
    return Vocabulary(path)


def counter_of(path: str | None) -> Counter:
    """One counter a worker process: what it has learnt serves later tasks."""
    return kept(("counter", path), lambda: Counter(vocabulary_of(path)))


def encoder_of(path: str | None) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(vocabulary_of(path)))


def _count(path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counter.counts(texts_of(part)), pa.int64())], names=["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) per row of ``docs`` (doc_id, text), without building the token ids.

    Null and empty texts have 0; repeated rows are counted each; other columns are ignored.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_count(model), "doc_id bigint, n_tokens bigint")


def _encode(path: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        encoder, decoder = encoder_of(path), Decoder(vocabulary_of(path))
        mark = BLANK.encode()
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                ids, sizes = encoder.encode(texts)
                decoded = decoder.decode(ids, sizes)
                sound = [d == t.as_buffer().to_pybytes().replace(mark, b" ") for d, t in zip(decoded, texts.cast(pa.large_binary()), strict=True)]
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists, pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(sound)], names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip) per row of ``docs`` (doc_id, text).

    ``round_trip``: decoding the ids gives the text back, a literal blank mark
    counting as a blank. Null and empty texts have no ids; repeated rows are
    encoded each; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, ids array<int>, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    return pick(docs, "doc_id", "text").mapInArrow(_encode(model), schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model)
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document of ``documents`` and check that decoding gives it back."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

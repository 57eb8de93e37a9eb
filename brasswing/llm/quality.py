"""Quality rules: gradient-boosted trees over document statistics.

All statistics of a batch are computed together from word and line codes; the
trees are flat numpy arrays. Features that can only speak against a document
(symbol share, repetition, repeated lines) are constrained to lower the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brasswing.llm.boost import Trees, threshold_keeping, train
from brasswing.llm.pieces import Codes, lines, slices, texts_of, window_hashes, words
from brasswing.llm.shared import pick

MIN_WORDS = 50
#: Percent of words in repeated windows above which a document fails.
MAX_REPEAT = 50
WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
#: Labelled documents the classifier is fitted on, at most, and the share of good ones it must keep.
SAMPLE = 4000
KEEP_GOOD = 0.995
#: One in so many of them is held out of training to set the threshold.
HELD_OUT = 4

FEATURES = ["log_words", "mean_word", "symbol_share", "repeat_share", "dup_line_share", "distinct_share", "letter_share", "words_per_line"]
MONOTONE = {FEATURES.index("symbol_share"): -1, FEATURES.index("repeat_share"): -1, FEATURES.index("dup_line_share"): -1}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = "doc_id bigint, " + ", ".join(f"{s} bigint" for s in STATS) + ", base_failed boolean, score double, kept boolean"


def _first_of_row(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is its (owner, value) seen before, and how often does it occur in all."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    count = np.bincount(group)[group] if len(group) else group
    seen, often = np.empty(len(o), bool), np.empty(len(o), np.int64)
    seen[order], often[order] = ~new, count  # lexsort is stable, so the first of a group is the first in the text
    return seen, often


def _covered(coded: Codes, width: int) -> np.ndarray:
    """Which words stand in a window of ``width`` words that occurs twice or more in their text."""
    n = len(coded.codes)
    out = np.zeros(n + width, np.int64)
    if n >= width:
        owner = coded.owner
        start = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        hashes = window_hashes(coded.codes.astype(np.uint64) + np.uint64(1), width)[start]
        _, often = _first_of_row(owner[start], hashes)
        at = start[often >= 2]
        np.add.at(out, at, 1)
        np.add.at(out, at + width, -1)
    return np.cumsum(out)[:n] > 0


def statistics(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of every text and the feature matrix."""
    texts = texts_of(batch)
    w, li = words(texts), lines(texts)
    chars = np.asarray(pc.utf8_length(w.uniques), np.int64)
    symbols = np.asarray(pc.count_substring_regex(w.uniques, SYMBOLS), np.int64)
    letters = np.asarray(pc.count_substring_regex(w.uniques, r"\pL"), np.int64)
    bare = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(li.uniques)), np.int64) > 0
    seen, _ = _first_of_row(li.owner, li.codes)
    first_seen, _ = _first_of_row(w.owner, w.codes)
    out = {
        "n_words": w.lengths,
        "word_chars": w.sums(chars[w.codes]),
        "n_symbols": w.sums(symbols[w.codes]),
        "n_dup_lines": li.sums((seen & bare[li.codes]).astype(np.int64)),
        "n_repeat_words": w.sums(_covered(w, WINDOW).astype(np.int64)),
    }
    n, c = np.maximum(out["n_words"], 1), np.maximum(out["word_chars"], 1)
    full_lines = np.maximum(li.sums(bare[li.codes].astype(np.int64)), 1)
    x = np.stack([np.log1p(out["n_words"]), c / n, out["n_symbols"] / c, out["n_repeat_words"] / n, out["n_dup_lines"] / full_lines, 1 - w.sums(first_seen.astype(np.int64)) / n, w.sums(letters[w.codes]) / c, n / full_lines], axis=1)
    return out, x


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT * n_words)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            stats, x = statistics(part)
            failed = base_failed(stats["n_words"], stats["n_repeat_words"])
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(failed), part.column("held_out"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "failed", "held_out", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> tuple[Trees, float]:
    """Train on at most ``sample`` labelled documents, those with the lowest hash of their identifier.

    Documents in one ``HELD_OUT``-th of them, by hash, set the threshold; the trees
    never see these. Rows without a label, text or identifier are left out. Of rows
    that share an identifier the text with the lowest hash counts, and of labels the
    lowest. Equal gains are settled by the first feature and cut, and equal rows are
    alike, so the order in which rows arrive does not matter. Without both labels
    present the trees are empty and the threshold 0: every document passes.
    """
    known = pick(labels, "doc_id", "quality").filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    # One row a document, so at most ``sample`` reach the driver.
    single = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    single = single.select("quality", F.col("t.text").alias("text"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))
    found = single.mapInArrow(_features, "quality int, failed boolean, held_out boolean, x array<double>").filter("NOT failed").select("quality", "held_out", "x").collect()
    y, held = np.array([r["quality"] for r in found], float), np.array([r["held_out"] for r in found], bool)
    if len(set(y[~held].tolist())) < 2:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0)), 0.0
    x = np.array([r["x"] for r in found])
    order = np.lexsort((*x.T, y, held))
    x, y, held = x[order], y[order], held[order]
    model = train(x[~held], y[~held], monotone=MONOTONE)
    return model, min(0.5, threshold_keeping(model.probability(x[held]), y[held], keep_good))


def _score(model: Trees, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                stats, x = statistics(part)
                failed = base_failed(stats["n_words"], stats["n_repeat_words"])
                score = model.probability(x)
                kept = ~failed & (score >= threshold)
                columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(stats[s].astype(np.int64)) for s in STATS), pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *STATS, "base_failed", "score", "kept"])

    return run


def apply(docs: DataFrame, model: Trees, threshold: float) -> DataFrame:
    """Statistics, score and verdict per row of ``docs`` (doc_id, text).

    Null and empty texts have no words and fail the base rule; repeated rows
    are scored each; other columns are ignored.
    """
    return pick(docs, "doc_id", "text").mapInArrow(_score(model, threshold), RESULT)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document of ``documents`` with trees fitted on ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return apply(docs, *fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

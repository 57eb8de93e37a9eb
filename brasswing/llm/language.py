"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, found
by the forward algorithm; a text's score adds the logarithms over its words.
Probabilities are fitted by expectation-maximisation on word counts of a bounded
sample of labelled documents.

A word is a longest run of letters of any length, lower-cased, with the blank mark
in front.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from brasswing.llm.pieces import Codes, Table, kept, slices, texts_of
from brasswing.llm.shared import Scratch, bounded_batches, broadcast_if_few, pick
from brasswing.llm.unigram import BLANK, Vocabulary

#: Labelled documents a language is fitted on, at most, and rounds of expectation-maximisation.
SAMPLE = 250
ROUNDS = 3
#: The most frequent words a language that its fit uses, of ``LONG_WORD`` letters at most.
SAMPLE_WORDS = 50_000
LONGEST_PIECE = 16
#: Words above this length are scored one by one, holding ``LONGEST_PIECE`` positions only.
LONG_WORD = 4096
#: Positions times languages that are held at a time.
POSITIONS = 1 << 20
SMOOTHING = 0.05
#: Probability of a character in no piece.
UNKNOWN = 1e-9
#: Log-likelihood a character (letters, and a blank mark a word) under which a text is in none of the model's languages: that of letters drawn evenly from the 140,000 of Unicode.
LEAST = -float(np.log(140_000))
UNDETERMINED = "und"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double"


@dataclass
class Model:
    """``probability[piece, language]``; the last row is for unknown characters."""

    languages: list[str]
    pieces: dict[str, int]
    probability: np.ndarray


def words(texts: pa.Array) -> Codes:
    """Letter runs, lower-cased."""
    bare = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    found = Codes(pc.split_pattern(bare, " "))
    return found.drop(np.asarray(pc.equal(pc.binary_length(found.uniques), 0)))


def vocabulary() -> dict[str, int]:
    """Pieces of the public vocabulary that a word can hold, numbered."""
    v = Vocabulary()
    keep = sorted({p.lower() for p, m in zip(v.text, v.matched, strict=True) if m and p.replace(BLANK, "", 1).isalpha()} | {BLANK})
    return {p: i for i, p in enumerate(keep)}


def _edges(names: list[str], pieces: dict[str, int]) -> tuple[np.ndarray, int]:
    """``edges[j, l - 1, w]``: the piece of word w that ends at j with length l, -1 for none; unknown single characters have one past the last piece."""
    marked = [BLANK + w for w in names]
    n = max(map(len, marked))
    edges = np.full((n + 1, LONGEST_PIECE, len(names)), -1, np.int32)
    none = len(pieces)
    get = pieces.get
    for w, word in enumerate(marked):
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - LONGEST_PIECE), j):
                k = get(word[i:j])
                if k is not None:
                    edges[j, j - i - 1, w] = k
            if edges[j, 0, w] < 0:
                edges[j, 0, w] = none
    return edges, n


def _groups(names: list[str], languages: int) -> Iterator[list[int]]:
    """Numbers of ``names``, words of like length together, as many as ``POSITIONS`` allows."""
    order = sorted(range(len(names)), key=lambda i: (len(names[i]), names[i]))
    while order:
        most = min(2048, len(order))
        while most > 1 and most * (len(names[order[most - 1]]) + 2) * languages > POSITIONS:
            most = (most + 1) // 2
        yield order[:most]
        order = order[most:]


def forward(edges: np.ndarray, ends: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Logarithm of the summed probability of all segmentations of each word, for every language.

    Sums are kept relative to a factor a word and language, renewed before they can vanish.
    """
    n, count, languages = len(edges) - 1, edges.shape[2], probability.shape[1]
    alpha = np.zeros((n + 1, count, languages))
    alpha[0] = 1.0
    scale, out = np.zeros((count, languages)), np.zeros((count, languages))
    for j in range(1, n + 1):
        for size in range(1, min(j, LONGEST_PIECE) + 1):
            ids = edges[j, size - 1]
            hit = np.flatnonzero(ids >= 0)
            if len(hit):
                alpha[j, hit] += alpha[j - size, hit] * probability[ids[hit]]
        at = np.flatnonzero(ends == j)
        if len(at):
            out[at] = np.log(alpha[j, at]) + scale[at]
        if j % 8 == 0:
            last = alpha[max(0, j + 1 - LONGEST_PIECE) : j + 1]
            most = last.max(axis=0)
            most[most <= 0] = 1.0  # behind the word's end
            last /= most
            scale += np.log(most)
    return out


def long_forward(word: str, model: Model) -> np.ndarray:
    """The same for one word of any length, position by position."""
    marked, get, none = BLANK + word, model.pieces.get, len(model.pieces)
    recent = [np.ones(len(model.languages))]
    scale = np.zeros(len(model.languages))
    for j in range(1, len(marked) + 1):
        total = 0.0
        for size in range(1, min(j, LONGEST_PIECE) + 1):
            k = get(marked[j - size : j])
            if k is None and size == 1:
                k = none
            if k is not None:
                total = total + recent[-size] * model.probability[k]
        recent = [*recent[1 - LONGEST_PIECE :], total]
        if j % 8 == 0:
            most = np.max(recent, axis=0)
            recent = [r / most for r in recent]
            scale = scale + np.log(most)
    return np.log(recent[-1]) + scale


def word_scores(names: list[str], model: Model) -> np.ndarray:
    """log P(word | language) for every word and language; words of like length go together."""
    out = np.empty((len(names), len(model.languages)))
    short = [i for i, name in enumerate(names) if len(name) <= LONG_WORD]
    for part in _groups([names[i] for i in short], len(model.languages)):
        rows = [short[i] for i in part]
        edges, _ = _edges([names[i] for i in rows], model.pieces)
        out[rows] = forward(edges, np.array([len(names[i]) + 1 for i in rows]), model.probability)
    for i, name in enumerate(names):
        if len(name) > LONG_WORD:
            out[i] = long_forward(name, model)
    return out


def _expect(edges: np.ndarray, ends: np.ndarray, weight: np.ndarray, log_p: np.ndarray, expected: np.ndarray) -> None:
    """Add to ``expected`` how often each piece is used in all segmentations of the words, by forward and backward sums in logarithms."""
    n, rows = len(edges) - 1, np.arange(len(ends))
    steps = [(j, size, ids, hit) for j in range(1, n + 1) for size in range(1, min(j, LONGEST_PIECE) + 1) if len(hit := np.flatnonzero((ids := edges[j, size - 1]) >= 0))]
    alpha = np.full((n + 1, len(ends)), -np.inf)
    alpha[0] = 0.0
    for j, size, ids, hit in steps:
        alpha[j, hit] = np.logaddexp(alpha[j, hit], alpha[j - size, hit] + log_p[ids[hit]])
    total = alpha[ends, rows]
    beta = np.full_like(alpha, -np.inf)
    beta[ends, rows] = 0.0
    for j, size, ids, hit in reversed(steps):
        through = log_p[ids[hit]] + beta[j, hit]
        beta[j - size, hit] = np.logaddexp(beta[j - size, hit], through)
        np.add.at(expected, ids[hit], weight[hit] * np.exp(alpha[j - size, hit] + through - total[hit]))


def train(counts: dict[str, dict[str, int]], rounds: int = ROUNDS) -> Model:
    """Fit piece probabilities to word counts by language."""
    languages, pieces = sorted(counts), vocabulary()
    size = len(pieces)
    columns = []
    lengths = np.array([len(p) for p in pieces], float)
    for language in languages:
        names = [w for w in counts[language] if len(w) <= LONG_WORD]
        p = np.append(0.02**lengths, UNKNOWN)
        p[:size] /= p[:size].sum()
        groups = []
        for part in _groups(names, 1):
            edges, _ = _edges([names[i] for i in part], pieces)
            groups.append((edges, np.array([len(names[i]) + 1 for i in part]), np.array([counts[language][names[i]] for i in part], float)))
        for _ in range(rounds):
            expected = np.full(size + 1, SMOOTHING)
            for edges, ends, weight in groups:
                _expect(edges, ends, weight, np.log(p), expected)
            p = np.append(expected[:size] / expected[:size].sum(), UNKNOWN)
        columns.append(p)
    return Model(languages, pieces, np.stack(columns, axis=1) if columns else np.zeros((size + 1, 0)))


def held_out_column(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = words(texts_of(part))
            languages = part.column("lang").dictionary_encode()
            owner = np.asarray(languages.indices)[found.owner]
            pairs, n = np.unique(np.stack((owner, found.codes)), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([languages.dictionary.take(pa.array(pairs[0])).cast(pa.string()), found.uniques.take(pa.array(pairs[1])).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """(doc_id, lang) of at most ``sample`` documents a language: those with the lowest hash of their identifier.

    A share of the hash's range that holds four times as many is cut out first, so
    that ranking a language does not take rows from every task.
    """
    size = F.approx_count_distinct("doc_id")
    share = Scratch(rows.sparkSession).table(rows.groupBy("lang").agg((F.lit(4.0 * sample) / size).alias("share")))
    place = (F.xxhash64("doc_id") / F.lit(float(2**64)) + 0.5).alias("place")
    few = rows.select("doc_id", "lang", place).join(broadcast_if_few(share), "lang").filter("place <= share").select("doc_id", "lang", "place").distinct()
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    return ranked.filter(F.col("r") <= sample).select("doc_id", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, most_words: int = SAMPLE_WORDS) -> Model:
    """Learn from text and non-null lang of at most ``sample`` documents a language, none of them held out.

    The sample is the documents with the lowest hash of their identifier. Only
    counts of their ``most_words`` most frequent words a language reach the driver.
    """
    rows = pick(docs, "doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out_column())
    chosen = _sample(rows.select("doc_id", "lang"), sample)
    counted = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint")
    totals = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    counts: dict[str, dict[str, int]] = {}
    for r in totals.withColumn("r", F.row_number().over(by_count)).filter(F.col("r") <= most_words).collect():
        counts.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return train(counts, rounds)


def predict(texts: pa.Array, model: Model, table: Table) -> tuple[list[str], np.ndarray]:
    """Language and posterior of every text, all languages equally likely beforehand; ties go to the first name."""
    found = words(texts)
    if not model.languages or not len(found.codes):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total = found.sums(table.rows(found.uniques)[found.codes])
    best = total.argmax(axis=1)
    posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    blank = found.lengths == 0
    names = [UNDETERMINED if b else model.languages[i] for b, i in zip(blank.tolist(), best.tolist(), strict=True)]
    return names, np.where(blank, 0.0, posterior)


def _table(broadcast) -> Table:
    """The worker's table of word scores; it holds its model, so the key stays unique."""
    model = broadcast.value
    return kept(("language", id(model)), lambda: Table(lambda names: word_scores(names, model)))


def _predict(broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        table = _table(broadcast)
        for batch in batches:
            for part in slices(batch):
                names, score = predict(texts_of(part), model, table)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(names), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs`` (doc_id, text).

    ``und`` with score 0 for null, empty and letterless texts; repeated rows are
    scored each; other columns are ignored. The model's size is bounded by the
    public vocabulary, so it is sent to every executor.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text").withColumn("held_out", held_out_column())
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), RESULT)


def in_languages(texts: pa.Array, model: Model, table: Table) -> np.ndarray:
    """Whether a text has letters and its best language gives them ``LEAST`` a character at least; a model without languages rejects no letters."""
    found = words(texts)
    lettered = found.lengths > 0
    if not model.languages or not len(found.codes):
        return lettered
    total = found.sums(table.rows(found.uniques)[found.codes]).max(axis=1)
    characters = found.sums((np.asarray(pc.utf8_length(found.uniques), np.int64) + 1)[found.codes])
    return lettered & (total >= LEAST * characters)


def determined(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` in one of the model's languages (``in_languages``); every column is kept and nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(broadcast)
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(in_languages(texts_of(part), broadcast.value, table), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of ``documents``, by a model fitted on those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))

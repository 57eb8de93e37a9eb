"""The registered queries, row by row, against brute force; and odd tables for the operators that write files."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_personal_data import brute as brute_spans
from test_pure import brute_quality, brute_secrets
from test_spark import brute_components

import corpus_pipeline
from brasswing.llm import decontamination, personal_data, quality, secrets, token_shards, unigram, warc


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def pieces_library():
    """A unigram tokenizer of the library over the same pieces."""
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=unigram.model_path())
    library = Tokenizer(models.Unigram([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: library.encode(text, add_special_tokens=False).ids if text else []


def test_op2_rows(spark, sf_dir, documents):
    got = secrets.op2_secret_scan(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)
    for r in got:
        spans = brute_secrets(documents[r["doc_id"]] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""}


def test_op2_of_very_long_texts(spark):
    texts = ["a1" * 500_000, "password=" * 100_000, "f" * 1_000_000, "AKIA" * 200_000, "token: " + "x" * 800_000, " " * 1_000_000]
    for r in secrets.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        spans = brute_secrets(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))


def test_op4_and_op9_rows(spark, sf_dir, documents, pieces_library):
    want = {k: pieces_library(t) for k, t in documents.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in unigram.op4_token_counts(spark, sf_dir).collect()} == {k: len(v) for k, v in want.items()}
    got = {r["doc_id"]: r for r in unigram.op9_sentencepiece(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(r["round_trip"] for r in got.values())
    for k, r in got.items():
        assert r["ids"] == want[k] and r["n_tokens"] == len(want[k]) and r["ids_crc32"] == zlib.crc32(np.array(want[k], "<u4").tobytes())
    back = unigram.decode_documents(unigram.op9_sentencepiece(spark, sf_dir))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: (t or "").replace("▁", " ") for k, t in documents.items()}


def test_op4_and_op9_of_very_long_texts(spark, pieces_library):
    texts = ["a" * 200_000, "the " * 100_000, " " * 100_000, "日本" * 50_000, "\n" * 50_000]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id bigint, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(docs).collect()}
    rows = {r["doc_id"]: r for r in unigram.encode_documents(docs).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["round_trip"] and counts[i] == rows[i]["n_tokens"] == len(pieces_library(text))
    assert counts[9] == rows[9]["n_tokens"] == 0


def test_op7_rows(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    library, start, want = Tokenizer.from_file(token_shards.tokenizer_path()), 0, []
    for doc_id in sorted(documents):
        ids = np.array([*library.encode(documents[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.op7_token_shards(spark, sf_dir).collect()) == want


def test_op7_of_repeated_and_null_identifiers(spark):
    rows = [(None, "x"), (None, None), (3, "a <|endoftext|> b"), (1, "one"), *[(2, "same")] * 3000, (4, "y" * 300_000)]
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id bigint, text string, row int, text_hash string").repartition(5)
    root = f"{token_shards.shared_dir(spark)}/shards"
    manifest = token_shards.write_shards(docs, root, shard_tokens=1000, ranges=6)
    got = sorted(token_shards.read_shards(manifest, root).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, *[2] * 3000, 3, 4]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert manifest.groupBy("part").sum("n_docs").agg({"sum(n_docs)": "max"}).first()[0] < 2500
    assert len(token_shards.lookup(manifest, root, None)) == 2 and len(token_shards.lookup(manifest, root, 2)) == 3000
    assert token_shards.lookup(manifest, root, 77) == []
    empty = token_shards.write_shards(docs.limit(0), root)
    assert empty.count() == 0 and token_shards.read_shards(empty, root).count() == 0


def test_op7_measures_unknown_sizes(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "UNKNOWN_BYTES", 0)
    monkeypatch.setattr(token_shards, "RANGE_BYTES", 1000)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    manifest = token_shards.write_shards(docs, f"{token_shards.shared_dir(spark)}/shards")
    assert manifest.select("part").distinct().count() > 20


def warc_want(rows):
    groups = {}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000:
            groups.setdefault(payload, []).append(page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = groups.get(payload, [])
        known = [i for i in ids if i is not None]
        target = max(known) if len(ids) > 1 and known else None
        revisit = target is not None and page_id != target
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("shuffled", [False, True])
def test_op8_rows_in_both_joins(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(warc, "BROADCAST_GROUPS", -1)
        monkeypatch.setattr(warc, "LARGE_GROUP", 20)
    r = random.Random(2)
    rows = [(i, f"http://h/{i}", r.choice(["a" * 999, "b" * 1000, "é" * 600, "c" * 5000 + str(r.randint(0, 30)), "", "WARC/1.0\r\n" * 200])) for i in range(300)]
    rows += [(None, None, None), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (7, "again", "b" * 1000), (299, None, "b" * 1000), (299, "x\r\ny z", "b" * 1000)]
    pages = spark.createDataFrame([(*row, "clash", 1) for row in rows], "page_id bigint, url string, html string, digest string, largest int")
    root = f"{warc.shared_dir(spark)}/warc"
    got = warc.read_archives(warc.write_archives(pages, root, 60_000), root, 7_000).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == warc_want(rows)
    assert all(r["payload_ok"] for r in got)


def test_op8_of_an_empty_table_and_a_large_page(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 9_000_000), (2, "v", "x" * 9_000_000)], "page_id bigint, url string, html string")
    root = f"{warc.shared_dir(spark)}/warc"
    got = warc.read_archives(warc.write_archives(pages, root), root, 1_000_000).collect()
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in got) == [(1, "revisit", 9_000_000), (2, "response", 9_000_000)]
    assert warc.read_archives(warc.write_archives(pages.limit(0), root), root).count() == 0


def test_op10_rows(spark, sf_dir, documents):
    got = {r["doc_id"]: r for r in quality.op10_quality_rules(spark, sf_dir).collect()}
    assert set(got) == set(documents)
    for k, r in got.items():
        want = brute_quality(documents[k] or "")
        assert tuple(r[s] for s in quality.STATS) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"]) and 0 <= r["score"] <= 1
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model, threshold = quality.fit(docs, labels)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= threshold) for r in got.values())


def test_op10_fit_does_not_depend_on_order_or_repeats(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    first, cut = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text")
    again, same = quality.fit(rows.unionByName(rows).repartition(7), labels.unionByName(labels).repartition(3))
    assert cut == same and (first.feature == again.feature).all() and (first.value == again.value).all()
    none, zero = quality.fit(docs, labels.limit(0))
    assert zero == 0.0 and quality.apply(docs, none, zero).filter("NOT kept AND NOT base_failed").count() == 0


def test_pipeline_against_an_independent_chain(spark, sf_dir, documents, pieces_library):
    """Language by letters, groups by brute force, leaks by containment, redaction by plain patterns and the added spans, ids by the library."""
    kept = {k for k, v in documents.items() if re.search(r"[^\W\d_]", v or "")}
    parts = brute_components([(k, documents[k]) for k in kept])
    kept = {k for k in kept if parts[k][1] == k}
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {k for k in kept if not any(i in norm(documents[k]) for i in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == kept
    added = {r["doc_id"]: r["spans"] for r in personal_data.op5_personal_data(spark, sf_dir).collect()}
    redacted = 0
    for k, r in got.items():
        text, out, at = documents[k], "", 0
        base = [f"{a}:{b}:{c}" for a, b, c in brute_spans(text)]
        spans = [s.split(":") for s in {*base, *filter(None, added[k].split(","))}]
        for kind, a, b in sorted(((x, int(a), int(b)) for x, a, b in spans), key=lambda s: (s[1], s[2], personal_data.KINDS.index(s[0]))):
            if a >= at:
                out += f"{text[at:a]}[{kind.upper()}]"
            at = max(at, b)
        redacted += at > 0
        assert r["ids"] == pieces_library(out + text[at:]) and r["round_trip"]
    assert redacted > 0


def test_decontamination_keeps_rows_that_share_a_hash(spark, monkeypatch):
    """Rows are told apart by doc_id beside the hash."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontamination, "doc_key", lambda: F.lit(5).cast("bigint"))
    docs = spark.createDataFrame([(1, "in Paris"), (2, "in Rome")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "paris")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()] == [2]

"""Operators on Spark: odd inputs, brute force, and the pipeline."""

import re
import zlib

import numpy as np
from oracle import connect, same

import corpus_pipeline
from brasswing.llm.shared import key_filter
from brasswing.llm import decontamination, language, near_duplicates, personal_data, queries, quality, secrets, token_shards, unigram, warc

ODD = [(1, "The same words stand here one two three four five"), (1, "The same words stand here one two three four five"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, "12 %%"), (None, "The same words stand here one two three four five six")]


def odd(spark, rows=ODD):
    """Odd rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", 0, "x", 1.5) for i, t in rows], "doc_id bigint, text string, lang string, key int, kept string, score double")


def test_odd_rows_and_empty_tables(spark):
    docs, labels = odd(spark), spark.createDataFrame([], "doc_id bigint, quality int")
    bench = spark.createDataFrame([(1, None)], "item_id bigint, text string")
    for rows, n in ((docs, len(ODD)), (docs.limit(0), 0)):
        assert secrets.scan_documents(rows).count() == n
        assert unigram.count_tokens(rows).count() == n
        assert unigram.encode_documents(rows).filter("round_trip").count() == n
        assert quality.apply(rows, *quality.fit(rows, labels)).count() == n
        assert personal_data.detect(rows).count() == n
        assert personal_data.redact(rows).columns == docs.columns
        found = language.identify(rows, language.fit(rows)).collect()
        assert len(found) == n and sum(r["lang_pred"] == "und" for r in found) == (5 if n else 0)
        root = f"{token_shards.shared_dir(spark)}/odd"
        assert token_shards.read_shards(token_shards.write_shards(rows, root), root).count() == n
        assert near_duplicates.near_duplicates(rows).count() == n
        assert decontamination.decontaminate(rows, bench).count() == n


def test_near_duplicates_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(odd(spark)).collect()}
    assert got == {(1, 6, 1, True), (None, 0, None, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 7, 1, False)}
    left = near_duplicates.deduplicate(odd(spark))
    assert left.columns == odd(spark).columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "3", "4", "5", "None"]


def brute_components(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(v), find(k)) for k, v in sets.items()}


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    base = " ".join(f"w{i}" for i in range(120)).split()
    rng = np.random.default_rng(4)
    made = []
    for i in range(60):  # one group of copies with one to twelve words changed
        w = list(base)
        for j in rng.choice(120, 1 + i % 12, replace=False):
            w[j] = f"x{rng.integers(40)}"
        made.append((1000 + i, " ".join(w)))
    extra = spark.createDataFrame(made, "doc_id bigint, text string")
    want |= brute_components(made)
    got = near_duplicates.near_duplicates(docs.select("doc_id", "text").unionByName(extra)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_against_oracle(spark, sf_dir):
    for d in (sf_dir, "/root/testdata/sf0.01"):
        same(near_duplicates.op3_near_duplicates(spark, d), connect(d), queries.oracle_sql()["op3_near_duplicates"])


def counted_components(rows):
    """The same by counting shared shingles over posting lists: fit for some thousand texts."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    held = {}
    for i, s in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(i)
    held = {x: np.array(v) for x, v in held.items()}
    sizes, root = np.array([len(s) for s in sets]), list(range(len(sets)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, s in enumerate(sets):
        common = np.bincount(np.concatenate([held[x] for x in s]), minlength=len(sets))
        for j in np.flatnonzero(100 * common >= 75 * (sizes + sizes[i] - common)).tolist():
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(rows)}


def test_near_duplicates_in_large_groups(spark):
    """Some thousand near copies, many too far from any hub, and some thousand texts that share a long passage."""
    rng = np.random.default_rng(7)
    base, passage = [f"w{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    made = []
    for i in range(2500):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(1, 14)), replace=False):
            w[j] = f"x{rng.integers(3)}"
        made.append((int(rng.permutation(10)[0]) * 10_000 + i, " ".join(w)))
    for i in range(1500):
        own = [f"o{i // 2}-{k}" for k in range(int(rng.integers(12, 60)))]
        made.append((200_000 + i, " ".join(passage + own)))
    docs = spark.createDataFrame(made, "doc_id bigint, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    want = counted_components(made)
    assert got == want and 100 < len(set(want.values())) < len(want)


def test_deduplicate_keeps_all_columns_and_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (2, "a b c d e f", 3, "z"), (3, None, 4, ""), (3, None, 5, ""), (4, "q r s t u v w", 6, "")]
    names = "doc_id bigint, text string, row_key int, kept string"
    left = near_duplicates.deduplicate(spark.createDataFrame(rows, names))
    assert left.columns == ["doc_id", "text", "row_key", "kept"]
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_key_filter_lets_all_wanted_through(spark):
    keys = spark.range(20_000).selectExpr("xxhash64(id) AS key")
    rows = spark.range(200_000).selectExpr("id", "xxhash64(id) AS key")
    marked = key_filter(near_duplicates.Scratch(spark), keys)(rows, "maybe")
    wanted, passed = marked.selectExpr("sum(int(maybe AND id < 20000))", "sum(int(maybe))").first()
    assert wanted == 20_000 and passed < 35_000
    assert key_filter(near_duplicates.Scratch(spark), keys.limit(0))(rows, "maybe").filter("maybe").count() == 0


def test_decontamination(spark, sf_dir):
    bench = spark.createDataFrame([(1, "Alice has 12 apples and gives 5 apples to her friend named Bob who walks 3 km home every single day. How many apples does Alice keep?"), (2, "too short"), (3, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "Intro words. Carla has 40 apples and gives 9 apples to her friend named Dan who walks 8 km home every single day. How many apples does Eve keep? And more."), (2, "nothing of the kind is in this text at all, only words that go on"), (3, None)], "doc_id bigint, text string")
    assert [(r["doc_id"], r["item_id"], r["slots_consistent"]) for r in decontamination.contaminated(docs, bench).collect()] == [(1, 1, True)]
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    texts = {r["doc_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(d, i) for i, t in items.items() for d, x in texts.items() if t in x}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.op1_decontamination(spark, sf_dir).collect()} == want


def test_personal_data_redaction(spark):
    text = "mail a.b@c.de or call +1 (017) 555-7713, card 4539 5787 6362 1486 from 10.0.0.1 and 300.1.1.1"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = personal_data.detect(docs).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    assert personal_data.redact(docs).first()["text"].startswith("mail [EMAIL] or call [PHONE], card [CARD] from [IP] and")


def test_archives_reject_magic_in_payloads(spark):
    trap = "x" * 50 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 30
    rows = [(i, f"http://h/{i}", trap + str(i % 3)) for i in range(40)] + [(None, None, None), (7, None, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = f"{warc.shared_dir(spark)}/warc"
    got = warc.read_archives(warc.write_archives(pages, root, 20_000), root, 3_000).collect()
    assert len(got) == len(rows) and all(r["payload_ok"] for r in got)
    assert sorted(r["page_id"] for r in got if r["record_type"] == "response" and r["payload_bytes"] >= 1000) == [37, 38, 39]
    assert {r["url"] for r in got if r["page_id"] == 5} == {"http://h/5"}


def test_archives_against_oracle(spark, sf_dir):
    same(warc.op8_warc(spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op8_warc"])


def test_token_shards_against_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_shards.tokenizer_path())
    library.encode_special_tokens = True
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    want, start = [], 0
    for r in docs:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    root = f"{token_shards.shared_dir(spark)}/shards"
    manifest = token_shards.write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), root, shard_tokens=5000)
    assert sorted(map(tuple, token_shards.read_shards(manifest, root).collect())) == want
    assert [len(x) for x in token_shards.lookup(manifest, root, docs[3]["doc_id"])] == [want[3][2]]


def test_language_on_held_out(spark, sf_dir):
    found = language.op6_language(spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    rows = found.select("lang_pred", "lang").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows) > 0


def test_pipeline(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "language"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {k for k, v in texts.items() if re.search(r"[^\W\d_]", v or "")}
    parts = brute_components([(k, texts[k]) for k in kept])
    kept = {k for k in kept if parts[k][1] == k}
    leaks = {r["doc_id"] for r in decontamination.op1_decontamination(spark, sf_dir).collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == kept - leaks
    assert all(r["round_trip"] and r["n_tokens"] > 0 for r in got.values())


CLIPS = "Natalia sold clips to 48 of her friends in April, and then she sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"


def leaks(spark, items, texts):
    """{(doc, item)}, both numbered from 0."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    assert len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})
    return {(r["doc_id"], r["item_id"]) for r in rows}


def test_decontamination_ignores_case_and_white_space(spark):
    names = "We met Anna, Boris, Clara, David, Emil, Frida, Gustav, Hanna and walked on to the old harbour before noon"
    for text in (CLIPS, names):
        copies = [text, text.lower(), text.upper(), text.replace(" ", "  "), text.replace(" ", "\n"), text.replace(" ", " "), text.replace("48", "52").lower()]
        assert leaks(spark, [text, text.lower()], [f"intro words before. {c} And words behind." for c in copies]) == {(d, i) for d in range(len(copies)) for i in range(2)}


def test_decontamination_of_repeated_values(spark):
    crates = "On the farm 5 cars carry 5 crates each and later 5 more crates come by train, so the owner counts them all once again. How many crates are there now?"
    dozen = "A shop sells 12 pens in a box and 12 boxes in a case, and the clerk orders one case for every school in town. How many pens come?"
    asked = [crates, dozen, CLIPS]
    changed = [crates.replace("5 cars", "7 cars").replace("5 crates", "9 crates").replace("5 more", "4 more"), dozen.replace("12 pens", "15 pens").replace("12 boxes", "20 boxes")]
    inserted = CLIPS.replace("48", "52").replace("April", "June").replace("May", "July").replace("half as", "exactly half as").replace("clips did", "paper clips did")
    texts = [f"some words before. {t} And words behind." for t in [*changed, inserted]]
    assert leaks(spark, asked, texts) == {(0, 0), (1, 1), (2, 2)}
    # Digits in a row are a template of nothing but slots: only the same ones count.
    digits = " ".join(str(i * i) for i in range(12))
    assert leaks(spark, [digits], [f"see {digits} there", "see " + " ".join(str(90 - i % 3) for i in range(12))]) == {(0, 0)}


def test_decontamination_of_short_items(spark):
    items = ["Which river flows through the city of Paris?", "What is the capital of France?", "2 + 2 = 4", "Paris", "  ?! ", "one two three four five six seven eight"]
    texts = [f"asked here: {t} and so on" for t in items] + [t.upper() for t in items] + ["What is the capital of Spain?", "2 + 3 = 4", "comparison", "", "1 2 2 4 0"]
    want = {(i, i) for i in (0, 1, 2, 3, 5)} | {(i + 6, i) for i in (0, 1, 2, 3, 5)} | {(0, 3), (6, 3), (16, 2)}
    assert leaks(spark, items, texts) == want
    left = decontamination.decontaminate(spark.createDataFrame([(1, "In Paris"), (2, "in Rome")], "doc_id bigint, text string"), spark.createDataFrame([(1, "paris")], "item_id bigint, text string"))
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_archives_with_long_urls(spark):
    long = "data:text/html," + "%41\r\nWARC/1.0\r\n" * 13_000
    rows = [(i, f"{long}{i}" if i % 3 == 0 else f"http://h/{i}", "x" * (i * 100)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    for size in (3_000, 100_000, warc.RANGE_BYTES):
        root = f"{warc.shared_dir(spark)}/warc"
        got = warc.read_archives(warc.write_archives(pages, root), root, size).collect()
        assert sorted((r["page_id"], r["url"]) for r in got) == [(i, u) for i, u, _ in rows] and all(r["payload_ok"] for r in got)


def test_language_stage_decides_by_its_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    lettered = {r["doc_id"] for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    more = spark.createDataFrame([(-1, "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", None), (-2, "ꦧꦱꦗꦮ ꦲꦏ꧀ꦱꦫ", None), (-3, "12 %", None), (-4, None, None)], docs.schema)
    kept = lambda d: {r["doc_id"] for r in corpus_pipeline.language_stage(spark, d, sf_dir).collect()}
    assert kept(docs.unionByName(more)) == lettered
    unlabelled = docs.unionByName(more).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert kept(unlabelled) == lettered | {-1, -2}

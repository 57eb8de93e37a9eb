"""Operators below Spark, against brute force and the public libraries."""

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brasswing.llm import boost, language, near_duplicates, pieces, quality, secrets, sstable, token_shards, unigram, warc


def test_sstable_round_trip_and_lookup():
    out = io.BytesIO()
    writer = sstable.Writer(out, block_bytes=200)
    rows = [(None, [1, 2]), (-5, []), (3, [7]), (3, [70000]), (4, list(range(300)))] + [(i, [i]) for i in range(10, 200)]
    for doc_id, ids in rows:
        writer.add(sstable.key_of(doc_id), np.array(ids, np.int32))
    writer.finish()
    reader = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert [(k, v.tolist()) for k, v in reader] == rows
    assert [x.tolist() for x in reader.get(3)] == [[7], [70000]]
    assert [x.tolist() for x in reader.get(None)] == [[1, 2]]
    assert reader.get(5) == [] and len(reader.blocks) > 3
    assert sum(reader.may_hold(i) for i in range(1000, 2000)) < 100
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(1), np.zeros(0, np.int32))


def test_encoder_equals_library():
    encoder = token_shards.Encoder(token_shards.tokenizer_path())
    r = random.Random(0)
    bits = ["the", " and", " ", "  ", "\n", "\t", "é", "'s", "12", "!!", " ", "\x00", "<|endoftext|>", "日本"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(500)] + ["", "plain words here.\nAnd there"]
    ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
    want = encoder._library(texts)
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [int(i) for w in want for i in w]


def test_unigram_equals_library():
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    model = sentencepiece.SentencePieceProcessor(model_file=unigram.model_path())
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    v = unigram.Vocabulary()
    r = random.Random(1)
    bits = ["the", "and ", " ", "  ", "     ", "\n", "\t", "é", "ion", "█", "日本", "𝒳", "▁", "x", "\x00", "\x01\x02", "!!"]
    texts = ["".join(r.choices(bits, k=r.randint(0, 14))) for _ in range(600)] + ["", " ", "a"]
    batch = pa.array(texts, pa.large_string())
    ids, sizes = unigram.Encoder(v).encode(batch)
    counts = unigram.Counter(v).counts(batch)
    decoded = unigram.Decoder(v).decode(ids, sizes)
    for text, own, n, back in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), counts, decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids if text else []
        assert own.tolist() == want and n == len(want)
        assert back.decode() == v.decode(own) == text.replace("▁", " ")


def brute_secrets(text):
    out = []
    for kind, pattern, ok in (
        ("assign", secrets.ASSIGN, lambda m: len(m[2]) >= 12),
        ("access", secrets.ACCESS, lambda m: len(m[0]) >= 18),
        ("hex", secrets.HEX, lambda m: len(m[0]) >= 16),
    ):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_base_equals_plain_patterns():
    machine, r = secrets.automaton(), random.Random(2)
    bits = ["password", "api_key", "APIKEY", "token", "secret", "=", ":", " ", '"', "AKIA", "A", "Z9", "0123", "abc", "f" * 9, "deadbeef", "g", "é", "K", "ſecret", ".", "\n"]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(0, 25)))
        assert [s for s in secrets.scan(text, machine) if s[0] in secrets.BASE_KINDS] == brute_secrets(text)


def test_secrets_checksums():
    machine, body = secrets.automaton(), "A1b2C3d4E5" * 3
    good = "ghp_" + body + secrets.base62_crc32(body)
    assert ("github", 3, 3 + len(good)) in secrets.scan("is " + good, machine)
    assert not secrets.scan("is ghp_" + body + "000000", machine)
    assert secrets.redact(None, machine) is None and secrets.redact("is " + good, machine) == "is [GITHUB]"


def brute_quality(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    seen, repeated, windows = set(), 0, {}
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_statistics_equal_brute_force():
    r = random.Random(3)
    texts = ["".join(r.choices(["a", "b", " ", "  ", "\n", "%", "é", "\t", "\x0b", "x y", "#"], k=r.randint(0, 40))) for _ in range(1500)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    stats, x = quality.statistics(batch.slice(0))
    assert [tuple(int(stats[s][i]) for s in quality.STATS) for i in range(len(texts))] == [brute_quality(t or "") for t in texts]
    assert np.isfinite(x).all()
    sliced, _ = quality.statistics(batch.slice(100, 50))
    assert sliced["n_words"].tolist() == stats["n_words"][100:150].tolist()


def test_trees_keep_their_constraint():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 2))
    y = (x[:, 0] - 0.3 * x[:, 1] + 0.5 * r.normal(size=600) > 0).astype(float)
    model = boost.train(x, y, monotone={0: 1})
    assert ((model.probability(x) > 0.5) == (y == 1)).mean() > 0.8
    grid = np.linspace(-3, 3, 50)
    for other in (-1.0, 0.0, 1.0):
        assert (np.diff(model.margin(np.stack([grid, np.full(50, other)], axis=1))) >= -1e-12).all()


def test_shingles_and_signatures():
    texts = pa.array(["a b c d e f", "A  b\tc d e F", "a b", "", "b a"], pa.large_string())
    sets = near_duplicates.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 1, 0, 1]
    assert (sets[0] == sets[1]).all() and sets[2][0] != sets[4][0]
    assert (near_duplicates.signature(sets[0]) == near_duplicates.signature(sets[1])).all()


def test_windows_of_a_slice():
    batch = pa.RecordBatch.from_arrays([pa.array(["é ü", "x ÿ z", None])], names=["text"])
    found = pieces.words(pieces.texts_of(batch.slice(1)))
    assert found.lengths.tolist() == [3, 0]


def test_warc_record_heads():
    data = warc.record(7, "http://a/\r\nb%", b"<p>", "d" * 40, None, False)
    assert warc.successor(data, 0) == len(data)
    assert warc.parse_head(data)["warc-record-id"] == "<urn:page:7>"
    assert warc.successor(b"WARC/1.0\r\nno head", 0) is None


def test_encoder_equals_untouched_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_shards.tokenizer_path())
    encoder, mark = token_shards.Encoder(token_shards.tokenizer_path()), "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"plain words.\nThen{mark}{mark}\tx", "no mark <|endof text|>", "", f"é{mark}"]
    ids, sizes = encoder.encode(pa.array(texts, pa.large_string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_warc_successors_of_all_magics():
    r = random.Random(5)
    bits = [b"WARC/1.0\r\n", b"\r\n", b"\r\n\r\n", b"Content-Length: 7", b"\r\ncontent-length: 12\r\n", b"x", b"X-A: b\r\n", b"\r"]
    for _ in range(3000):
        data = b"".join(r.choices(bits, k=r.randint(0, 25)))
        at = [m.start() for m in re.finditer(re.escape(warc.MAGIC), data)]
        assert warc.successors(data, len(data)) == {i: n for i in at if (n := warc.successor(data, i)) is not None}
    long = warc.record(7, "data:" + "%" * 200_000, b"<p>", "d" * 40, None, False)
    assert warc.successor(long, 0) == len(long)


def segmentations(word, pieces):
    """All ways to cut ``word`` into pieces; single characters may be unknown (None)."""
    if not word:
        yield []
    for size in range(1, len(word) + 1):
        known = word[:size] in pieces
        if known or size == 1:
            for rest in segmentations(word[size:], pieces):
                yield [word[:size] if known else None, *rest]


def model_of(words, rounds=0):
    return language.train({k: dict(v) for k, v in words.items()}, rounds)


def test_forward_sum_equals_all_segmentations():
    model = model_of({"a": {"sonne": 3, "haus": 2, "regenzeit": 1}, "b": {"river": 4, "the": 5, "mountain": 1}}, 2)
    probability = lambda piece, k: float(model.probability[len(model.pieces) if piece is None else model.pieces[piece], k])
    names = ["a", "the", "sonne", "rivers", "ßx", "日本", "regenzeitk"]
    scores = language.word_scores(names, model)
    for name, row in zip(names, scores, strict=True):
        cuts = list(segmentations(language.BLANK + name, model.pieces))
        for k in range(2):
            assert np.isclose(np.exp(row[k]), sum(np.prod([probability(p, k) for p in cut]) for cut in cuts), rtol=1e-9)
        assert np.allclose(row, language.long_forward(name, model), rtol=1e-12)


def test_forward_sum_of_long_runs():
    model = model_of({"a": {"sonne": 3}, "b": {"river": 4}}, 1)
    for unit in ("sonne", "日本語", "ßqx"):
        run = unit * 900
        row = language.word_scores([run, "the"], model)[0]
        assert np.isfinite(row).all() and np.allclose(row, language.long_forward(run, model), rtol=1e-9)
    assert np.isfinite(language.word_scores(["x" * 20_000], model)).all()


def test_one_round_counts_pieces_in_all_segmentations():
    pieces = language.vocabulary()
    names = {"the": 2, "river": 1}
    p = np.append(0.02 ** np.array([len(x) for x in pieces], float), language.UNKNOWN)
    p[:-1] /= p[:-1].sum()
    expected = np.full(len(p), language.SMOOTHING)
    for name, n in names.items():
        cuts = list(segmentations(language.BLANK + name, pieces))
        weights = np.array([np.prod([p[-1] if x is None else p[pieces[x]] for x in cut]) for cut in cuts])
        for cut, w in zip(cuts, weights / weights.sum(), strict=True):
            for x in cut:
                expected[-1 if x is None else pieces[x]] += n * w
    want = np.append(expected[:-1] / expected[:-1].sum(), language.UNKNOWN)
    assert np.allclose(model_of({"a": names}, 1).probability[:, 0], want, rtol=1e-9)


def test_words_of_the_language_model():
    found = language.words(pa.array(["Ärger, über-all 12", "x" * 100 + "日" * 50, "", "1 2"], pa.large_string()))
    assert found.lengths.tolist() == [3, 1, 0, 0]
    assert [found.uniques.to_pylist()[c] for c in found.codes] == ["ärger", "über", "all", "x" * 100 + "日" * 50]


def test_tables_forget_by_characters(monkeypatch):
    monkeypatch.setattr(pieces, "LIMIT_CHARACTERS", 10)
    table = pieces.Table(lambda names: np.array([len(n) for n in names]))
    assert table.rows(pa.array(["aaaaaaaaaaaa", "b"])).tolist() == [12, 1]
    assert table.rows(pa.array(["b", "cc"])).tolist() == [1, 2] and len(table.index) == 2


def test_bit_signatures_follow_similarity():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    for changed, low, high in ((0, 0, 0), (57, 90, 165), (200, 290, 400)):
        other = np.concatenate((base[changed:], r.integers(0, 2**63, changed).astype(np.uint64)))
        a, b = near_duplicates.bit_signature(base), near_duplicates.bit_signature(other)
        assert low <= sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= high


def test_star_blocks_against_plain_sets():
    r = random.Random(8)
    for _ in range(60):
        hub = set(range(40))
        sets = {i: {x if r.random() > 0.3 * r.random() else 100 + r.randint(0, 12) for x in r.sample(sorted(hub), r.randint(25, 40))} for i in range(30)}
        linked = lambda a, b: 175 * len(a & b) >= 75 * (len(a) + len(b))
        roots = {i: -1 if linked(s, hub) else i for i, s in sets.items()}
        as_array = lambda s: np.array(sorted(s), np.int64)
        rows = {i: (i, roots[i], len(s), len(s & hub), len(hub), not linked(s, hub), as_array(hub - s), as_array(s - hub)) for i, s in sets.items()}
        block, found = near_duplicates._Block(list(rows.values())), []
        for i, row in rows.items():
            if row[5]:
                found += [(i, y) for y in block.links(row[0], row[1], row[2], row[3], row[6], row[7])]
        assert all(linked(sets[a], sets[b]) for a, b in found) and len(found) < 30

        def parts(edges, roots=roots):
            of = dict(roots)
            for a, b in edges:
                x, y = of[a], of[b]
                of = {k: x if v == y else v for k, v in of.items()}
            return {frozenset(k for k in of if of[k] == v) for v in of.values()}

        assert parts(found) == parts([(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])

"""Near-duplicates, tokens, packing, language and quality against plain versions on small tables."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tradeweft.llm import byte_bpe, hashing, lang_id, near_dedup, packing, quality, rans, tokens
from tradeweft.llm.components import components
from tradeweft.llm.tokens import Encoder

ODD = ["", None, "a  b", "a   b", "x \n y", " lead", "trail ", "a\n b\n", "tab\tb \t c", "éx", "日本語 テキスト",
       "it's we'LL 'S", "\x00 \x01", "<|endoftext|> x", "x" * 300, "💩👍🏽", "İstanbul ẞ Σας", "a\x1cb !\x1c", "​  z", "a \n", "\n a",
       "é café", "word " * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, score double, ids string"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, texts, langs=None):
    """Documents with extra columns whose names clash with result columns."""
    return spark.createDataFrame([(i, t, langs[i] if langs else None, None, 0.5, "x") for i, t in enumerate(texts)], SCHEMA)


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in range(9, 14)}).split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute_force_components(texts):
    sets, low = [shingles(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(a & sets[j])
                if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    return {i: (len(s), low[i], low[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    texts = ["", None, "  \n", "one two", "ONE two", "one two three four five", "É é", "é é", "same " * 30, "same " * 40]
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(60)]
        passage = " ".join(WORDS[:20])
        for edits in (0, 0, 1, 2, 3, 4, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(60)] = rng.choice(WORDS)
            texts.append(" ".join(own) + (" " + passage if rng.random() < 0.3 else ""))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link(documents(spark, texts)).collect()}
    assert got == brute_force_components(texts)


def test_large_nodes_branch_and_meet_in_blocks(spark, monkeypatch):
    """Chains of texts in one large node, with the exhaustive step reached at once."""
    monkeypatch.setattr(near_dedup, "NODE", 3)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    base = list(WORDS[:80])
    texts = []
    for i in range(24):
        own = list(base)
        own[3 * i] = f"x{i}"
        base = own
        texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link(documents(spark, texts)).collect()}
    assert got == brute_force_components(texts)


def test_alike_classes_do_not_branch_through_all_levels(spark, monkeypatch):
    """A group of alike texts stays together in every level: it is compared where that shows, and rows of members stay few."""
    monkeypatch.setattr(near_dedup, "NODE", 8)
    branch, rows = near_dedup._branch, []

    def counted(members, keep):
        rows.append(members.count())
        return branch(members, keep)

    monkeypatch.setattr(near_dedup, "_branch", counted)
    rng = random.Random(6)
    texts = []
    for _ in range(60):  # similarity of most pairs is about 0.6, that of a few above 0.75
        own = list(WORDS[:300])
        for at in rng.sample(range(300), rng.choice((5, 12, 16))):
            own[at] = f"y{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link(documents(spark, texts)).collect()}
    want = brute_force_components(texts)
    assert got == want and 1 < len({c for _, c, _ in want.values()}) < 60
    assert sum(rows[2:]) < rows[1]  # rows[0]: the trees' roots, rows[1]: members of large nodes of the first level


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert near_dedup.link(documents(spark, [])).count() == 0
    df = documents(spark, ["a b c d e f", "a b c d e f", "z"])
    rows = sorted(map(tuple, near_dedup.link(df.union(df)).collect()))
    assert rows == [(0, 2, 0, True)] * 2 + [(1, 2, 0, False)] * 2 + [(2, 1, 2, True)] * 2
    assert sorted(r.doc_id for r in near_dedup.keep_first(df).collect()) == [0, 2]
    nameless = spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in near_dedup.link(nameless).collect()] == [(1, 1, 1, True)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    got = Encoder(public_tokenizers.path(name)).encode(ODD)
    for text, ids in zip(ODD, got):
        assert np.frombuffer(ids, "<u4").tolist() == (whole.encode(text, add_special_tokens=False).ids if text else [])


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(rans, "SEGMENT", 500)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, at = Tokenizer.from_file(path), 0
    whole.encode_special_tokens = True
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rans.round_trip(documents(spark, ODD), path).collect()}
    for i, text in enumerate(ODD):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rans.round_trip(documents(spark, []), path).count() == 0


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 300_000])
def test_blocks_decode_whole_in_parts_and_notice_damage(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 49_000
    symbols, freq = rans.frequencies(ids)
    assert freq.sum() == 1 << rans.SCALE and freq.min() >= 1
    table, places = rans.Table(symbols, freq), np.searchsorted(symbols, ids)
    for i in range(0, n, rans.LANES * rans.STEPS):
        own = places[i:i + rans.LANES * rans.STEPS]
        block = rans.encode_block(own, table)
        assert (rans.decode_block(block, table) == own).all()
        step = rans.LANES * rans.CHECKPOINT
        for part in range(-(-len(own) // step)):
            assert (rans.decode_block(block, table, part) == own[part * step:(part + 1) * step]).all()
        with pytest.raises(ValueError):
            rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_byte_bpe_equals_tiktoken(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = byte_bpe.RankMap(ranks)
    df = byte_bpe.encode(documents(spark, ODD), full, public_tokenizers.PATTERN)
    for r in df.withColumn("bytes", byte_bpe.decode(df.ids, full)).collect():
        assert r.ids == own.encode_ordinary(ODD[r.doc_id] or "")
        assert bytes(r.bytes) == (ODD[r.doc_id] or "").encode()


def test_tokens_that_merging_misses_are_found_whole():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"cd": 257, b"abcde": 258}
    made = byte_bpe.RankMap(ranks)
    assert made.missed == {b"abcde": 258} and base64.b64encode(b"ab") == b"YWI="


def test_packing_is_gapless_and_close_to_the_bound(spark):
    texts = [" ".join(WORDS[i % 300:i % 300 + i % 97]) for i in range(600)] + ["", None, "word " * 1023, "word " * 1024, "word " * 5000]
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(documents(spark, texts), path)
    rows = packed.toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.groupby("sequence_id").length.cumsum()
    assert (ends - rows.length == rows.offset).all() and ends.max() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1
    whole = Tokenizer.from_file(path)
    by_doc = {k: g.sort_values("piece") for k, g in rows.groupby("doc_id")}
    for i, text in enumerate(texts):
        ids, own = np.array([*whole.encode(text or "").ids, 2], "<u4"), by_doc[i]
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
        for _, p in own.iterrows():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    made = packing.sequences(documents(spark, texts), packed, path).collect()
    assert sum(len(r.ids) for r in made) == 4 * rows.length.sum()
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_crossover_keeps_every_item_once():
    rng, lengths = np.random.default_rng(2), np.random.default_rng(1).integers(1, 1024, 500)
    a, b = packing.fresh(lengths, 1024, 0.0, rng), packing.fresh(lengths, 1024, 200.0, rng)
    child = packing.cross(a, b, lengths, 1024, rng)
    assert child.loads.sum() == lengths.sum() and child.loads.max() <= 1024 and (child.loads > 0).all()


def test_gradients_of_the_network_are_right():
    net = lang_id.Network(["a", "b", "c"], seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 4)), np.array([0, 2, 1, 1])
    mask = (np.arange(5)[:, None] < np.array([5, 3, 5, 1])[None]).astype(float)

    def loss():
        p = net.probabilities(x, mask)
        return -(np.log(p[:, y, np.arange(4)]) * mask).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name in ("Ef", "Ub", "Vf", "c"):
        at = tuple(0 if name != "Ef" else (0, x[0, 0])[i] for i in range(2))
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-2 - grads[name][at]) < 0.02 + 0.3 * abs(grads[name][at])


def test_language_of_held_out_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    named = lang_id.identify(df, lang_id.train(df)).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in named]) > 0.85 and all(0 <= r.score <= 1 for r in named)


def test_language_of_odd_texts(spark):
    texts = ["the and of", "der die das", *["the house and of it"] * 20, *["das haus und der die"] * 20, "", None, "123 !!", "é" * 5000]
    langs = ["en", "de", *["en"] * 20, *["de"] * 20, "en", None, "de", None]
    df = documents(spark, texts, langs)
    net = lang_id.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(df, net).collect()}
    assert [got[i] for i in (42, 43, 44)] == [("und", 0.0)] * 3 and got[45][0] in ("en", "de")
    assert {r.doc_id for r in lang_id.keep_known(df, net).collect()} == set(range(42)) | {45}
    assert {r.lang_pred for r in lang_id.identify(documents(spark, ["a"]), None).collect()} == {"und"}
    assert lang_id.identify(documents(spark, []), lang_id.train(documents(spark, []))).count() == 0


def test_quality_of_held_out_documents(spark, small):
    df, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(df, labels).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.8


def test_quality_of_odd_texts_and_labels(spark):
    texts = [*["fine words in a text"] * 30, *["BAD!! BAD!!"] * 30, "", None, "é " * 4000]
    labels = spark.createDataFrame([(i, int(i < 30) if i < 60 else None) for i in range(62)] + [(None, 1), (999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(documents(spark, texts), labels).collect()}
    assert len(got) == 63 and got[0] > got[30] and got[60] == got[61] and all(0 <= s <= 1 for s in got.values())
    none = quality.classify(documents(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_one_pass_equals_plain_follow_the_regularised_leader():
    texts, labels = [b"a b c", b"x y", b"a c", b""], [1, 0, 1, 0]
    z, n = {}, {}
    for (ids, x), y in zip(quality.features(texts), labels):
        w = {}
        for i in ids.tolist():
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= quality.L1 else (np.sign(zi) * quality.L1 - zi) / (
                (quality.BETA + ni ** 0.5) / quality.ALPHA + quality.L2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(ids.tolist(), x.tolist()))))
        for i, v in zip(ids.tolist(), x.tolist()):
            g = (p - y) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    state = quality.ftrl_pass(texts, labels, np.zeros((2, 1 << quality.BITS)))
    assert all(abs(state[0][i] - v) < 1e-6 for i, v in z.items())


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_that_agree_in_polynomial_hashes(name):
    """Polynomials modulo a power of two hash these words alike, whatever their base."""
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for n in (64, 256, 1024, 4096):
        text = f"x {thue_morse(n, 0)} {thue_morse(n, 1)}"
        assert np.frombuffer(Encoder(path).encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    a, b = (near_dedup.word_hashes([thue_morse(1024, flip).encode()])[0] for flip in (0, 1))
    assert a[0] != b[0]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """With hashes that say nothing, the bytes decide."""
    monkeypatch.setattr(hashing, "hashes_of", lambda raw, starts, ends: np.zeros(len(starts), np.uint64) + (starts % 2).astype(np.uint64))
    text = " ".join(random.Random(4).choices(["a", "b", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "Abcdefgh" * 40], k=200))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        assert np.frombuffer(Encoder(path).encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 2000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = " ".join(WORDS * 3)
    encoder = Encoder(path)
    whole = Tokenizer.from_file(path)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert encoder.words.held <= 1000 and len(encoder.words) < 10


def test_keep_first_with_null_and_repeated_ids(spark):
    text = " ".join(WORDS[:40])
    rows = [(None, text), (None, text), (1, text), (1, text), (2, text), (3, "other words " * 9), (3, "other words " * 9), (4, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, count string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in near_dedup.keep_first(docs).collect() if r.text)
    assert got == [(False, 0, text), (False, 0, text), (True, 1, text), (True, 3, "other words " * 9)]
    assert near_dedup.keep_first(docs).where("doc_id = 4").count() == 1


def test_pieces_are_folded_once_and_numbered_anew(spark, monkeypatch):
    """Groups of a few texts, and numbers that start anew in between."""
    monkeypatch.setattr(byte_bpe, "GROUP", 200)
    monkeypatch.setattr(byte_bpe, "KNOWN", 60)
    monkeypatch.setattr(byte_bpe, "ROW", 7)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["", None, *(" ".join(rng.choices(WORDS[:120], k=rng.randrange(40))) for _ in range(90)), "  odd \n space"]
    got = {r.doc_id: list(r.ids) for r in byte_bpe.encode(documents(spark, texts).coalesce(1), byte_bpe.RankMap(ranks), public_tokenizers.PATTERN).collect()}
    assert got == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_the_fold_starts_from_one_number_a_token():
    """The rank of its pair, its place and its id: the smallest number is the next pair to merge, leftmost first."""
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    own = byte_bpe.RankMap(ranks)
    states = byte_bpe.start_states([b"baaa", b"x", b"aaa"], [-1, -1, 257], np.array(own.bytes, np.int32), own.starts).to_pylist()
    assert [[x & byte_bpe._LOW for x in s[1:-1]] for s in states] == [[98, 97, 97, 97], [120], [257]]
    assert all({s[0], s[-1]} == {byte_bpe._EDGE} for s in states)
    assert states[0].index(min(states[0])) == 2 and min(states[0]) >> byte_bpe._PLACED == 256
    assert min(states[1]) >= byte_bpe._DONE and min(states[2]) >= byte_bpe._DONE


def test_texts_and_ids_go_in_bounded_parts(spark, monkeypatch):
    """A few texts are Python objects at once, and row batches of ids have a bound, whatever the batches of Spark hold."""
    monkeypatch.setattr(byte_bpe, "TEXTS", 3)
    monkeypatch.setattr(byte_bpe, "IDS", 50)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    texts = [*ODD, *(" ".join(rng.choices(WORDS[:200], k=rng.randrange(30))) for _ in range(60))]
    coded = byte_bpe.encode(documents(spark, texts).coalesce(1), byte_bpe.RankMap(ranks), public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    held = byte_bpe._texts(batch)
    assert next(held) == texts[0] and [texts[0], *held] == texts and batch.num_rows > byte_bpe.TEXTS
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: plain.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_words_are_split_as_by_the_pattern():
    split, own = byte_bpe._Splitter(public_tokenizers.PATTERN), regex.compile(public_tokenizers.PATTERN)
    assert split.plain and not byte_bpe._Splitter(r"\S+").plain
    for word in [" word", "word", " word.,!", "\u00e4\u00df.", " \u00e9t\u00e9!!", " it's", " x1.", " ...", ".", " a\nb", " \u00aa", " \u4e2d.", " e\u0301.", "!word"]:
        assert [p.decode() for p in split(word.encode())] == own.findall(word)


@pytest.mark.parametrize("most", [5000, 1 << 23])
def test_segments_number_ids_without_sorting(most, monkeypatch):
    """Small ids are counted and numbered by arrays, without a sort; ids beyond those still go by search."""
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, most, n).astype("<u4") for n in (0, 1, 5000, 3000)]
    if most < rans._COUNTED:
        monkeypatch.setattr(np, "unique", None)
        monkeypatch.setattr(np, "searchsorted", None)
    doc_ids, back = rans.decode_segment(rans.encode_segment([4, 5, 6, 7], ids))
    assert list(doc_ids) == [4, 5, 6, 7] and all((a == b).all() for a, b in zip(ids, back))

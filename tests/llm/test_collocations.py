"""Phrases against plain counting; intervals against the places of phrases in a sequence."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradeweft.llm import collocations as C


def brute(rows, words=3, least=10, inside=50, top=2000):
    counts, n = [Counter() for _ in range(words + 1)], Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            own = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(own)
            for k in range(1, words + 1):
                for i in range(len(own) - k + 1):
                    counts[k][lang, tuple(own[i:i + k])] += 1
    found = defaultdict(list)
    for k in range(2, words + 1):
        for (lang, p), a in counts[k].items():
            if a < least:
                continue
            if any(100 * b >= inside * a for m in range(k + 1, words + 1) for (other, q), b in counts[m].items()
                   if other == lang and b >= least and any(q[i:i + k] == p for i in range(m - k + 1))):
                continue
            cuts = [(1_000_000 * a * a // (counts[j][lang, p[:j]] * counts[k - j][lang, p[j:]]), j) for j in range(1, k)]
            score, j = min(cuts)
            found[lang].append((-score, -a, " ".join(p).encode(), counts[j][lang, p[:j]], counts[k - j][lang, p[j:]]))
    return sorted((lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score)
                  for lang, own in found.items() for i, (score, a, phrase, l, r) in enumerate(sorted(own)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def some_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["new", "York", "City", "the", "of", "a", "é", "日本", "x\x01y", "it's", "Z", "z"]
    texts = []
    for _ in range(n):
        own = []
        for _ in range(rng.randrange(30)):
            own.append("new york city" if rng.random() < 0.2 else rng.choice(vocabulary))
            if rng.random() < 0.2:
                own[-1] += rng.choice(".,;:!?\n\r\t")
        texts.append((rng.choice(["en", "de", None]), " ".join(own)))
    return texts


@pytest.mark.parametrize("words", [2, 3, 4])
def test_phrases_equal_plain_counts(spark, monkeypatch, words):
    monkeypatch.setattr(C, "SHARD", 900)
    monkeypatch.setattr(C, "BUCKET", 100)
    rows = some_texts(words, 150) + [(None, None), ("fr", ""), ("fr", "  \n . "), ("en", "a b " * 800), ("en", "q " * 900), ("de", "u.v" * 700)]
    docs = spark.createDataFrame([(i, lang, t, 0, "x") for i, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, n long, word string")
    assert got(C.collocations(docs, words=words, least=5)) == brute(rows, words, 5)
    assert got(C.collocations(docs.repartition(3), words=words, least=5, top=7)) == brute(rows, words, 5, top=7)


def test_given_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(250)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert got(C.collocations(spark.createDataFrame(rows, "lang string, text string"))) == brute(rows)


def test_nothing_and_repeated_rows(spark):
    docs = spark.createDataFrame([("en", "a b c")] * 12 + [("en", None)], "lang string, text string")
    assert got(C.collocations(docs)) == brute([("en", "a b c")] * 12) == [("en", 1, "a b c", 12, 12, 12, 36, 1_000_000)]
    assert got(C.collocations(docs.limit(0))) == [] == got(C.collocations(docs.filter("text IS NULL")))


def test_intervals_hold_the_places_of_phrases():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 5, 400)
    s[0] = s[-1] = 0
    index = C.Index(s, 5, 4)
    text = s.tolist()
    plain = [Counter(tuple(text[i:i + k]) for i in range(len(text) - k + 1) if 0 not in text[i:i + k]) for k in range(5)]

    def order(columns):
        return np.arange(len(columns[0]))

    masks = []
    for k in (2, 3, 4):
        columns, _, counts = C.frequent_only(index, masks, order)
        assert dict(zip(zip(*(c.tolist() for c in columns)), counts.tolist())) == plain[k]
        masks.append(np.ones(len(counts), bool))
    assert C.numbered([b"a b.c", b"a"], ["x", "x"])[0].tolist().count(0) == 4


def test_words_of_one_hash(monkeypatch):
    from tradeweft.llm import hashing
    monkeypatch.setattr(hashing, "hashes_of", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    sequence, langs, words, counts = C.numbered([b"a b c a", b"b b"], ["en", "de"])
    assert sorted(zip(langs, words, counts.tolist())) == [("de", "b", 2), ("en", "a", 2), ("en", "b", 1), ("en", "c", 1)]
    assert [words[i - 1] for i in sequence if i] == ["a", "b", "c", "a", "b", "b"]

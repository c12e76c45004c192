"""Numbers of tokens of whole texts, by the tokenizers or the sentencepiece library.

Arrow batches of texts are cut into groups of bounded bytes, and only the lengths of what the library
returns are kept. Texts are cut before that, at places where the tokenizer never
joins both sides. Where white space is dropped, the parts are words, and of equal ones only one is
encoded (a worker remembers the lengths of ``KNOWN`` words, and of as many parts of words); elsewhere
long texts alone are cut, and parts go to the library in batches of nearly equal bytes. The places are:

* a tokenizer that drops white space: behind any ASCII white space;
* one that keeps it (byte level): between an ASCII letter and a single space before a letter;
* a sentencepiece model: at a single space between two ASCII letters, which is left out, since the
  model puts a space before each text by itself.

No special string of the vocabularies holds white space, so none is cut. A text without such a place
stays whole, whatever its length. Strings of special tokens inside a text count as the library's own
default has it.

Nulls count as empty texts (0 bytes, 0 tokens); rows with a null or repeated id are counted each for
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweft.llm.common import texts_of
from tradeweft.llm.hashing import blocks, cut_words, distinct
from tradeweft.llm.tokens import Encoder

#: Characters after which a text is cut at the next safe place, and characters in one call of the library.
PIECE, BATCH = 1 << 15, 1 << 18
#: Bytes of text whose words are made distinct together; words remembered by a worker, and parts (about 40 MB each).
WORDS, KNOWN = 4 << 20, 300_000
_DROPS = "white space"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_KEEPS = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")
_LED = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


class Counter:
    """The library's tokenizer for one file: where a text may be cut, and lengths of many texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its cores
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.safe, self.lengths = _LED, lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            with open(path, encoding="utf-8") as f:
                steps = (json.load(f)["pre_tokenizer"] or {}).get("pretokenizers", [])
            drops = any(s["type"] == "Split" and s["invert"] and s["behavior"] == "Removed" for s in steps)
            self.safe = _DROPS if drops else _KEEPS
            self.known: dict[bytes, int] = {}
            self.parts: dict[str, int] = {}
            self.own = Encoder(path)
            self.special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
            self.lengths = lambda texts: [len(e) for e in whole.encode_batch(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces whose tokens, one piece after the other, are those of the whole."""
        start = 0
        while len(text) - start > PIECE and (cut := self.safe.search(text, start + PIECE)):
            yield text[start:cut.start()]
            start = cut.end()
        yield text[start:]

    def count(self, texts: list[bytes]) -> np.ndarray:
        if self.safe is not _DROPS:
            return self._count_pieces(texts)
        out = np.zeros(len(texts), np.int64)
        for a, b in blocks(texts, WORDS):
            raw, starts, ends, hashes, bounds = cut_words(texts[a:b], _WHITE, _SAME)
            first, kind = distinct(raw, starts, ends, hashes)
            data = raw.tobytes()
            words = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
            new = [w for w in words if w not in self.known]
            if len(self.known) + len(new) > KNOWN:
                self.known, new = {}, words
            self.known.update(zip(new, map(self._word, new)))
            made = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            sums = np.concatenate([[0], np.cumsum(made[kind])])
            out[a:b] = np.diff(sums[bounds])
        return out

    def _word(self, word: bytes) -> int:
        """Length of a word: of Latin letters, by the library's merges of the parts that the pattern finds;
        else, or with the string of a special token, by the whole tokenizer."""
        text = word.decode()
        if self.special.search(text) or max(text) >= "\u0250":
            return self.lengths([text])[0]
        core = text.rstrip(".,!")
        low = core.lower() if self.own.lower else core
        if low.isalpha() and max(low) < "\u0250":
            return self._part(low) + (self._part(text[len(core):]) if len(core) < len(text) else 0)
        return sum(map(self._part, self.own.pattern.findall(text.lower() if self.own.lower else text)))

    def _part(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            if len(self.parts) >= KNOWN:
                self.parts = {}
            letters = part.encode().decode("latin-1").translate(self.own.letters)
            self.parts[part] = n = len(self.own.model.tokenize(letters))
        return n

    def _count_pieces(self, texts: list[bytes]) -> np.ndarray:
        owners, parts = [], []
        for i, text in enumerate(texts):
            for part in self.pieces(text.decode()):
                owners.append(i)
                parts.append(part)
        made: list[int] = []
        for a, b in balanced(np.fromiter(map(len, parts), np.int64, len(parts))):
            made += self.lengths(parts[a:b])
        return np.bincount(np.array(owners, np.int64), np.array(made), len(texts)).astype(np.int64)


def balanced(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of nearly equal total size, of about ``BATCH`` each."""
    ends = np.cumsum(sizes)
    if len(ends):
        n = int(ends[-1]) // BATCH + 1
        cuts = np.searchsorted(ends, np.arange(1, n) * (int(ends[-1]) / n))
        cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One tokenizer per worker and file, which has to lie at ``path`` on every node."""
    return Counter(path)


def count_tokens(documents: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, bytes and tokens of each whole text, and whether it has more than ``limit`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            data = texts_of(batch, "text")
            tokens = count(data)
            yield pa.RecordBatch.from_pydict({
                "key": batch.column("key"), "n_bytes": pa.array(map(len, data), pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return made.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

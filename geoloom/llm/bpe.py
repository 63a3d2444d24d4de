"""Byte-pair encoding and decoding of whole texts, by speculation and verification.

A word's tokens are guessed by greedy longest match. A guess is right if every
adjacent pair of its tokens is compatible, that is, if encoding the pair's
joined symbols by exact merging gives the same two tokens: in this vocabulary
a merge that crosses a border would have to happen within the pair. The checks
of all words of a batch are one vectorised look-up in a table of known pairs.
Words with an incompatible pair, and words that merging checks reject, are
merged exactly. Words repeat a lot, so each task keeps a bounded table of
words that it has encoded.

The vocabulary file is that of the tokenizers library; its normaliser (NFC,
white space, lower case), splitter, byte alphabet, end-of-word mark and added
tokens are followed. Decoding joins the tokens' texts by one space, as the
library does for a file without a decoder.

Defined results for odd input: a null text counts as empty; an empty text has
no tokens and decodes to the empty text. Repeated rows are kept, columns other
than doc_id and text are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import table

#: Words that a task remembers, and their letters.
REMEMBERED, LETTERS = 120_000, 4_000_000
#: Tokens whose ids a task holds before it gives them back.
HELD = 1 << 18
#: Symbols up to which merging goes through all pairs each time.
SHORT = 48
END = "</w>"
#: Bits of a token id within a packed pair, and the rank of a pair that has no merge.
BITS = 20
MASK, NONE = (1 << BITS) - 1, 1 << 60
KNOWN = regex.compile(r"[\p{L}\p{N}]")


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    table_ = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table_[b] for b in range(256)]


@lru_cache(maxsize=2)
def newer_letters(pattern: str) -> tuple[frozenset[str], dict[int, str]]:
    """Letters and digits, unknown to Python's tables, that the library's splitter takes for signs, and their lower case."""
    splitter, lower = pre_tokenizers.Split(Regex(pattern), "removed", invert=True), normalizers.Lowercase()
    unsure = [c for c in map(chr, [*range(0x100, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn" and KNOWN.match(c)]
    signs = frozenset(c for c in unsure if splitter.pre_tokenize_str(f"a{c}!")[0][0] == "a" and len(splitter.pre_tokenize_str(f"a{c}!")) == 2)
    return signs, {ord(c): low for c in unsure if (low := lower.normalize_str(c)) != c}


class Vocabulary:
    """A word-end byte-pair vocabulary and its encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        #: Merges by their two ids: rank, then the id of the result.
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            x, y = merge if isinstance(merge, list) else merge.split(" ", 1)
            self.merges.setdefault(self.ids[x] << BITS | self.ids[y], rank << BITS | self.ids[x + y])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.newer, self.newer_lower = newer_letters(pattern)
        self.alphabet = byte_alphabet()
        self.plain = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet) if b < 128})
        self.longest = max(map(len, self.ids))
        #: Encoded words of this and the previous generation.
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.letters = 0
        self.pairs: dict[int, bool] = {}

    # normalising -------------------------------------------------------

    @staticmethod
    def lower(text: str) -> str:
        """Lower case letter by letter: a final sigma is not special."""
        return text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The words of a text without added tokens, in order."""
        if text.isascii():
            return self.split.findall(text.lower())
        text = self.lower(unicodedata.normalize("NFC", text))
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            text = text.translate(self.newer_lower)
            if newer := self.newer & set(text):
                hidden = text.translate({ord(c): "\ue000" for c in newer})
                return [text[m.start() : m.end()] for m in self.split.finditer(hidden)]
        return self.split.findall(text)

    def symbols(self, word: str) -> str:
        """A word's bytes in the byte alphabet."""
        if word.isascii():
            return word.translate(self.plain)
        return "".join([self.alphabet[b] for b in word.encode("utf-8")])

    # exact merging -----------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge of least rank, leftmost first, until none is left."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << BITS | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NONE:
            at = ranks.index(best)
            ids[at : at + 2] = [best & MASK]
            del ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << BITS | ids[at], NONE)
            if at < len(ranks):
                ranks[at] = get(ids[at] << BITS | ids[at + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for a long word: a heap of merges over neighbours that are linked both ways."""
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(best, at) for at, (a, b) in enumerate(zip(ids, ids[1:])) if (best := get(a << BITS | b, NONE)) != NONE]
        heapify(heap)
        gone = -1
        while heap:
            best, at = heappop(heap)
            end = after[at]
            if ids[at] == gone or end >= n or get(ids[at] << BITS | ids[end], NONE) != best:
                continue  # one of the two has changed since
            ids[at], ids[end] = best & MASK, gone
            after[at] = end = after[end]
            if end < n:
                before[end] = at
                if (best := get(ids[at] << BITS | ids[end], NONE)) != NONE:
                    heappush(heap, (best, at))
            if (left := before[at]) >= 0 and (best := get(ids[left] << BITS | ids[at], NONE)) != NONE:
                heappush(heap, (best, left))
        return [i for i in ids if i != gone]

    def start(self, symbols: str) -> list[int]:
        """Ids of the single symbols, the last with the end mark."""
        ids = self.ids
        return [*[ids[c] for c in symbols[:-1]], ids[symbols[-1] + END]]

    # speculation -------------------------------------------------------

    def guess(self, symbols: str) -> list[int] | None:
        """Ids by greedy longest match; None if a symbol has no token."""
        out, at, n, ids = [], 0, len(symbols), self.ids
        whole = ids.get(symbols + END)
        if whole is not None:
            return [whole]
        while at < n:
            token = ids.get(symbols[at:] + END) if n - at <= self.longest else None
            if token is not None:
                out.append(token)
                return out
            for end in range(min(n - 1, at + self.longest), at, -1):
                token = ids.get(symbols[at:end])
                if token is not None:
                    break
            else:
                return None
            out.append(token)
            at = end
        return out

    def own_symbols(self, a: int) -> list[int]:
        """The single symbols that a token is made of."""
        x = self.texts[a]
        return self.start(x[: -len(END)]) if x.endswith(END) and x != END else [self.ids[c] for c in x]

    def compatible(self, a: int, b: int | None) -> bool:
        """Whether exact merging of the tokens' joined symbols gives back just them; ``b`` may be missing."""
        both = [a] if b is None else [a, b]
        return self.merge([s for t in both for s in self.own_symbols(t)]) == both

    def learn(self, words: list[str]) -> None:
        """Encode the words and remember them."""
        guesses, exact = [], []
        for word in words:
            s = self.symbols(word)
            g = self.guess(s)
            if g is None or len(g) == 0:
                exact.append((word, s))
            else:
                guesses.append((word, s, g))
        # every adjacent pair of all guesses, looked up together; a lone token is paired with itself as -1
        flat = np.fromiter((i for _, _, g in guesses for i in g), np.int64)
        size = np.fromiter((len(g) for _, _, g in guesses), np.int64, len(guesses))
        last = np.zeros(len(flat), bool)
        last[np.cumsum(size) - 1] = True
        code = flat << BITS
        code[:-1] |= np.where(last[:-1], MASK, flat[1:])
        if len(code):
            code[-1] |= MASK
        asked = last & ~np.isin(np.arange(len(flat)), np.cumsum(size)[size == 1] - 1)
        code = np.where(asked, -1, code)  # the last token of several has no pair of its own
        distinct, where = np.unique(code, return_inverse=True)
        ok = np.fromiter((self._known(int(c)) for c in distinct), bool, len(distinct))[where]
        bad = np.zeros(len(guesses), bool)
        np.logical_or.at(bad, np.repeat(np.arange(len(guesses)), size), ~ok)
        for (word, s, g), wrong in zip(guesses, bad):
            if wrong:
                exact.append((word, s))
            else:
                self._put(word, g)
        for word, s in exact:
            self._put(word, self.merge(self.start(s)))

    def _known(self, code: int) -> bool:
        if code < 0:
            return True
        if (known := self.pairs.get(code)) is None:
            a, b = code >> BITS, code & MASK
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            known = self.pairs[code] = self.compatible(a, None if b == MASK else b)
        return known

    def _put(self, word: str, ids: list[int]) -> None:
        self.words[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.texts[i] for i in ids]))

    # texts -------------------------------------------------------------

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """``(number of tokens, ids, decoded)`` of each word and added token, in order."""
        out, at = [], 0
        if self.added:
            for m in self.special.finditer(text):
                out += self._words(text[at : m.start()])
                i = self.added[m[0]]
                out.append((1, str(i), m[0]))
                at = m.end()
        return out + self._words(text[at:] if at else text)

    def _words(self, text: str) -> list[tuple[int, str, str]]:
        words = self.pieces(text)
        known = self.words
        if new := {w for w in words if w not in known}:
            self.letters += sum(map(len, new))
            if len(known) + len(new) > REMEMBERED or self.letters > LETTERS:
                self.older, known = known, {}
                self.words, new = known, set(words)
                self.letters = sum(map(len, new))
            learn = []
            for w in new:
                if (old := self.older.get(w)) is None:
                    learn.append(w)
                else:
                    known[w] = old
            self.learn(learn)
        return [known[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for n, ids, _ in self.parts(text or "") if n for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.texts[i] for i in ids])

    def joined(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, the ids and the decoded text, each joined by blanks."""
        parts = [p for p in self.parts(text or "") if p[0]]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])


def digest(joined: tuple[int, str, str]) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids and of the decoded text."""
    return joined[0], hashlib.sha256(joined[1].encode()).hexdigest(), hashlib.sha256(joined[2].encode()).hexdigest()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a worker."""
    return Vocabulary(path)


def _parts(texts: pa.Array, path: str):
    """Texts in parts, as ``(joined forms, ids)``: a part ends with the text that brings its tokens to ``HELD``, or with its 1,024th."""
    v, rows, ids, n = vocabulary(path), [], [], 0
    for k in range(len(texts)):
        joined = v.joined(texts[k].as_py())
        rows.append(joined)
        ids.append(np.array(joined[1].split(), np.int32))
        n += joined[0]
        if n >= HELD or len(rows) == 1024:
            yield rows, ids
            rows, ids, n = [], [], 0
    if rows:
        yield rows, ids


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)], dtype=np.int32), np.concatenate(ids))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Add ``ids`` (array of token ids) to ``docs``; the text column is replaced by nothing else."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for _, part in _parts(texts, path):
                yield _lists(part)

    return docs.withColumn("ids", ids(F.col("text").cast("string")))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` to a table with ``ids``; null ids decode to the empty text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return pd.Series([v.decode([] if i is None else i) for i in ids])

    return tokens.withColumn("decoded", text("ids"))


DIGEST = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string"


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, number of tokens and digests of ids and decoded text, for every row."""

    @F.pandas_udf(f"struct<{DIGEST}>")
    def found(texts: pd.Series) -> pd.DataFrame:
        v = vocabulary(path)
        return pd.DataFrame([digest(v.joined(t)) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, the digests and ``ids`` of every row, in one pass; a task holds the ids of a part of its batch."""

    @F.arrow_udf(f"struct<{DIGEST}, ids: array<int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for rows, ids in _parts(texts, path):
                columns = [pa.array(c) for c in zip(*map(digest, rows))]
                yield pa.StructArray.from_arrays([*columns, _lists(ids)], ["n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")


def default_path() -> str:
    """The installed public vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())


QUERIES = {"op9_bpe": op9_bpe}

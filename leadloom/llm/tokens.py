"""Token ids of whole texts by a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every byte prefix of a word there is
exactly one token with which the prefix's encoding ends; it is the token that
ends there and is compatible with the last token of the prefix before it. The
stored last tokens give the encoding by walking back, stay valid when text is
appended, and up to the place of an edit.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: folder of the vocabulary files unless the session names another in this setting
TOKENIZER_DIR, TOKENIZER_SETTING = "/opt/tokenizers", "spark.leadloom.tokenizers"
#: Fixed value: the pattern by which the vocabulary's own encoder splits text into words.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: words whose ids one worker keeps; a full store is emptied
KEPT_WORDS = 100_000


class Vocabulary:
    """Ranks of a ``.tiktoken`` file and an automaton that finds all tokens ending at a byte."""

    def __init__(self, path: str) -> None:
        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        self.endings = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Encoding by merging: the adjacent pair of lowest rank first. The definition; used for pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: their bytes encode to just these two."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Of each prefix of data (index: its length) the last token of its
        encoding. last: such a list of a prefix of data, which is kept."""
        last = [-1] if last is None else last[: len(data) + 1]
        done = len(last) - 1
        last += [-1] * (len(data) - done)
        # a token that ends behind the known prefix may begin in it
        longest = max(map(len, self.rank)) if done else 0
        start = max(0, done - longest)
        for end, (token, size) in self.endings.iter(data[start:].decode("latin-1")):
            i = start + end + 1
            if i > done and last[i] < 0:
                before = i - size
                if before == 0 or self.compatible(last[before], token):
                    last[i] = token
        return last

    def word_ids(self, data: bytes) -> list[int]:
        """Ids of one word: its stored last tokens, walked back from its end."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        last, i, out = self.last_tokens(data), len(data), []
        while i > 0:
            out.append(last[i])
            i -= len(self.token[last[i]])
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        words, out = self.words, []
        for word in WORDS.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = tuple(self.word_ids(word.encode("utf-8", "surrogatepass")))
                if len(words) >= KEPT_WORDS:
                    words.clear()
                if len(word) <= 64:
                    words[word] = ids
            out += ids
        return out


class Encoded:
    """A text with its ids that can grow and be edited without encoding it anew.

    Words end before the place of a change unless they touch it: all words but
    the last two before it keep their ids (a contraction such as ``'ll`` may
    join two), and behind it encoding stops as soon as a word boundary and the
    words after it are those of the old text.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.words: list[list[int]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for word in self.words for i in word]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, with_text: str) -> None:
        """Replaces text[start:end]."""
        text = self.text[:start] + with_text + self.text[end:]
        first = next((k for k in range(len(self.starts) - 1, -1, -1) if self.starts[k] <= start), 0)
        first = max(0, first - 2)
        at, shift = self.starts[first] if self.starts else 0, len(with_text) - (end - start)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, words, rest = self.starts[:first], self.words[:first], len(self.starts)
        for found in WORDS.finditer(text, at):
            if found.start() >= start + len(with_text) and found.start() in old:
                rest = old[found.start()]
                break
            starts.append(found.start())
            words.append(self.vocabulary.word_ids(found.group().encode("utf-8", "surrogatepass")))
        self.starts = starts + [s + shift for s in self.starts[rest:]]
        self.words = words + self.words[rest:]
        self.text = text


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def vocabulary_path(spark: SparkSession, name: str) -> str:
    """The rank file of a tokenizer in the folder the session names."""
    return os.path.join(spark.conf.get(TOKENIZER_SETTING, TOKENIZER_DIR), f"{name}.tiktoken")


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids: the token ids of every whole text. Null and empty texts have
    no ids (an empty list); repeated documents and any other columns are left
    as they are (extra columns are not read)."""
    path = vocabulary_path(documents.sparkSession, name)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch.column(1):
                text = text.as_py()
                if text:
                    flat.extend(known.encode(text))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, n_tokens; 0 for null and empty texts."""
    return token_ids(documents, name).select("doc_id", F.size("ids").alias("n_tokens"))


def token_texts(encoded: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, text of token ids (doc_id, ids): the inverse of ``token_ids``; a null or empty list is an empty text."""
    path = vocabulary_path(encoded.sparkSession, name)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = vocabulary(path).token
        for batch in batches:
            texts = [b"".join(spelled[i] for i in ids or ()).decode("utf-8", "surrogatepass") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")

"""Operator 6: token counts with the whole-token shortcut.

The tokenizer is a BPE with word ends over pre-tokens (letters, single digits, runs of other characters), after NFC,
white-space folding and lower-casing. Offline, before any text is read, every vocabulary string that can be a whole
pre-token is encoded alone; those that come out as exactly their own one token are the *proved* set. A pre-token in
that set counts one without any merging. Only the others go to the tokenizer, each distinct one once for each worker.

Matches never cross white space, so a text is cut at white space first and the counts of the chunks are memoised;
the memo is emptied when it holds ``MEMO`` chunks, and chunks of more than ``LONG`` characters are never kept.
Special strings inside a text are one token each, as the library treats them by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

MEMO, LONG = 400_000, 64
#: Characters that Python's str.split takes for white space and the tokenizer's \s does not.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = regex.compile(f"[{_WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte that prints stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary_words(spec: dict) -> dict[str, int]:
    """The vocabulary strings that end a word and are valid UTF-8, decoded, with their ids."""
    letters, end, out = byte_letters(), spec["model"].get("end_of_word_suffix") or "", {}
    for piece, number in spec["model"]["vocab"].items():
        if piece.endswith(end) and len(piece) > len(end):
            body = piece[: len(piece) - len(end)]
            if all(c in letters for c in body):
                try:
                    out[bytes(letters[c] for c in body).decode()] = number
                except UnicodeDecodeError:
                    continue
    return out


def prove_whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """The strings that the tokenizer, given them alone, encodes as the one token of that name."""
    from tokenizers import Tokenizer

    words, t = vocabulary_words(json.loads(tokenizer_json)), Tokenizer.from_str(tokenizer_json)
    names = list(words)
    return frozenset(w for w, e in zip(names, t.encode_batch(names, add_special_tokens=False)) if e.ids == [words[w]])


class TokenCounter:
    """Counts tokens of whole texts; ``shortcut`` and ``merged`` tell how many distinct pre-tokens went which way."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._find = regex.compile(pattern.replace(r"\s", _WHITE)).findall
        self._whole, self._tokenizer = whole, Tokenizer.from_str(tokenizer_json)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        self._cut = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        self._memo: dict[str, int] = {}
        self.shortcut = self.merged = 0

    def _chunk(self, chunk: str) -> int:
        n = 0
        for word in self._find(chunk):
            if word in self._whole:
                n += 1
                self.shortcut += 1
            else:
                n += len(self._tokenizer.encode(word, add_special_tokens=False).ids)
                self.merged += 1
        if len(chunk) <= LONG:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            self._memo[chunk] = n
        return n

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, without the final form
        text = text.lower()
        chunks = _SPACE.split(text) if any(c in text for c in _NOT_SPACE) else text.split()
        memo, n = self._memo, 0
        for chunk in chunks:
            k = memo.get(chunk)
            n += self._chunk(chunk) if k is None else k
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._special and any(s in text for s in self._special):
            return sum(map(self._plain, self._cut.split(text))) + len(self._cut.findall(text))
        return self._plain(text)


_counters: dict[int, TokenCounter] = {}


def counter_of(tokenizer_json: str, whole: frozenset[str]) -> TokenCounter:
    """One counter for each Python worker, whatever number of tasks it runs."""
    key = hash(tokenizer_json)
    if key not in _counters:
        _counters.clear()
        _counters[key] = TokenCounter(tokenizer_json, whole)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """One row for each document: bytes, tokens and whether the tokens exceed ``limit``. No shuffle.

    Null and empty texts have 0 bytes and 0 tokens, repeated rows each get a row, other columns are not read.
    The vocabulary file is read once on the driver and broadcast with the proved set: both are bounded by the vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast((spec, prove_whole_tokens(spec)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(*shipped.value)
        for batch in batches:
            tokens = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return d.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

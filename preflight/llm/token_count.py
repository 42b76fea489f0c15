"""Operator 8 — token counts by byte-pair merging, without token ids.

A word's bytes are symbols of a doubly linked list; a heap holds the rank
of every adjacent pair that may merge.  The lowest rank (leftmost first) is
popped again and again; entries whose pair has changed since are skipped.
The count is the number of initial symbols minus the number of merges.

The vocabulary file gives the merges; its normaliser (NFC, white space,
lower case) and its word pattern are restated here, its special strings
count one token each wherever they stand in a text.  Counts of words seen
before are remembered per Python worker, up to a fixed number of entries.

Cases: null and empty texts have no bytes and no tokens; repeated rows get
equal rows; a word of any length is merged whole; an empty table gives an
empty result.  Other columns are ignored (``count_tokens`` passes them through).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.llm.arrow_text import lean
from preflight.llm.ship import ship

LIMIT = 2048
#: Remembered words, and remembered stretches between white space, of a worker.
MEMO = 400_000

# fixed values of the vocabulary's word pattern and white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 characters are
    themselves, the other bytes are numbered from U+0100 in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


class Memo(dict):
    """Remembers up to ``MEMO`` counts; beyond, counts are made anew."""

    def __init__(self, make):
        self._make = make

    def __missing__(self, key):
        n = self._make(key)
        if len(self) < MEMO:
            self[key] = n
        return n


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.pattern = regex.compile(PATTERN)
        self.word = Memo(self._word)
        self.stretch = Memo(self._stretch)

    def _word(self, word: str) -> int:
        raw = word.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n = count = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] is None or j >= n:
                continue
            m = merges.get((ids[i], ids[j]))
            if not m or m[0] != rank:          # the pair has changed since
                continue
            ids[i], ids[j] = new, None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    heapq.heappush(heap, (m[0], i, m[1]))
            p = before[i]
            if p >= 0:
                m = merges.get((ids[p], new))
                if m:
                    heapq.heappush(heap, (m[0], p, m[1]))
        return count

    def _stretch(self, s: str) -> int:
        return self.word[s] if s.isalpha() and s.isascii() else sum(map(self.word.__getitem__, self.pattern.findall(s)))

    def _plain(self, text: str) -> int:
        if text.isascii():
            text = text.lower()
        else:
            # lower case character by character: no final-sigma rule
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        parts = SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        return sum(map(self.stretch.__getitem__, parts))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, on the machine that asks."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _count(column: str, name: str, path: str | None):
    def run(batches):
        c = counter(path or vocabulary(name))
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            keep = [i for i, f in enumerate(b.schema) if f.name != column]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in keep] + [pa.array([c(t) for t in texts], pa.int64())],
                names=[b.schema.field(i).name for i in keep] + ["n_tokens"])
    return run


def count_tokens(df: DataFrame, column: str = "text", name: str = "word_bpe_49k.json",
                 path: str | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` in place of its text column.  ``path``: a
    vocabulary file that every executor sees; without it each executor uses
    its own copy of the public file ``name``."""
    ship(df.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column]
    return df.mapInArrow(lean(_count(column, name, path)), ", ".join([*fields, "n_tokens long"]))


def op8_token_count(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(slim).withColumn("over_limit", F.col("n_tokens") > LIMIT)

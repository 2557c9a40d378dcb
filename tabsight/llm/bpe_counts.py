"""Token counts by byte-pair merging with a heap and a linked list.

A word starts as one symbol per byte; the adjacent pair of lowest rank is
popped and merged again and again.  The count is the initial symbols minus the
merges; no identifier is ever emitted.  Rules (normalisation, word pattern,
special strings, ranks) are read from the tokenizer's JSON file.

Counts of distinct chunks (text between white space) are kept in the task in a
table of at most ``MAX_CHUNKS`` entries; there is no shuffle.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are
counted each on its own; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import small_batches, tokenizer_path

MODEL = "word_bpe_49k.json"
MAX_CHUNKS = 400_000
LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class MergeCounter:
    """Counts the tokens of texts under one byte-level BPE file."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + suffix] for c in byte_symbols()]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        steps = spec.get("normalizer") or {"normalizers": []}
        kinds = [s["type"] for s in steps.get("normalizers", [steps])]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalisers {kinds} are not supported")
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        cut = spec["pre_tokenizer"]
        rules = cut.get("pretokenizers", [cut])
        split = next((r for r in rules if r["type"] == "Split"), None)
        if split is None or not (split["behavior"] == "Removed" and split["invert"]):
            raise ValueError("the word pattern of this file is not supported")
        self.word = regex.compile(split["pattern"]["Regex"])
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        if any(any(c.isspace() for c in s) for s in specials):
            raise ValueError("special strings with white space are not supported")
        self.max_chunks = max_chunks
        self.table: dict[str, int] = {"": 0}

    def merged(self, symbols: list[int]) -> int:
        """Symbols that are left when no adjacent pair has a rank."""
        n = left = len(symbols)
        if n < 2:
            return n
        sym, rank = list(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := rank.get((sym[i], sym[i + 1])):
                heap.append((hit[0], i, sym[i], sym[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one side was merged meanwhile
            sym[i], sym[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := rank.get((new, sym[k])):
                    heapq.heappush(heap, (hit[0], i, new, sym[k], hit[1]))
            h = before[i]
            if h >= 0 and (hit := rank.get((sym[h], new))):
                heapq.heappush(heap, (hit[0], h, sym[h], new, hit[1]))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # character by character: a final sigma is no other letter
            text = text.replace("Σ", "σ").lower()
        total = 0
        for w in self.word.findall(text):
            raw = w.encode("utf-8", "surrogatepass")
            total += self.merged([*[self.inner[b] for b in raw[:-1]], self.last[raw[-1]]])
        return total

    def chunk(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))

    def count(self, text: str) -> int:
        table = self.table
        if len(table) > self.max_chunks:
            table.clear()
            table[""] = 0
        total = 0
        for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            n = table.get(w)
            if n is None:
                n = table[w] = self.chunk(w)
            total += n
        return total


def count_udf(path: str):
    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = MergeCounter(path)
        for part in parts:
            yield pd.Series([counter.count(t) if t else 0 for t in part], dtype="int64")
    return count


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    return (docs.select(F.col(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                        count_udf(path or tokenizer_path(MODEL))(text).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))

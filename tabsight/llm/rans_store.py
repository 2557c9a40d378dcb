"""Token ids in a binary store: static range asymmetric numeral system.

Layout of a store (a folder, written and committed by Spark):

* ``table``: one row per id that occurs with its share of 2^``SCALE_BITS``; the
  shared frequency table of all blocks.
* ``blocks``: one row per block (bucket, seq): the ids of whole documents in
  ascending document order, about ``BLOCK_IDS`` of them, coded on their own
  with ``LANES`` interleaved states, so blocks decode in parallel.  Each has a
  directory (documents and their lengths), a checksum of its ids, and
  checkpoints (lane states and stream offset every ``CHECK_ROWS`` rows of
  lanes) from which a reader may start inside the block.

Documents are dealt to buckets by ranges of their id, so the store is in
ascending order of (bucket, seq); each bucket is sorted in one task.

Cases: a null text counts as empty (its ids are the end id only); a null id
sorts first; rows repeated with one id are ordered by their token ids, and are
all written; very long texts are one block each; an empty table gives an empty
store; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.llm.bpe_counts import byte_symbols
from tabsight.llm.common import keep, small_batches, tokenizer_path
from tabsight.session import checkpoint_dir

MODEL = "word_bpe_49k.json"
END = 2
SCALE_BITS = 18
LANES, CHECK_ROWS = 128, 128
BLOCK_IDS = 1 << 16
BUCKET_ROWS = 4000
MAX_CHUNKS = 600_000
LOW = np.uint64(1 << 31)
_GROUP = 16  # blocks coded side by side


class ChunkTokens:
    """Ids of the tokenizers library; distinct chunks are encoded once and
    joined back by position, as little-endian unsigned integers.

    No token reaches over white space, nor from a letter to the punctuation
    behind it, and the library composes a text, then drops case, before the
    merges.  So a text is lowered if that changes nothing else (it is composed
    and stays so, and holds neither a character whose lower case depends on its
    place nor the start of a special string), cut at spaces, and a word's last
    mark is a chunk of its own.  A chunk of letters is one word to the library, so its
    merge model is asked directly; any other chunk goes through all its steps."""

    MARKS = ".,;:!?"

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib, self.max_chunks = Tokenizer.from_file(path), max_chunks
        self.code = "H" if self.lib.get_vocab_size() <= 1 << 16 else "I"
        self.symbols = dict(enumerate(byte_symbols()))
        self.model, self.table = self.lib.model, _Table(self._chunk)

    def _chunk(self, w: str) -> bytes:
        if w.isalpha() and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w)):
            word = w if w.isascii() else w.encode().decode("latin-1").translate(self.symbols)
            return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
        if w[-1:] in self.MARKS and w[:-1].isalpha():
            return (self.table.get(w[:-1]) or self._chunk(w[:-1])) + self.table[w[-1]]
        return array(self.code, self.lib.encode(w, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _lowered(t: str) -> str:
        if "<|" in t:
            return t
        low = t.lower()
        if t.isascii():
            return low
        composed = unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", low)
        return low if composed and "\u03a3" not in t and "\u0130" not in t else t

    def encode(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.table.__getitem__
        for t in texts:
            if len(self.table) > self.max_chunks:
                self.table.clear()
            t = self._lowered(t)
            out.append(b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))))
        return out


class _Table(dict):
    """Values made on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


@functools.lru_cache(maxsize=1)
def _tokens(path: str) -> ChunkTokens:
    """One per Python worker, so that its tasks share the table."""
    return ChunkTokens(path)


def tokenise_udf(path: str, end: int | None = END):
    """Column function text -> ids as little-endian unsigned integers of the
    width ``id_type`` gives."""
    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = _tokens(path)
        tail = b"" if end is None else array(tokens.code, [end]).tobytes()
        for part in parts:
            out, texts = [], part.fillna("").tolist()
            for i in range(0, len(texts), 200):
                out += [ids + tail for ids in tokens.encode(texts[i:i + 200])]
            yield pd.Series(out, dtype=object)
    return run


def id_type(path: str) -> str:
    return "<u2" if ChunkTokens(path).code == "H" else "<u4"


class RansCoder:
    """Coder of blocks under one frequency table (symbols, shares)."""

    def __init__(self, symbols: np.ndarray, shares: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, self.freq = symbols[order].astype(np.uint32), shares[order].astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.place = np.zeros(int(self.symbols.max()) + 1, dtype=np.uint32)
        self.place[self.symbols] = np.arange(len(self.symbols))
        self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.bits, self.mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Payload of each block of ids."""
        b, lens = len(blocks), np.array([len(x) for x in blocks])
        rows = int(-(-lens.max() // LANES)) if b else 0
        s = np.zeros((b, rows * LANES), dtype=np.int64)
        for k, x in enumerate(blocks):
            s[k, :len(x)] = self.place[x]
        state = np.full((b, LANES), LOW, dtype=np.uint64)
        words, counts, checks = [None] * rows, np.zeros((rows, b), dtype=np.int64), {}
        lane = np.arange(LANES)
        for t in range(rows - 1, -1, -1):
            if (t + 1) % CHECK_ROWS == 0 and t + 1 < rows:
                checks[t + 1] = state.copy()
            sym = s[:, t * LANES:(t + 1) * LANES]
            f, c = self.freq[sym], self.start[sym]
            on = t * LANES + lane < lens[:, None]
            out = on & (state >= (f << np.uint64(63 - SCALE_BITS)))
            words[t] = (state[out] & np.uint64(0xFFFFFFFF)).astype("<u4")
            counts[t] = out.sum(axis=1)
            state = np.where(out, state >> np.uint64(32), state)
            q = state // f
            state = np.where(on, (q << self.bits) + (state - q * f) + c, state)
        owner = np.concatenate([np.repeat(np.arange(b, dtype=np.int16), n) for n in counts]) if rows else np.zeros(0, int)
        stream = np.concatenate(words) if rows else np.zeros(0, "<u4")
        stream = stream[np.argsort(owner, kind="stable")]
        ends = np.cumsum(counts.sum(axis=0)) if rows else np.zeros(b, int)
        result = []
        for k in range(b):
            own = stream[(ends[k - 1] if k else 0):ends[k]]
            marks = [t for t in sorted(checks) if t * LANES < lens[k]]
            done = np.concatenate(([0], np.cumsum(counts[:, k])))
            head = struct.pack("<QII", int(lens[k]), len(marks), len(own)) + state[k].astype("<u8").tobytes()
            # state after row t - 1 was decoded is the state before row t is
            points = b"".join(struct.pack("<IQ", t, int(done[t])) + checks[t][k].astype("<u8").tobytes() for t in marks)
            result.append(head + points + own.tobytes())
        return result

    @staticmethod
    def parse(payload: bytes) -> tuple[int, np.ndarray, list, np.ndarray]:
        n, marks, n_words = struct.unpack_from("<QII", payload)
        at = 16
        state = np.frombuffer(payload, "<u8", LANES, at)
        at += 8 * LANES
        points = []
        for _ in range(marks):
            t, off = struct.unpack_from("<IQ", payload, at)
            points.append((t, off, np.frombuffer(payload, "<u8", LANES, at + 12)))
            at += 12 + 8 * LANES
        return n, state, points, np.frombuffer(payload, "<u4", n_words, at)

    def decode(self, payloads: list[bytes], first_rows: list[int] | None = None) -> list[np.ndarray]:
        """Ids of each block; with ``first_rows`` from that row of lanes on,
        which must be 0 or a checkpoint."""
        b = len(payloads)
        parsed = [self.parse(p) for p in payloads]
        first_rows = first_rows or [0] * b
        state, pos, lens = np.zeros((b, LANES), dtype=np.uint64), np.zeros(b, dtype=np.int64), np.zeros(b, dtype=np.int64)
        base = np.concatenate(([0], np.cumsum([len(p[3]) for p in parsed])))[:b].astype(np.int64)
        stream = np.concatenate([p[3] for p in parsed] + [np.zeros(1, "<u4")]).astype(np.uint64)
        for k, ((n, st, points, _), t0) in enumerate(zip(parsed, first_rows)):
            state[k], lens[k] = st, n - t0 * LANES
            for t, off, at in points:
                if t == t0 and t0:
                    state[k], pos[k] = at, off
        rows = int(-(-lens.max() // LANES)) if b else 0
        out = np.zeros((b, rows * LANES), dtype=np.uint32)
        lane = np.arange(LANES)
        for t in range(rows):
            on = t * LANES + lane < lens[:, None]
            slot = state & self.mask
            sym = self.slots[slot.astype(np.int64)]
            out[:, t * LANES:(t + 1) * LANES] = self.symbols[sym]
            nxt = self.freq[sym] * (state >> self.bits) + slot - self.start[sym]
            need = on & (nxt < LOW)
            rank = np.cumsum(need, axis=1) - 1 + (base + pos)[:, None]
            more = stream[np.where(need, rank, 0)]
            state = np.where(on, np.where(need, (nxt << np.uint64(32)) | more, nxt), state)
            pos += need.sum(axis=1)
        return [out[k, :lens[k]] for k in range(b)]


def shares(symbols: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to a sum of 2^bits, at least 1 each: largest counts take
    up what rounding leaves."""
    total = 1 << bits
    if len(symbols) > total:
        raise ValueError("more ids than the table has shares")
    f = np.maximum(1, (counts.astype(float) / counts.sum() * total).astype(np.int64))
    order = np.lexsort((symbols, -counts))
    gap, i = total - int(f.sum()), 0
    while gap:
        k = order[i % len(order)]
        step = gap if gap > 0 else -min(-gap, int(f[k]) - 1, max(1, int(f[k]) // 2))
        f[k] += step
        gap -= step
        i += 1
    return f


def write_store(docs: DataFrame, folder: str | None = None, path: str | None = None, id_col: str = "doc_id",
                text_col: str = "text", bucket_rows: int = BUCKET_ROWS, end: int | None = END) -> str:
    """Encode ``docs`` into ``folder`` (default: a new one under the shared
    checkpoint folder) and return it."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = source.count()
    n_buckets = max(1, -(-n // bucket_rows))
    cuts = sorted(set(source.approxQuantile("id", [i / n_buckets for i in range(1, n_buckets)],
                                            0.2 / n_buckets))) if n_buckets > 1 else []
    # cut points grow with the table (8 bytes per bucket_rows rows): searched, not listed, in the plan
    bounds = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def deal(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="right"))

    small_batches(spark)
    path = path or tokenizer_path(MODEL)
    width, n_parts = id_type(path), len(bounds) + 1
    tokens = source.select("id", deal(F.coalesce("id", F.lit(-(1 << 63)))).alias("bucket"),
                           tokenise_udf(path, end)("text").alias("ids"))
    tokens = tokens.repartitionById(n_parts, F.col("bucket")).sortWithinPartitions("bucket", "id", "ids")
    tokens = keep(tokens, "tokens")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, dtype=np.int64)
        for part in parts:
            c = np.bincount(np.frombuffer(b"".join(part["ids"]), width), minlength=len(total))
            c[:len(total)] += total
            total = c
        at = np.flatnonzero(total)
        yield pd.DataFrame({"symbol": at, "n": total[at]})

    table = (tokens.select("ids").mapInPandas(count, "symbol long, n long").groupBy("symbol")
             .agg(F.sum("n").alias("n")).orderBy("symbol").toPandas())  # at most the vocabulary
    symbols = table["symbol"].to_numpy(dtype=np.int64)
    share = shares(symbols, table["n"].to_numpy(dtype=np.int64)) if len(table) else np.zeros(0, np.int64)
    spark.createDataFrame(pd.DataFrame({"symbol": symbols, "share": share}),
                          "symbol long, share long").coalesce(1).write.parquet(f"{folder}/table")

    def pack(part_iter: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = RansCoder(symbols, share) if len(symbols) else None
        state = {"bucket": None, "seq": 0, "at": 0}
        ready, ids, lens, arrays, size = [], [], [], [], 0

        def close():
            nonlocal ids, lens, arrays, size
            if lens:
                ready.append((state["bucket"], state["seq"], state["at"], size, ids, lens,
                              np.concatenate(arrays)))
                state["seq"] += 1
                state["at"] += size
            ids, lens, arrays, size = [], [], [], 0

        def flush():
            if not ready:
                return None
            payloads = coder.encode([r[6] for r in ready]) if coder else [b""] * len(ready)
            out = [(*r[:4], r[4], r[5],
                    zlib.crc32(r[6].astype("<u4").tobytes()), p) for r, p in zip(ready, payloads)]
            ready.clear()
            return pd.DataFrame(out, columns=["bucket", "seq", "start", "n", "ids", "lengths", "crc", "payload"])

        for part in part_iter:
            for i, b, raw in zip(part["id"], part["bucket"], part["ids"]):
                if b != state["bucket"]:
                    close()
                    state.update(bucket=int(b), seq=0, at=0)
                x = np.frombuffer(raw, width)
                if lens and size + len(x) > BLOCK_IDS:
                    close()
                ids.append(i)
                lens.append(len(x))
                arrays.append(x)
                size += len(x)
                if len(ready) >= _GROUP:
                    yield flush()
        close()
        if ready:
            yield flush()

    # ids travel as text: pandas would turn integers next to a null into floats
    tokens.select(F.col("id").cast("string"), "bucket", "ids").mapInPandas(
        pack, "bucket int, seq int, start long, n long, ids array<string>, lengths array<long>, crc long, payload binary"
    ).write.parquet(f"{folder}/blocks")
    return folder


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids) of every document in a store, decoded from
    its blocks; a block whose checksum does not fit raises an error."""
    table = spark.read.parquet(f"{folder}/table").orderBy("symbol").toPandas()
    symbols, share = table["symbol"].to_numpy(dtype=np.int64), table["share"].to_numpy(dtype=np.int64)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # ids of all earlier buckets: one small row per bucket
    sums = blocks.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = sums.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = RansCoder(symbols, share) if len(symbols) else None
        for part in parts:
            for g in range(0, len(part), _GROUP):
                p = part.iloc[g:g + _GROUP]
                out = []
                decoded = coder.decode(list(p["payload"])) if coder else [np.zeros(0, np.uint32)] * len(p)
                for b, start, ids, lens, crc, x in zip(p["bucket"], p["start"], p["ids"], p["lengths"], p["crc"], decoded):
                    raw = x.astype("<u4").tobytes()
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"block at {start} of bucket {b} is damaged")
                    at = 0
                    for i, n in zip(ids, lens):
                        out.append((i, b, start + at, n, raw[4 * at:4 * (at + n)]))
                        at += n
                yield pd.DataFrame(out, columns=["id", "bucket", "at", "n_tokens", "ids"])

    small_batches(spark)
    rows = blocks.mapInPandas(unpack, "id string, bucket int, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "bucket").select(
        F.col("id").cast("long").alias("id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")

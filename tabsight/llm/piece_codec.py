"""SentencePiece encoding and decoding over a table of distinct chunks.

The text is cut before every run of white-space markers.  No piece of the
vocabulary has a marker after another character, so no merge crosses such a
cut: each distinct chunk is segmented once and the ids are joined back by
position.  The table of chunks lives in the task that reads the texts, so
nothing is shuffled; it is emptied when it holds ``MAX_CHUNKS`` entries, which
bounds its memory and changes no result.

Cases: a null text counts as empty; an empty text has the begin and end ids
only and decodes to an empty text; repeated rows are coded each on its own;
other columns of the input stay as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import small_batches, tokenizer_path

MODEL = "piece_bpe_32k.model"
MAX_CHUNKS = 150_000
MARKER = "▁"


class ChunkCodec:
    """Encoder and decoder of one SentencePiece model."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        #: Only then may the text be cut at markers.
        self.cuts = not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.max_chunks = max_chunks
        self.lone = array("I", [self.sp.piece_to_id(MARKER)]).tobytes()
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.table: dict[str, bytes] = {}  # ids as unsigned 32-bit integers

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Words of the text; a chunk's leading spaces are the markers it has
        beyond its first."""
        words = text.split(" ")
        if "" not in words:
            return words
        out, run = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * run + w)
                run = 0
            else:
                run += 1
        out.append(" " * run + words[-1])
        return out

    def learn(self, words: set[str]) -> None:
        """Segment the chunks that the table lacks."""
        new = [w for w in words if w not in self.table]
        if len(self.table) + len(new) > self.max_chunks:
            self.table.clear()
            new = list(words)
        for w, ids in zip(new, self.sp.encode(new, num_threads=1) if new else []):
            self.table[w] = array("I", ids).tobytes()
        if "" in words:  # one marker with no word behind it
            self.table[""] = self.lone

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as unsigned 32-bit integers."""
        first, last = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        if not self.cuts:
            return [first + array("I", ids).tobytes() + last for ids in self.sp.encode(texts, num_threads=1)]
        cut = [self.chunks(t.replace(MARKER, " ")) if t else [] for t in texts]
        self.learn({w for words in cut for w in words})
        get = self.table.__getitem__
        return [b"".join((first, *map(get, words), last)) for words in cut]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(array("I", ids).tolist())


def codec_udf(path: str):
    """Column function text -> struct(ids, n_tokens, decoded); ``ids`` are
    little-endian unsigned 32-bit integers."""
    @F.pandas_udf("ids binary, n_tokens long, decoded string")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = ChunkCodec(path)
        for part in parts:
            texts = part.fillna("").tolist()
            out = []
            for i in range(0, len(texts), 100):
                for ids in codec.encode(texts[i:i + 100]):
                    out.append((ids, len(ids) // 4, codec.decode(ids)))
            yield pd.DataFrame(out, columns=["ids", "n_tokens", "decoded"])
    return code


def decode_udf(path: str):
    """Column function ids (as ``codec_udf`` gives them) -> text."""
    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = ChunkCodec(path)
        for part in parts:
            yield pd.Series([None if b is None else codec.decode(b) for b in part], dtype=object)
    return decode


def encode_documents(docs: DataFrame, path: str | None = None, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a struct column ``out`` of ids, n_tokens and decoded."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, codec_udf(path or tokenizer_path(MODEL))(F.col(text_col)))

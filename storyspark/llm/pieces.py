"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model crosses from a visible character into a whitespace marker, so every marked word
(a run of markers and what follows up to the next marker) is segmented alone: the merges of a byte-pair
model never look past it. Each task holds a table of the distinct marked words it has met, segments each
of them once, and joins their ids back by position. The table is emptied whenever it reaches its size
limit, which costs a second segmentation and changes no result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_CHUNKS = 1 << 18


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Ids of distinct marked words; encodes whole texts exactly as the library would."""

    def __init__(self, model: str, limit: int = TABLE_CHUNKS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(MARK in self.processor.id_to_piece(i).lstrip(MARK) for i in range(self.processor.get_piece_size())):
            raise ValueError("a piece of this model crosses a whitespace marker, so words can't be segmented alone")
        self.limit = limit
        self.ids: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids without begin and end; empty for the empty text."""
        if not text:
            return []
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        known = self.ids
        new = {c for c in chunks if c not in known}
        if new:
            if len(known) > self.limit:
                known.clear()
                new = set(chunks)
            new = list(new)
            # the library adds the first marker itself
            for c, ids in zip(new, self.processor.encode([c[1:] for c in new], num_threads=1), strict=True):
                known[c] = tuple(ids) if len(c) > 1 else self._lone
        return list(chain.from_iterable(map(known.__getitem__, chunks)))

    @property
    def _lone(self) -> tuple[int, ...]:
        """The marker alone: the library gives no ids for an empty text, so its id is looked up."""
        return (self.processor.piece_to_id(MARK),)


def encode_decode(docs: DataFrame, finish: Callable[[list[int], str], tuple], schema: str, model: str | None = None) -> DataFrame:
    """For every row doc_id and what finish(ids, decoded text) makes of the whole text, in columns of schema.

    ids hold begin and end; the text is the library's decode(ids). Null text counts as empty (begin and
    end only, decoded to the empty text). Rows may repeat and a null doc_id stays null; an empty table gives no rows;
    other columns are ignored. A text is one value, read whole however long."""
    model = model or public_model()

    def run(batches):
        words = ChunkTable(model)
        begin, end = words.processor.bos_id(), words.processor.eos_id()
        for b in batches:
            made = []
            for text in b.column(1):
                ids = [begin, *words.encode(text.as_py() or ""), end]
                made.append(finish(ids, words.processor.decode(ids)))
            columns = zip(*made, strict=True) if made else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, kinds = arrow.names, arrow.types
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {schema}")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int, begin and end included) and text (decoded) of every row."""
    return encode_decode(docs, lambda ids, text: (ids, text), "ids array<int>, text string", model)


def _digests(ids: list[int], text: str) -> tuple:
    return (
        len(ids),
        hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(
        table(spark, sf_dir, "documents"), _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

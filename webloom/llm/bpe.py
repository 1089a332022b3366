"""Byte-level BPE: texts to token ids by a public rank file, and ids back to the bytes of the text.

Method: the `tokenizers` library over Arrow batches. Each byte stands for one printable character, so that the
library's merges work on bytes; its offsets in such characters are offsets in bytes. Pieces of the split pattern are
encoded one by one, each distinct piece of a batch once. Decoding reverses the byte table: it joins bytes first, since
a token may hold part of a character only.

Defined results: a null text counts as empty and has no tokens. Rows keep their number and order within a partition;
repeated rows and repeated or null ids are encoded row by row. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import freed, rows_of

# Bytes of chunks and ids that a task remembers (about a fifth of what the table takes); beyond that it starts anew. A
# bound on memory, without effect on results.
REMEMBERED_BYTES = 8_000_000

_WHITE_THEN_SPACE = regex.compile(r"\s |^ | $").search
_RUNS = regex.compile(r"\s*\S+|\s+").findall


def byte_table() -> list[str]:
    """The character for each byte: itself if Latin-1 prints it, else the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        characters = byte_table()
        self._shown = {b: c for b, c in enumerate(characters)}
        self._ranks = ranks
        self._split = regex.compile(pattern).findall
        self._bytes = {rank: token for token, rank in ranks.items()}
        self.lengths = np.zeros(max(self._bytes, default=0) + 1, np.int64)
        for rank, token in self._bytes.items():
            self.lengths[rank] = len(token)
        self._known: dict[str, bytes] = {}
        self._held = 0

    @functools.cached_property
    def _tokenizer(self):
        """Built where texts are encoded only; decoding needs no merges."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = self._ranks
        vocab = {self._as_characters(token): rank for token, rank in ranks.items()}
        # Any two neighbours whose union is a token may merge, the lowest rank first; of splits of one token the one
        # with the longer left part comes first, since merging goes from left to right.
        merges = [
            (self._as_characters(token[:i]), self._as_characters(token[i:]))
            for token in sorted(ranks, key=ranks.get)
            for i in range(len(token) - 1, 0, -1)
            if token[:i] in ranks and token[i:] in ranks
        ]
        return Tokenizer(BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))

    def forget(self) -> None:
        """Drop what was remembered of the texts."""
        self._known.clear()
        self._held = 0

    def _as_characters(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self._shown)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        chunks = [self._chunks(text) for text in texts]
        fresh = [chunk for chunk in set().union(*chunks) if chunk not in self._known]
        if self._held > REMEMBERED_BYTES:
            self.forget()
            fresh = list(set().union(*chunks))
        split = [self._split(chunk) for chunk in fresh]
        pieces = [piece for piece in set().union(*split) if piece not in self._known]
        shown = [self._as_characters(piece.encode()) for piece in pieces]
        found = self._tokenizer.encode_batch_fast(shown, add_special_tokens=False)
        known = self._known
        known.update((piece, array("I", own.ids).tobytes()) for piece, own in zip(pieces, found, strict=True))
        known.update((chunk, b"".join(map(known.__getitem__, own))) for chunk, own in zip(fresh, split, strict=True))
        self._held += sum(map(len, pieces)) + sum(map(len, fresh)) + sum(len(known[chunk]) for chunk in fresh)
        return [b"".join(map(known.__getitem__, own)) for own in chunks]

    def _chunks(self, text: str) -> list[str]:
        """The text cut where white space follows something else: there a piece of the pattern always ends."""
        if _WHITE_THEN_SPACE(text):
            return _RUNS(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + word for word in rest]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, ids: bytes, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each token the character (code point) that it starts in, and whether it starts within that character."""
        at = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        at = np.concatenate([np.zeros(1, np.int64), at])[:-1]
        leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        return (np.cumsum(leads) - 1)[at], ~leads[at]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens, n_split (tokens that start within a character)
    and, if asked for, offsets: the code point at which each token starts.

    The rank file is a parameter; every worker reads it from that path once.
    """
    schema = "doc_id bigint, ids binary, n_tokens bigint, n_split bigint" + ", offsets array<bigint>" * offsets
    return _texts(docs).mapInArrow(lambda rows: _encoded(rows, codec(path, pattern), offsets), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encode` with `decoded`, the bytes that the ids stand for. Null ids decode to nothing."""
    return encoded.select("doc_id", "ids", "n_tokens", "n_split").mapInArrow(lambda rows: _decoded(rows, codec(path, pattern)), _DECODED)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encode`, then `decode`, batch by batch in one Python worker.

    Apart they run side by side in two workers per core, and Spark keeps both, each with its tables, for all later tasks.
    """

    def batches(rows):
        coder = codec(path, pattern)
        return _decoded(_encoded(rows, coder), coder)

    return _texts(docs).mapInArrow(batches, _DECODED)


_DECODED = "doc_id bigint, ids binary, n_tokens bigint, n_split bigint, decoded binary"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))


def _encoded(rows: Iterable[pa.RecordBatch], coder: Codec, offsets: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(rows):
        texts = batch.column("text").to_pylist()
        found = coder.encode(texts)
        places = [coder.starts(ids, text.encode()) for ids, text in zip(found, texts, strict=True)]
        columns = [batch.column("doc_id"), pa.array(found, pa.binary())]
        columns += [pa.array([len(ids) // 4 for ids in found], pa.int64())]
        columns += [pa.array([int(split.sum()) for _, split in places], pa.int64())]
        names = ["doc_id", "ids", "n_tokens", "n_split"]
        if offsets:
            columns, names = [*columns, pa.array([at.tolist() for at, _ in places], pa.list_(pa.int64()))], [*names, "offsets"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    coder.forget()
    freed()


def _decoded(rows: Iterable[pa.RecordBatch], coder: Codec) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(rows):
        data = pa.array([coder.decode(ids or b"") for ids in batch.column("ids").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, data], names=[*batch.schema.names, "decoded"])
    freed()


def multi_50k() -> tuple[str, str]:
    """Rank file and split pattern of the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    path, pattern = multi_50k()
    rows = round_trip(docs, path, pattern)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op10_bpe(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

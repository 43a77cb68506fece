"""Encoding of texts with a public byte-level tokenizer by forced boundaries."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; every operator takes another place as a parameter.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How byte-level BPE divides a text before merging (fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Different fragments whose ids a task remembers.
REMEMBERED = 200_000


class Encoder:
    """Cuts texts where no token can reach across, and encodes the fragments one by one."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        ranks = {}
        for line in Path(vocabulary).read_bytes().splitlines():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            self.inside[(b[:-1] << 8) | b[1:]] = True
        self.known: dict[bytes, list[int]] = {}

    def cuts(self, data: bytes) -> np.ndarray:
        """Places in UTF-8 ``data`` that every encoding has as a token boundary, whatever lies around.

        No token holds the two bytes there in a row. Left out are places that the division
        before merging could tell apart: within a character, after white space (whose runs
        look ahead) and before an apostrophe (which may begin a contraction).
        """
        if len(data) < 2:
            return np.empty(0, dtype=np.int64)
        b = np.frombuffer(data, dtype=np.uint8)
        left, right = b[:-1], b[1:]
        certain = ~self.inside[(left.astype(np.int32) << 8) | right] & ((right & 0xC0) != 0x80) & (right != 0x27)
        at = np.flatnonzero(certain) + 1
        if len(at):
            one = b[at - 1]
            space = (one == 0x20) | ((one >= 0x09) & (one <= 0x0D)) | ((one >= 0x1C) & (one <= 0x1F))
            two = (b[np.maximum(at - 2, 0)] == 0xC2) & ((one == 0x85) | (one == 0xA0))
            lead = b[np.maximum(at - 3, 0)]
            wide = (lead == 0xE1) | (lead == 0xE2) | ((lead == 0xE3) & (b[np.maximum(at - 2, 0)] == 0x80))
            at = at[~(space | two | (wide & (one >= 0x80)))]
        return at

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        data = text.encode("utf-8", "replace")
        out: list[int] = []
        start = 0
        known = self.known
        for end in (*self.cuts(data).tolist(), len(data)):
            fragment = data[start:end]
            start = end
            ids = known.get(fragment)
            if ids is None:
                ids = self.plain.encode_ordinary(fragment.decode("utf-8"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(fragment) <= 64:
                    known[fragment] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode(df: DataFrame, key: str, text: str, *, vocabulary: str = f"{VOCABULARIES}/{VOCABULARY}", parts: int | None = None) -> DataFrame:
    """``(key, ids)``: the token ids of every text, without special tokens.

    Null and empty texts have an empty list; a blank text has the ids of its blanks; names of
    special tokens within a text are ordinary text; lone surrogates count as ``?``. There is a
    row for each row of ``df``, also for repeated or null keys.

    Texts are cut at certain boundaries: pairs of bytes that occur inside no token of the
    vocabulary. Fragments are encoded each by itself, equal ones once, and their ids
    concatenated, all in the task that has the text, so nothing but the texts is moved.
    ``parts``: spread the rows evenly over so many tasks first (default: as they are read).
    """
    from pyspark.sql import functions as F

    slim = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if parts:
        slim = slim.repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for start in range(0, batch.num_rows, 512):
                ids = [own.ids(t.as_py()) for t in texts.slice(start, 512)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 512), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)

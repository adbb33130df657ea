"""Token counts by batch encoding in Arrow functions that return lengths only.

A task takes its Arrow batches in slices of equal bytes, cuts texts longer than
a slice at safe boundaries, and encodes each distinct unit (``units.py``). No
ids leave the Python worker, nothing is shuffled and no memory grows with a
partition.

Edge cases: a null or empty text has 0 bytes and 0 tokens; rows are kept as they
are (repeated ids, null ids), an empty table gives an empty result; only the id
and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import SLICE_BYTES, byte_slices, bytes_of, segment_sums
from tsfold.llm.units import UnitCodes, cuts_before_space, encode_with, split_long

SCHEMA = "id long, n_bytes long, n_tokens long"


def load_codes(path: str, dtype=np.uint32) -> UnitCodes:
    """The unit encoder of a byte-level ``tokenizers`` file, special strings handled as its default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return UnitCodes(cuts_before_space, encode_with(tokenizer, "<|endoftext|>", special), dtype=dtype)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = load_codes(path)
        for batch in batches:
            for part in byte_slices(batch, "text", slice_bytes):
                texts = bytes_of(part, "text")
                pieces = [split_long(x, slice_bytes, cuts_before_space) if len(x) > slice_bytes else [x] for x in texts]
                flat = [p for ps in pieces for p in ps]
                each = np.zeros(len(flat), np.int64)
                at = 0
                while at < len(flat):  # pieces of a long text go one by one
                    stop, held = at, 0
                    while stop < len(flat) and (stop == at or held + len(flat[stop]) <= slice_bytes):
                        held += len(flat[stop])
                        stop += 1
                    each[at:stop] = codes.counts(flat[at:stop])
                    at = stop
                n = segment_sums(each, np.fromiter(map(len, pieces), np.int64, len(pieces)))
                yield pa.record_batch([part.column("id"), pa.array([len(x) for x in texts], pa.int64()),
                                       pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)

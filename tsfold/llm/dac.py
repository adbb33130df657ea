"""Token ids in directly addressable codes.

Ids are cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the
first chunk of every id; a bitmap of the level tells which ids go on, and the
chunks of those follow one another on the next level. To find an id's place on
the next level one counts the set bits before it: a rank directory holds that
count for every ``RANK_STEP`` bits. So the token at any place is read from a few
bytes of each level; no block is decoded.

The file format is a folder of Parquet files (any store Spark can write to); a
row is a segment of about ``SEGMENT_IDS`` ids with its levels as binary columns,
its documents' ids and lengths, and its place: ``part`` and ``offset`` within
the part. Parts are ranges of document ids in ascending order, so the place of
a document in the whole stream is its part's base (one sum per part) plus the
offset. Spark's commit protocol makes the write safe when executors are lost.

Edge cases: null and empty texts give the end id alone; rows with a null id come
first, repeated ids keep all their rows (in the order of their texts); an empty
table gives an empty folder with a schema.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of
from tsfold.llm.token_count import load_codes

CHUNK_BITS = 8
RANK_STEP = 512
SEGMENT_IDS = 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_LEVEL = pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = ("part long, segment long, offset long, n_ids long, ids array<long>, sizes array<long>, "
           "levels array<struct<codes:binary,more:binary,ranks:binary>>")


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of a sequence of unsigned ids of up to 32 bits."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest >> CHUNK_BITS != 0
        bits = np.packbits(more, bitorder="little")
        step = RANK_STEP // 8
        ones = np.add.reduceat(_POP[bits].astype(np.uint32), np.arange(0, len(bits), step)) if len(bits) else np.zeros(0, np.uint32)
        levels.append({"codes": (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), "more": bits.tobytes(),
                       "ranks": (np.cumsum(ones) - ones).astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


class Reader:
    """Random access to the ids of a segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["more"], np.uint8),
                        np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places, in any order."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        who = np.arange(len(at))
        for k, (codes, more, ranks) in enumerate(self.levels):
            out[who] |= codes[at].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            on = (more[at >> 3] >> (at & 7)) & 1 == 1
            at, who = at[on], who[on]
            if not len(at):
                break
            at = self._rank(more, ranks, at)
        return out

    @staticmethod
    def _rank(more: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of set bits before each place: the directory's count plus the bytes since then."""
        block = at // RANK_STEP
        out = ranks[block].astype(np.int64)
        byte = at >> 3
        first = block * (RANK_STEP // 8)
        for j in range(RANK_STEP // 8):
            here = first + j < byte
            if not here.any():
                break
            out[here] += _POP[more[(first + j)[here]]]
        return out + _POP[more[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]

    def range(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range: one directory look-up for each level, then neighbouring chunks."""
        out = np.zeros(max(0, stop - start), np.uint32)
        who = None
        for k, (codes, more, ranks) in enumerate(self.levels):
            if stop <= start:
                break
            part = codes[start:stop].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            if who is None:
                out |= part
            else:
                out[who] |= part
            low = start & ~7
            on = np.flatnonzero(np.unpackbits(more[low >> 3:(stop + 7) >> 3], bitorder="little")[start - low:stop - low])
            who = on if who is None else who[on]
            if not len(on):
                break
            start = int(self._rank(more, ranks, np.array([start]))[0])
            stop = start + len(on)
        return out


def write_token_ids(df: DataFrame, tokenizer_path: str, path: str, end_id: int, id_col: str = "doc_id",
                    text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode all texts in ascending order of ids and write the segments to ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = load_codes(tokenizer_path)
        part, segment, offset = TaskContext.get().partitionId(), 0, 0
        ids, sizes, flat, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            values = [[part], [segment], [offset], [held], [ids], [sizes], [encode(np.concatenate(flat))]]
            types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2 + [pa.list_(_LEVEL)]
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types)],
                                   names=["part", "segment", "offset", "n_ids", "ids", "sizes", "levels"])

        for batch in batches:
            for some in byte_slices(batch, "text"):
                values, n = codes.ids(bytes_of(some, "text"))
                stops = np.cumsum(n)
                flat.append(np.insert(values, stops, end_id))
                sizes.extend((n + 1).tolist())
                ids.extend(some.column("id").to_pylist())
                held += len(flat[-1])
                if held >= segment_ids:
                    yield done()
                    segment, offset = segment + 1, offset + held
                    ids, sizes, flat, held = [], [], [], 0
        if ids:
            yield done()

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the hash lets the texts of a repeated or null id go to more than one task
    ordered = narrow.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").drop("h")
    ordered.mapInArrow(run, SEGMENT).write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Single token ids from the files: for each row (doc_id, place) of ``wanted`` the id at that place of the document, found
    by the codes' rank directories without decoding the segment; doc_id, place, token. Places outside the document and unknown
    documents give no row; of a repeated document id each document answers."""
    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                sizes = np.array(x["sizes"], np.int64)
                n = len(sizes)
                yield pa.record_batch([pa.array([x["part"]] * n, pa.int64()), pa.array([x["segment"]] * n, pa.int64()), pa.array(x["ids"], pa.int64()),
                                       pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)], names=["part", "segment", "doc_id", "first", "n"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                tokens = Reader(x["levels"]).at(np.array([a["at"] for a in x["asked"]], np.int64))
                yield pa.record_batch([pa.array([a["doc_id"] for a in x["asked"]], pa.int64()), pa.array([a["place"] for a in x["asked"]], pa.int64()),
                                       pa.array(tokens.astype(np.int64))], names=["doc_id", "place", "token"])

    segments = spark.read.schema(SEGMENT).parquet(path)
    known = segments.select("part", "segment", "ids", "sizes").mapInArrow(directory, "part long, segment long, doc_id long, first long, n long")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place")).distinct().join(known, "doc_id")
    asked = asked.filter("place >= 0 AND place < n").groupBy("part", "segment").agg(
        F.collect_list(F.struct("doc_id", "place", (F.col("first") + F.col("place")).alias("at"))).alias("asked"))
    return segments.select("part", "segment", "levels").join(asked, ["part", "segment"]).mapInArrow(fetch, "doc_id long, place long, token long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                reader, sizes = Reader(x["levels"]), np.array(x["sizes"], np.int64)
                stops = np.cumsum(sizes)
                raw = memoryview(reader.range(0, int(sizes.sum())).astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip((stops - sizes).tolist(), stops.tolist())]
                yield pa.record_batch([pa.array([x["part"]] * len(sizes), pa.int64()), pa.array(x["ids"], pa.int64()),
                                       pa.array(x["offset"] + stops - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                                       pa.array(crc, pa.int64())], names=["part", "doc_id", "offset", "n_tokens", "ids_crc32"])

    segments = spark.read.schema(SEGMENT).parquet(path)
    # one row for each writing task: bounded by the number of partitions of the write
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = segments.mapInArrow(run, "part long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")

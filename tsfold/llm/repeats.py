"""Removal of long passages that repeat across documents, by recompression.

A text is a row of word names. A round of recompression first names maximal runs
of one symbol, then, with the symbols dealt by their names to a left and a right
side, every pair of a left symbol and the right one behind it. A name is a
64-bit fingerprint of what it stands for, hence the same in every document and
task without a table of names. Whether neighbours are joined depends on these
two alone, so equal passages are named alike but for the symbols at their two
ends: in a round a passage sheds its first and last run and at most one symbol
more at either end, and what lies between (its interior) has the same symbols
wherever it occurs. The symbols shed, round by round, with what is left at last
determine the passage; their fingerprint is the passage's name.

A window is ``window`` words in a row. On Spark:

1. *Reveal.* Every text is recompressed; a window is represented by one symbol of
   its last interior that still has ``FEW`` symbols. Windows near each other mostly
   share it, so there is one for about ten words. Spark counts, by symbol, in which different
   texts it occurs (partial minima and maxima before the shuffle: a symbol that a
   third of all texts holds is no hot key). A window whose symbol occurs in one
   text only is not repeated.
2. *Verify.* Texts with shared symbols are recompressed again and the windows that
   have one are named. By name (and 32 bits of the symbol: 96 in all), Spark finds the smallest
   document; larger ones learn at which words their repeated windows start (a join
   whose hot keys adaptive execution splits).
3. Words under such windows go.

Texts that have the same words form a class; only its smallest document takes part in 1
and 2, all others are repeats of it as a whole. Which texts are needed in 2 and
3 is first looked up in a bit set of at most ``MAX_BITS`` (a bound for any input; a
bit that is set without need only lets a text through to the exact join), so most
texts are never shuffled. Windows of different content are confused if their 96-bit names agree.

Edge cases: null and empty texts have no words; a row with a null id is neither
a source nor repeated; rows that repeat an id are not repeats of each other and
each is judged by its own text; a text below ``window`` words is left as it is;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of, mix, ranges, segment_sums
from tsfold.llm.units import _M, _M_INV, Texts, _powers
from tsfold.session import scratch_path

WINDOW = 50
#: Symbols that an interior should have for a window to be represented by one of them.
FEW = 4
#: Words from which on a symbol is preferred: symbols of many words seldom stand in texts that share no passage.
LONG = (4, 6, 9)
MAX_BITS = 1 << 26
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RUN, _LEFT, _RIGHT, _FIRST, _LAST = (np.uint64(x) for x in (
    0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


class Words:
    """Words of some texts: bounds in the joined bytes, fingerprint, and the text of each."""

    def __init__(self, texts: list[bytes]):
        t = Texts(texts)
        n = len(t.buf)
        self.buf, self.count = t.buf, len(texts)
        word = ~_SPACE[t.buf]
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        firsts, lasts = t.starts[t.lens > 0], t.ends[t.lens > 0] - 1
        begin[firsts] = word[firsts]
        end[lasts] = word[lasts]
        self.at, self.stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=sums[1:])
        self.name = mix((sums[self.stop] - sums[self.at]) * _powers(_M_INV, n)[self.at] + (self.stop - self.at).astype(np.uint64))
        for i in np.flatnonzero(self.stop - self.at > 256).tolist():  # the polynomial is made for short words
            self.name[i] = int.from_bytes(hashlib.blake2b(t.buf[self.at[i]:self.stop[i]].tobytes(), digest_size=8).digest(), "little")
        self.text = np.searchsorted(t.ends, self.at, side="right")
        self.first = np.searchsorted(self.at, t.starts)  # of each text
        self.last = np.searchsorted(self.at, t.ends)

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The kept words of each text with a space between."""
        at, stop, text = self.at[kept], self.stop[kept], self.text[kept]
        lens = stop - at + 1
        out = np.full(int(lens.sum()), 32, np.uint8)
        place = np.cumsum(lens) - lens
        out[ranges(place, lens - 1)] = self.buf[ranges(at, lens - 1)]
        raw = out.tobytes()
        per = np.bincount(text, weights=lens, minlength=self.count).astype(np.int64)
        ends = np.cumsum(per)
        return [raw[a:max(a, b - 1)] for a, b in zip((ends - per).tolist(), ends.tolist())]


class Windows:
    """The windows of the words: where they start, the symbol that represents each, and (``named``) their names."""

    def __init__(self, words: Words, window: int = WINDOW, named: bool = False):
        n = max(0, len(words.name) - window + 1)
        self.start = np.flatnonzero(words.text[:n] == words.text[window - 1:]) if n else np.zeros(0, np.int64)
        self.symbol = np.zeros(len(self.start), np.uint64)
        self.name = np.zeros(len(self.start), np.uint64)
        sym, text = words.name, words.text
        size = np.ones(len(sym), np.int64)  # words under each symbol
        lo, hi = self.start, self.start + window  # the interior, in symbols of the round
        who = np.arange(len(self.start))  # windows whose interior is not empty
        left, right = np.zeros(len(who), np.uint64), np.zeros(len(who), np.uint64)
        turn = 0
        while len(who):
            if not turn:
                self.symbol[:] = sym[lo]
            self._represent(who, sym, size, lo, hi)
            # runs: the first and the last go (they may go on outside), the others get a name
            new = np.append(True, (sym[1:] != sym[:-1]) | (text[1:] != text[:-1]))
            run = np.cumsum(new) - 1
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(sym))
            a, b = run[lo], run[hi - 1]
            if named:
                inner = np.minimum(ends[a], hi)
                left = mix(left * _FIRST + sym[lo] + mix((inner - lo).astype(np.uint64)))
                tail = hi - np.maximum(at[b], inner)
                right = np.where(tail > 0, mix(right * _LAST + sym[hi - 1] + mix(np.maximum(tail, 0).astype(np.uint64))), right)
            lo, hi = a + 1, b
            times = (ends - at).astype(np.uint64)
            sym = np.where(times > 1, mix(sym[at] * _RUN + times), sym[at])
            text, size = text[at], segment_sums(size, ends - at)
            # pairs: a symbol that might be joined with one outside goes
            is_right = mix(sym + mix(np.array([turn + 1], np.uint64))) >> np.uint64(63) != 0
            some = lo < hi
            first, last = np.minimum(lo, len(sym) - 1), np.maximum(hi - 1, 0)
            shed = some & is_right[first]
            if named:
                left = np.where(shed, mix(left * _FIRST + sym[first]), left)
            lo = lo + shed
            shed = (lo < hi) & ~is_right[last]
            if named:
                right = np.where(shed, mix(right * _LAST + sym[last]), right)
            hi = hi - shed
            pair = np.append(~is_right[:-1] & is_right[1:] & (text[1:] == text[:-1]), False) if len(sym) else np.zeros(0, bool)
            second = np.append(False, pair[:-1])
            both = np.flatnonzero(pair)
            sym = sym.copy()
            sym[both] = mix(sym[both] * _LEFT + sym[both + 1] * _RIGHT)
            size[both] += size[both + 1]
            keep = ~second
            place = np.append(np.cumsum(keep) - keep, int(keep.sum()))  # kept symbols before each
            lo, hi = place[np.minimum(lo, len(keep))], place[np.minimum(hi, len(keep))]
            sym, text, size = sym[keep], text[keep], size[keep]
            turn += 1
            live = lo < hi
            if named:
                gone = who[~live]
                self.name[gone] = mix(left[~live] * _FIRST + mix(right[~live]) + np.uint64(turn))
                left, right = left[live], right[live]
            who, lo, hi = who[live], lo[live], hi[live]

    def _represent(self, who: np.ndarray, sym: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Let windows with ``FEW`` to 4 * ``FEW`` symbols in their interior be represented by the smallest name among them,
        names of many words first; windows with more by their first symbol (until a later round)."""
        m = hi - lo
        self.symbol[who[m > 4 * FEW]] = sym[lo[m > 4 * FEW]]
        short = sum((size < n).astype(np.uint64) for n in LONG)
        key = sym >> np.uint64(2) | short << np.uint64(62)
        least = key
        width = 1
        while width < 4 * FEW and width < len(key):  # least of the 2, 4, 8 ... keys from each place
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
            some = np.flatnonzero((m >= max(width, FEW)) & (m < 2 * width) & (m <= 4 * FEW))
            if width >= FEW and len(some):
                self.symbol[who[some]] = np.minimum(least[lo[some]], least[hi[some] - width])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text (tells apart the texts of a repeated id) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def facts(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Stored: id, th, n_words, cls (fingerprint of all words), sha256 of all words joined, and the distinct symbols that
    represent windows (none for a null id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                w = Words(bytes_of(part, "text"))
                win = Windows(w, window)
                text = w.text[win.start]
                new = np.append(True, (win.symbol[1:] != win.symbol[:-1]) | (text[1:] != text[:-1]))[:len(text)]
                text, symbol = text[new], win.symbol[new]
                _, one = np.unique(mix(symbol + mix(text.astype(np.uint64))), return_index=True)
                one.sort()
                text, symbol = text[one], symbol[one]
                null = np.array(part.column("id").is_null().to_numpy(zero_copy_only=False))
                stays = ~null[text]
                text, symbol = text[stays], symbol[stays]
                stops = np.cumsum(np.bincount(text, minlength=part.num_rows))
                symbols = pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(symbol.view(np.int64)))
                texts = w.joined(np.ones(len(w.at), bool))
                yield pa.record_batch([
                    part.column("id"), part.column("th"), pa.array(w.last - w.first, pa.int64()),
                    pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary()),
                    pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), symbols],
                    names=["id", "th", "n_words", "cls", "sha", "symbols"])

    return _stored(_texts(df, id_col, text_col).mapInArrow(
        run, "id long, th long, n_words long, cls binary, sha binary, symbols array<long>"), "repeats-facts")


def _bit_set(keys: DataFrame) -> np.ndarray:
    """Bits of ``xxhash64`` values (column h) as a set of at most ``MAX_BITS``; Spark puts it together, and at most
    one number for 64 bits comes to the driver."""
    size = min(MAX_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    bit = F.pmod(F.col("h"), F.lit(size))
    rows = keys.select(F.floor(bit / 64).cast("long").alias("place"), F.expr(f"shiftleft(1L, cast(pmod(h, {size}) % 64 as int))").alias("b"))
    got = rows.groupBy("place").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got.column("place").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _let_through(texts: DataFrame, bits) -> DataFrame:
    """The texts whose (id, th) may be in the broadcast bit set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in batches:
            if batch.num_rows:
                bit = np.mod(batch.column("h").to_numpy(), len(held) * 64).astype(np.uint64)
                ok = (held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
                yield batch.filter(pa.array(ok))

    rows = texts.filter("id IS NOT NULL").withColumn("h", F.xxhash64("id", "th"))
    return rows.mapInArrow(run, "id long, th long, text string, h long").drop("h")


def _named(df: DataFrame, window: int) -> DataFrame:
    """Windows of the texts (id, c, text, symbols) that are represented by one of ``symbols``: name, tag, id, c, at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                w = Words(bytes_of(part, "text"))
                win = Windows(w, window, named=True)
                column = part.column("symbols")
                shared = column.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy())
                text = w.text[win.start]
                some = np.flatnonzero(pd.Series(mix(win.symbol + mix(text.astype(np.uint64)))).isin(mix(shared + mix(owner.astype(np.uint64)))))
                rows = pa.array(text[some])
                at = (win.start - w.first[text])[some]
                yield pa.record_batch([pa.array(win.name[some].view(np.int64)), pa.array(win.symbol[some].astype(np.uint32).view(np.int32)),
                                       part.column("id").take(rows), part.column("c").take(rows), pa.array(at.astype(np.int32))],
                                      names=["name", "tag", "id", "c", "at"])

    return df.select("id", "c", "text", "symbols").mapInArrow(run, "name long, tag int, id long, c long, at int")


def _passages(df: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored facts of all rows; cls and the smallest id (own.id) of every class; and the texts of classes that hold
    repeated windows: id, cls, text and ``starts`` (words at which such windows start)."""
    spark = df.sparkSession
    known = facts(df, id_col, text_col, window)
    own = known.filter("id IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "th")).alias("own"))
    # classes by number: the rows of the next shuffles are many
    symbols = known.filter("size(symbols) > 0").select(F.explode("symbols").alias("symbol"), F.xxhash64("cls").alias("c"))
    shared = (symbols.groupBy("symbol").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("symbol"))
    held = (symbols.join(_stored(shared, "repeats-shared"), "symbol").groupBy("c").agg(F.collect_set("symbol").alias("symbols")))
    classes = own.withColumn("c", F.xxhash64("cls"))
    wanted = _stored(held.join(classes, "c").select("own.id", "own.th", "cls", "c", "symbols"), "repeats-wanted")

    bits = spark.sparkContext.broadcast(_bit_set(wanted.select(F.xxhash64("id", "th").alias("h"))))
    texts = _let_through(_texts(df, id_col, text_col), bits).join(wanted, ["id", "th"])
    if not known.filter("id IS NOT NULL").groupBy("id", "th").count().filter("count > 1").isEmpty():  # rows that repeat id and text
        texts = texts.groupBy("id", "th", "cls", "c", "symbols").agg(F.min("text").alias("text"))
    texts = _stored(texts.select("id", "c", "cls", "text", "symbols"), "repeats-texts")

    windows = _named(texts, window)
    first = windows.groupBy("name", "tag").agg(F.min("id").alias("source"), F.max("id").alias("other")).filter("source < other")
    hits = windows.join(first.select("name", "tag", "source"), ["name", "tag"]).filter("id > source")
    starts = hits.groupBy("id", "c").agg(F.collect_set("at").alias("starts"))
    return known, own, texts.select("id", "c", "cls", "text").join(starts, ["id", "c"])


def _cut(w: Words, starts: list[list[int]], window: int) -> np.ndarray:
    """Which words no window covers that starts at the given words of each text."""
    edge = np.zeros(len(w.at) + 1, np.int64)
    for k, some in enumerate(starts):
        at = w.first[k] + np.array(some, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:-1] == 0


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``df``: id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                w = Words(bytes_of(part, "text"))
                kept = _cut(w, part.column("starts").to_pylist(), window)
                left = np.bincount(w.text[kept], minlength=part.num_rows)
                yield pa.record_batch([part.column("cls"), pa.array(w.last - w.first - left, pa.int64()),
                                       pa.array([hashlib.sha256(x).digest() for x in w.joined(kept)], pa.binary())],
                                      names=["cls", "gone", "left_sha"])

    known, own, texts = _passages(df, id_col, text_col, window)
    partly = texts.select("cls", "text", "starts").mapInArrow(run, "cls binary, gone long, left_sha binary")
    classes = own.select("cls", F.col("own.id").alias("source")).join(partly, "cls", "left")
    rows = known.drop("symbols").join(classes, "cls", "left")
    copy = (F.col("id") > F.col("source")) & (F.col("n_words") >= window)
    source = F.col("id") == F.col("source")
    return rows.select(
        F.col("id").alias(id_col), "n_words",
        F.when(copy, F.col("n_words")).when(source, F.coalesce("gone", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(copy, F.unhex(F.lit(hashlib.sha256().hexdigest()))).when(source, F.coalesce("left_sha", "sha"))
                      .otherwise(F.col("sha")))).alias("kept_sha256"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df``, all columns, with the kept words (joined by a space) as the text where words were removed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                w = Words(bytes_of(part, "text"))
                kept = w.joined(_cut(w, part.column("starts").to_pylist(), window))
                yield pa.record_batch([part.column("cls"), pa.array([x.decode() for x in kept], pa.string())], names=["cls", "_kept"])

    known, own, texts = _passages(df, id_col, text_col, window)
    partly = texts.select("cls", "text", "starts").mapInArrow(run, "cls binary, _kept string")
    classes = own.select("cls", F.col("own.id").alias("source")).join(partly, "cls", "left")
    judged = known.select("id", "th", "cls", "n_words").distinct().join(classes, "cls")
    kept = F.when((F.col("id") > F.col("source")) & (F.col("n_words") >= window), F.lit("")).when(F.col("id") == F.col("source"), F.col("_kept"))
    judged = judged.select(F.col("id").alias("_id"), F.col("th").alias("_th"), kept.alias("_new")).filter("_new IS NOT NULL")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.join(judged, (F.col(id_col).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")
    return rows.withColumn(text_col, F.coalesce("_new", F.col(text_col).cast("string"))).select(df.columns)

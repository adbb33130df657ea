"""Phrases of words that stand together more often than chance (Toivonen's sampling method).

A sample of the documents proposes phrases: those whose count there, scaled to all
documents, comes near ``min_count``. A full pass then counts every phrase whose
beginning and end (all words but the last, all but the first) were proposed: these
are the proposed phrases and their negative border, the shortest phrases that the
sample did not propose. If all phrases of the border stay below ``min_count``, no
longer one can reach it and the count is closed. Otherwise the phrases found
join the proposed ones and a further pass counts what this adds, until no new one
turns up. The result does not depend on the sample; a poor sample costs passes.

On Spark: tasks hash the words of a slice of texts with numpy, form all phrases of
up to ``MAX_WORDS`` words by hash, keep those that are to be counted and count them
within the slice; Spark adds the counts up by hash (partial sums before the
shuffle, so that a frequent phrase or language is no hot key). A hash counts all
phrases that have it, so no frequent phrase is missed; a last pass counts
the phrases of frequent hashes again by their text, which makes the counts exact. What is to be
counted is known to the tasks by a bit set of hashes, about ``BITS`` bits for each
and at most ``MAX_BITS`` in all, a bound that holds for any input. A bit that two
phrases share (more of them on input beyond that bound) only makes a pass count more.

Everything is per language. Scores are exact (38-digit integers), and the ranking
takes the first rows of parts of a language before those of the language.

Edge cases: null and empty texts have no words; a null language is ``und``;
repeated rows count each; phrases never go over a mark or line end; without
frequent phrases, or without rows, the result is empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of, mix, ranges
from tsfold.llm.units import _M, _M_INV, Texts, _powers
from tsfold.session import scratch_path

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: One of so many documents is in the sample, and the share of the scaled count at which it proposes a phrase.
SAMPLE = 16
LOWERED = 0.8
BITS = 16
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
SLICE_BYTES = 1 << 20
#: Space and tab part words; marks and line ends part pieces.
_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?\n\x0b\x0c\r")] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


class Words:
    """Words of some texts: place, length, hash, piece and text of each; ``flat`` holds them with a space after each."""

    def __init__(self, texts: list[bytes]):
        t = Texts([x.lower() for x in texts])
        n = len(t.buf)
        mark = _MARK[t.buf]
        word = ~(_GAP[t.buf] | mark)
        begin, end = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        firsts, lasts = t.starts[t.lens > 0], t.ends[t.lens > 0] - 1
        begin[firsts] = word[firsts]
        end[lasts] = word[lasts]
        at, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.lens = stop - at
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=sums[1:])
        self.hash = mix((sums[stop] - sums[at]) * _powers(_M_INV, n)[at] + self.lens.astype(np.uint64))
        for i in np.flatnonzero(self.lens > 256).tolist():  # the polynomial is made for short words
            self.hash[i] = int.from_bytes(hashlib.blake2b(t.buf[at[i]:stop[i]].tobytes(), digest_size=8).digest(), "little")
        self.text = np.searchsorted(t.ends, at, side="right")
        self.piece = np.cumsum(mark)[at] + self.text if len(at) else at  # grows at every mark and every text
        self.flat = np.full(int((self.lens + 1).sum()), 32, np.uint8)
        self.at = np.cumsum(self.lens + 1) - self.lens - 1
        self.flat[ranges(self.at, self.lens)] = t.buf[ranges(at, self.lens)]

    def phrases(self, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``MAX_WORDS`` words: hash of the phrase that begins at each word, and whether there is one.
        ``start`` is the hash of nothing in each text's language."""
        h = start[self.text]
        last = np.arange(len(self.hash))
        for k in range(MAX_WORDS):
            n = max(0, len(self.hash) - k)
            ok = np.zeros(len(self.hash), bool)
            ok[:n] = self.piece[last[k:]] == self.piece[:n]
            h = h.copy()
            h[:n] = mix(h[:n] * _STEP + self.hash[k:])
            yield h, ok

    def strings(self, first: np.ndarray, words: np.ndarray) -> pa.Array:
        """The text of phrases of so many words from so many places."""
        start = self.at[first]
        lens = self.at[first + words - 1] + self.lens[first + words - 1] - start
        ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        data = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(first), 1 << 16):  # in blocks: a place takes eight times as much as its byte
            b = min(a + (1 << 16), len(first))
            data[ends[a]:ends[b]] = self.flat[ranges(start[a:b], lens[a:b])]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())


def _language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Bits:
    """A set of 64-bit hashes as a bit set; it may hold more than was put in, never less."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        bit = h >> self.shift
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words, languages and hashes of nothing of slices of (lang, text) rows."""
    seeds: dict[str, int] = {}
    for batch in batches:
        for part in byte_slices(batch, "text", SLICE_BYTES):
            langs = part.column("lang").to_pylist()
            for x in set(langs) - seeds.keys():
                seeds[x] = _language_hash(x)
            w = Words(bytes_of(part, "text"))
            if len(w.hash):
                yield w, langs, np.array([seeds[x] for x in langs], np.uint64)


def _key(h: np.ndarray, k: int) -> np.ndarray:
    """What phrases are counted by: their hash, with the number of words in the last bits."""
    return h & ~np.uint64(7) | np.uint64(k)


def _counter(now, before, sampled: bool):
    """A ``mapInArrow`` function from (lang, text) to (h, n): the phrases whose beginning and end ``now``
    (a broadcast ``Bits``) holds, and not ``before`` holds as well."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed = Bits(now.value) if now is not None else None
        counted = Bits(before.value) if before is not None else None
        for w, _, start in _slices(batches):
            keys = []
            last_now = last_before = None
            for k, (h, ok) in enumerate(w.phrases(start), 1):
                some = ok
                if k > 1 and not sampled:
                    some = ok.copy()
                    some[:-1] &= last_now[:-1] & last_now[1:]  # the phrases one word shorter, from here and from the next word
                    some[-1] = False
                    if counted is not None:
                        some[:-1] &= ~(last_before[:-1] & last_before[1:])
                if k > 1 or counted is None:
                    keys.append(_key(h[some], k))
                if not sampled:
                    last_now = ok & proposed.has(h)
                    last_before = ok & counted.has(h) if counted is not None else None
            which, distinct = pd.factorize(np.concatenate(keys))
            if len(distinct):
                yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(np.bincount(which), pa.int64())], names=["h", "n"])
    return run


def _text_counter(wanted):
    """A ``mapInArrow`` function from (lang, text) to (lang, phrase, n): the phrases whose hash is in the broadcast bit
    set, by their text; the empty phrase stands for all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bits(wanted.value)
        for w, langs, start in _slices(batches):
            keys, firsts, sizes = [], [], []
            for k, (h, ok) in enumerate(w.phrases(start), 1):
                at = np.flatnonzero(ok & bits.has(h))
                keys.append(_key(h[at], k))
                firsts.append(at)
                sizes.append(np.full(len(at), k))
            firsts, sizes = np.concatenate(firsts), np.concatenate(sizes)
            which, distinct = pd.factorize(np.concatenate(keys))
            one = np.empty(len(distinct), np.int64)
            one[which] = np.arange(len(which))
            first, size = firsts[one], sizes[one]
            lang = pa.array(langs, pa.string()).take(pa.array(w.text[first]))
            yield pa.record_batch([lang, w.strings(first, size), pa.array(np.bincount(which, minlength=len(distinct)), pa.int64())],
                                  names=["lang", "phrase", "n"])
            total: dict[str, int] = {}
            for x, c in zip(langs, np.bincount(w.text, minlength=len(langs)).tolist()):
                total[x] = total.get(x, 0) + c
            yield pa.record_batch([pa.array(list(total)), pa.array([""] * len(total)), pa.array(list(total.values()), pa.int64())],
                                  names=["lang", "phrase", "n"])
    return run


def bits_for(n: int) -> int:
    """Bits of the set for ``n`` phrases, a power of two."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS * n).bit_length()))


def bits_of(counted: DataFrame, size: int) -> np.ndarray:
    """The bit set (``size`` bits) of the hashes of the rows (h, n). It is put together by Spark: each row gives a place
    and a bit, and at most ``size`` / 64 sums come to the driver."""
    shift = 64 - size.bit_length() + 1
    bit = F.shiftrightunsigned("h", shift)
    rows = counted.select(F.shiftright(bit, 6).alias("place"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {shift}) & 63 as int))").alias("b"))
    got = rows.groupBy("place").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[got.column("place").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
    return out


def _not_in(counted: DataFrame, bits) -> DataFrame:
    """The (h, n) rows that the broadcast bit set does not hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bits(bits.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(~held.has(batch.column("h").to_numpy().view(np.uint64))))

    return counted.mapInArrow(run, "h long, n long")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frequent(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, sample: int = SAMPLE,
             lowered: float = LOWERED) -> tuple[DataFrame, int]:
    """(lang, phrase, n) of all phrases of up to ``MAX_WORDS`` words that occur ``min_count`` times, and of the empty
    phrase (all words of the language); and the number of full passes that counted by hash."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def counts(rows: DataFrame, now, before, sampled: bool, least: float) -> DataFrame:
        counted = rows.mapInArrow(_counter(now, before, sampled), "h long, n long")
        return counted.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)

    # stored at once: another sample in a repeated task would be no harm, but bits and passes must see the same one
    few = texts.filter(F.rand(17) < 1 / sample)
    proposed = _stored(counts(few, None, None, True, max(1.0, lowered * min_count / sample)), "phrases-proposed")
    size = bits_for(proposed.count())
    bits = bits_of(proposed, size)
    before, passes = None, 0
    found: DataFrame | None = None
    while True:
        now = spark.sparkContext.broadcast(bits)
        fresh = _stored(counts(texts, now, before, False, min_count), "phrases-counted")
        passes += 1
        found = fresh if found is None else found.unionByName(fresh)
        missed = _stored(_not_in(fresh.filter(F.col("h").bitwiseAND(7) < MAX_WORDS), now), "phrases-border")
        if missed.isEmpty():
            break
        before = now
        bits = bits | bits_of(missed, size)
    wanted = spark.sparkContext.broadcast(bits_of(found, bits_for(found.count())))
    exact = texts.mapInArrow(_text_counter(wanted), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return _stored(exact.filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases-frequent"), passes


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
                 sample: int = SAMPLE, lowered: float = LOWERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of 2 words and more of each language.

    A phrase is cut where a * n / (l * r) is least; l and r count its two parts. A phrase inside a longer one of the
    same count is left out (it then is inside one that is longer by one word, of the same count).
    """
    found, _ = frequent(df, text_col, lang_col, min_count, sample, lowered)
    words = F.split("phrase", " ")
    known = found.filter("phrase <> ''").withColumn("k", F.size(words))
    longer = known.filter("k > 2").select("lang", "n", "k", words.alias("w"))
    inside = longer.select("lang", "n", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "),
                                                          F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    kept = (known.filter("k > 1").join(inside, ["lang", "phrase"], "left").filter("within IS NULL OR within < n")
            .select("lang", "phrase", F.col("n").alias("a"), "k", words.alias("w")))
    cuts = kept.select("lang", "phrase", "a", "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    part = known.select("lang", "phrase", "n")
    cuts = (cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
            .join(_totals(found), "lang"))
    score = F.expr("(cast(cast(a as decimal(19,0)) * cast(total as decimal(19,0)) as decimal(34,0)) * 1000bd) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase")
            .agg(F.min(F.struct("score", "cut", "l", "r", "a", "total")).alias("b"))
            .select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.total").alias("n"), "b.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first rows of each of 64 parts of a language hold the first rows of the language
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _totals(found: DataFrame) -> DataFrame:
    """Words of each language."""
    return found.filter("phrase = ''").groupBy("lang").agg(F.sum("n").alias("total"))

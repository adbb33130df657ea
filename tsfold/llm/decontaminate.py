"""Benchmark decontamination with suffix arrays of the training texts.

A task turns slices of documents into shards: the words' numbers in the
benchmark's vocabulary (0 for a word that no item has, and between documents)
and the sorted array of the shard's suffixes. Only suffixes that start with as
many benchmark words as the shortest window has are sorted; no other can match.
Every test window, and every test suffix for the longest verbatim matches, is
then found by binary search, all of them at once in numpy.

The benchmark is split by item into blocks of about ``block_bytes``; only one
block travels in a task's closure, and every block is matched with all
documents in a pass of its own. Nothing is shuffled; a document is handled
where it is read.

Edge cases: null and empty texts have no words and are never hit; items without
words or without an id take no part; repeated items count once by id; repeated
or null document ids keep their rows; empty tables give an empty result or no
hits; other columns are not read (``remove_contaminated`` passes them through).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of, ranges

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters above U+007F."""
    return text.translate(_LOWER).split()


class TestBlock:
    """Items of the benchmark as word numbers, their distinct windows and the items of each."""

    __test__ = False  # not a test case

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({str(i) for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        flat, starts, lens, owner = [], [], [], []
        windows: dict[bytes, int] = {}
        self.window_items: list[set[int]] = []
        at, pos, size = 0, [], []
        for item, text in items:
            row = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            ids = np.array(row, np.int32)
            n = min(window, len(row))
            for p in range(len(row) - n + 1 if n else 0):
                k = windows.setdefault(ids[p:p + n].tobytes(), len(windows))
                if k == len(pos):
                    pos.append(at + p)
                    size.append(n)
                    self.window_items.append(set())
                self.window_items[k].add(number[str(item)])
            flat.append(ids)
            starts.append(at)
            lens.append(len(row))
            owner.append(number[str(item)])
            at += len(row)
        self.flat = np.concatenate([*flat, np.zeros(1, np.int32)])
        self.starts, self.lens, self.owner = (np.array(x, np.int64) for x in (starts, lens, owner))
        self.pos, self.size = np.array(pos, np.int64), np.array(size, np.int64)
        self.shortest = int(self.size.min()) if pos else 0
        self.longest = int(self.lens.max()) if lens else 0


class Shard:
    """Word numbers of some documents and the sorted array of their suffixes."""

    def __init__(self, texts: list[bytes], test: TestBlock):
        get = test.vocabulary.get
        rows = []
        for text in texts:
            words = words_of(text)
            rows.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        self.lens = np.fromiter(map(len, rows), np.int64, len(rows))
        self.starts = np.cumsum(self.lens + 1) - self.lens - 1
        gap = np.zeros(1, np.int32)
        self.seq = np.concatenate([x for row in rows for x in (row, gap)] + [np.zeros(test.longest + 2, np.int32)])
        stops = np.flatnonzero(self.seq == 0)
        at = np.flatnonzero(self.seq)
        long_enough = stops[np.searchsorted(stops, at)] - at >= max(1, test.shortest)
        self.suffixes = self._sorted(at[long_enough], test.longest)

    def _key(self, at: np.ndarray) -> np.ndarray:
        return self.seq[at].astype(np.int64) << 31 | self.seq[at + 1]

    def _sorted(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Suffix starts in the order of their first ``depth`` words: two words at a time, ties alone go on."""
        key = self._key(at)
        order = np.argsort(key, kind="stable")
        out, key = at[order], key[order]
        group = np.cumsum(np.append(False, key[1:] != key[:-1])) if len(out) else np.zeros(0, np.int64)
        tied = np.arange(len(out))
        for d in range(2, depth, 2):
            same = np.append(False, (group[1:] == group[:-1])) if len(tied) else np.zeros(0, bool)
            same[:-1] |= same[1:]
            same &= key & 0x7FFFFFFF != 0  # a suffix that has ended needs no further word
            tied, group = tied[same], group[same]
            if not len(tied):
                break
            key = self._key(out[tied] + d)
            order = np.lexsort((key, group))
            out[tied], key, group = out[tied][order], key[order], group[order]
            group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        return out

    def _common(self, suffix: np.ndarray, flat: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of first words that suffixes share with test texts of the given sizes."""
        n = np.zeros(len(pos), np.int64)
        on = np.arange(len(pos))
        while len(on):
            on = on[n[on] < size[on]]
            on = on[self.seq[suffix[on] + n[on]] == flat[pos[on] + n[on]]]
            n[on] += 1
        return n

    def bound(self, flat: np.ndarray, pos: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
        """First place in the suffix array not below (or, with ``after``, above) each test text."""
        lo, hi = np.zeros(len(pos), np.int64), np.full(len(pos), len(self.suffixes), np.int64)
        on = np.flatnonzero(lo < hi)
        while len(on):
            mid = (lo[on] + hi[on]) >> 1
            at = self.suffixes[mid]
            n = self._common(at, flat, pos[on], size[on])
            whole = n == size[on]
            below = np.where(whole, after, self.seq[at + n] < flat[np.minimum(pos[on] + n, len(flat) - 1)])
            lo[on[below]] = mid[below] + 1
            hi[on[~below]] = mid[~below]
            on = on[lo[on] < hi[on]]
        return lo

    def hits(self, test: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """(window, start in the shard) of every occurrence of a window."""
        if not len(self.suffixes) or not len(test.pos):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = self.bound(test.flat, test.pos, test.size, False)
        found = np.flatnonzero(lo < len(self.suffixes))
        found = found[self._common(self.suffixes[lo[found]], test.flat, test.pos[found], test.size[found]) == test.size[found]]
        hi = self.bound(test.flat, test.pos[found], test.size[found], True)
        n = hi - lo[found]
        return np.repeat(found, n), self.suffixes[ranges(lo[found], n)]

    def longest(self, test: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item: words of its longest verbatim match, its start in the item and in the shard."""
        best = np.zeros(len(test.lens), np.int64)
        where, at = best.copy(), best.copy()
        item = np.repeat(np.arange(len(test.lens)), test.lens)
        pos = np.arange(len(item), dtype=np.int64)
        size = (test.starts + test.lens)[item] - pos
        if not len(self.suffixes) or not len(pos):
            return best, where, at
        place = self.bound(test.flat, pos, size, False)
        for side in (place - 1, place):
            ok = np.flatnonzero((side >= 0) & (side < len(self.suffixes)))
            suffix = self.suffixes[side[ok]]
            n = self._common(suffix, test.flat, pos[ok], size[ok])
            order = np.lexsort((-suffix, -pos[ok], n))  # the last of an item wins: longest, then first places
            for i, words, p, s in zip(item[ok][order].tolist(), n[order].tolist(), (pos[ok] - test.starts[item[ok]])[order].tolist(), suffix[order].tolist()):
                if words > best[i] or words == best[i] and (p, s) < (where[i], at[i]):
                    best[i], where[i], at[i] = words, p, s
        return best, where, at


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of about ``block_bytes``; one block is on the driver at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == k).collect()
        yield TestBlock([(r.id, (r.text or "").encode()) for r in block], window)


def _matched(part: pa.RecordBatch, test: TestBlock):
    """Shard of a slice, document of each hit, and the hits."""
    shard = Shard(bytes_of(part, "text"), test)
    which, at = shard.hits(test)
    return shard, np.searchsorted(shard.starts, at, side="right") - 1, which, at


_PASS = "id long, text string, lo array<long>, hi array<long>, items array<string>"
_RESULT = "id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every document: n_words, n_hit, n_items, items_sha256, contaminated."""
    def one_pass(test: TestBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, "text", SHARD_BYTES):
                    shard, doc, which, at = _matched(part, test)
                    lo, hi, items = (part.column(c).to_pylist() for c in ("lo", "hi", "items"))
                    order = np.argsort(doc, kind="stable")
                    doc, which, at = doc[order], which[order], at[order]
                    for rows in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
                        d = int(doc[rows[0]])
                        start = at[rows] - shard.starts[d]
                        lo[d] = [*lo[d], *start.tolist()]
                        hi[d] = [*hi[d], *(start + test.size[which[rows]]).tolist()]
                        found = set().union(*(test.window_items[w] for w in np.unique(which[rows]).tolist()))
                        items[d] = [*items[d], *(test.ids[i] for i in found)]
                    yield pa.record_batch([part.column("id"), part.column("text"), pa.array(lo, pa.list_(pa.int64())),
                                           pa.array(hi, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                                          names=["id", "text", "lo", "hi", "items"])
        return run

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lo, hi, items in zip(bytes_of(batch, "text"), *(batch.column(c).to_pylist() for c in ("lo", "hi", "items"))):
                n = len(words_of(text))
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, np.array(lo, np.int64), 1)
                np.add.at(cover, np.array(hi, np.int64), -1)
                hit = int((np.cumsum(cover)[:n] > 0).sum())
                names = sorted(set(items))
                out.append((n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(), pa.bool_())))],
                                  names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.expr("cast(array() as array<long>)").alias("lo"), F.expr("cast(array() as array<long>)").alias("hi"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    for test in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        rows = rows.mapInArrow(one_pass(test), _PASS)
    return rows.mapInArrow(result, _RESULT).withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that hold no window of any item; all columns stay as they are."""
    def one_pass(test: TestBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, text_col, SHARD_BYTES):
                    shard = Shard(bytes_of(part, text_col), test)
                    at = shard.hits(test)[1]
                    keep = np.ones(part.num_rows, bool)
                    keep[np.searchsorted(shard.starts, at, side="right") - 1] = False
                    yield part.filter(pa.array(keep))
        return run

    schema = docs.schema
    for test in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        docs = docs.mapInArrow(one_pass(test), schema)
    return docs


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every item with a match: its longest verbatim match of at least a window (an item shorter than that:
    of all its words) as item_id, n_words, item_start, and the first document that has it: doc_id, doc_start."""
    def one_pass(test: TestBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in byte_slices(batch, "text", SHARD_BYTES):
                    shard = Shard(bytes_of(part, "text"), test)
                    n, where, at = shard.longest(test)
                    i = np.flatnonzero((n > 0) & (n >= np.minimum(window, test.lens)))
                    doc = np.searchsorted(shard.starts, at[i], side="right") - 1
                    yield pa.record_batch([pa.array([test.ids[k] for k in test.owner[i].tolist()], pa.string()), pa.array(n[i]),
                                           pa.array(where[i]), part.column("id").take(pa.array(doc)),
                                           pa.array(at[i] - shard.starts[doc])],
                                          names=["item_id", "n_words", "item_start", "doc_id", "doc_start"])
        return run

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "item_id string, n_words long, item_start long, doc_id long, doc_start long"
    found = None
    for test in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        some = rows.mapInArrow(one_pass(test), schema)
        found = some if found is None else found.unionByName(some)
    best = F.max_by(F.struct("n_words", "item_start", "doc_id", "doc_start"),
                    F.struct("n_words", -F.col("doc_id"), -F.col("item_start"), -F.col("doc_start")))
    return found.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")

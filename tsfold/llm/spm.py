"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A slice of texts is cut into marked words (spaces become U+2581 and open a
word). The distinct words are sorted, which makes neighbours in the list share
their beginnings, as in a trie; they are visited in that order, depth first, and
the forward states of the common beginning are used again.

The model at hand is a BPE model, so the best path is not the one with the
largest sum of scores but the one that greedy merging gives. It has the same
forward form: the encoding of a prefix followed by one more piece is the
encoding of the longer prefix if merging the text of the last two pieces alone
gives these two pieces back (merges never cross a boundary that stays, and a
merge that would cross one would do so within the two pieces beside it). So the
forward state of a prefix is its last piece; exactly one piece ending there
agrees with the state before it. A score of 0 or minus infinity takes the place
of the sum; the result equals the library's.

Characters without a piece become their UTF-8 bytes' pieces. ``decode`` gives
back the text (a literal U+2581 becomes a space, as in the library).

Edge cases: a null or empty text has no ids; long words without spaces take time
in proportion to their length; rows are kept as they are (repeated or null ids);
an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of, ranges
from tsfold.llm.units import Texts, UnitCodes

MARK = "▁"
_MARK_BYTES = MARK.encode()


class Pieces:
    """The vocabulary of a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        surfaces = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                surfaces.append(b"")
            else:
                self.id[piece] = i
                self.score[piece] = sp.get_score(i)
                surfaces.append(piece.replace(MARK, " ").encode())
        self.text = {i: p for p, i in self.id.items()}
        # the longest piece with each ending of three characters; pieces of one or two are always tried
        self.reach: dict[str, int] = {}
        for piece in self.id:
            if len(piece) > 2:
                self.reach[piece[-3:]] = max(len(piece), self.reach.get(piece[-3:], 0))
        self.apart = not any("\n" in p for p in self.id)  # then a line feed never joins a neighbour
        lens = np.fromiter(map(len, surfaces), np.int64, len(surfaces))
        self.surface, self.surface_len = np.frombuffer(b"".join(surfaces), np.uint8), lens
        self.surface_at = np.cumsum(lens) - lens
        self.agree: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def agrees(self, last: int, piece: int) -> bool:
        """Whether the piece can follow the last piece (-1: nothing before it)."""
        ok = self.agree.get((last, piece))
        if ok is None:
            t = self.text[piece]
            if last < 0:
                ok = self.merged(t) == [t]
            else:
                ok = self.merged(self.text[last] + t) == [self.text[last], t]
            if len(self.agree) > 1_000_000:
                self.agree.clear()
            self.agree[last, piece] = ok
        return ok

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, given in any order; visited as a trie."""
        ids, agree, agrees, reach = self.id, self.agree, self.agrees, self.reach.get
        out: list[list[int]] = [[]] * len(words)
        # state of each prefix of the word at hand: last piece (-1 at the start, -2 behind a
        # character without a piece) and the length of that piece
        last, size, before = [-1], [0], ""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            same, n = 0, min(len(word), len(before))
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1:], size[same + 1:]
            for i in range(same + 1, len(word) + 1):
                for a in range(max(0, i - reach(word[i - 3:i], 2) if i > 2 else 0), i):
                    piece = ids.get(word[a:i])
                    if piece is not None:
                        p = last[a]
                        ok = agree.get((p if p != -2 else -1, piece))
                        if ok is None:
                            ok = agrees(p if p != -2 else -1, piece)
                        if ok:
                            last.append(piece)
                            size.append(i - a)
                            break
                else:
                    last.append(-2)
                    size.append(1)
            row, i = [], len(word)
            while i:
                if last[i] >= 0:
                    row.append(last[i])
                else:
                    row += [self.byte[b] for b in reversed(word[i - 1].encode())]
                i -= size[i]
            row.reverse()
            out[k] = row
            before = word
        return out

    def cuts(self, t: Texts) -> np.ndarray:
        """Starts of marked words: marks that follow another character (and, where no piece holds a line
        feed, line feeds and what follows them)."""
        buf, n = t.buf, len(t.buf)
        if not n:
            return np.zeros(0, np.int64)
        mark = buf == 32
        after = np.zeros(n + 1, bool)
        after[1:] = mark
        wide = np.flatnonzero(buf[:-2] == _MARK_BYTES[0]) if n > 2 else np.zeros(0, np.int64)
        wide = wide[(buf[wide + 1] == _MARK_BYTES[1]) & (buf[wide + 2] == _MARK_BYTES[2])]
        mark[wide] = True
        after[wide + 3] = True
        cut = mark & ~after[:n]
        if self.apart:
            feed = buf == 10
            cut |= feed
            cut[1:] |= feed[:-1]
        cut[t.starts[t.lens > 0]] = True
        return np.flatnonzero(cut)

    def codes(self) -> UnitCodes:
        def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            rows = self.encode_words([u.decode().replace(" ", MARK) for u in units])
            lens = np.fromiter(map(len, rows), np.int64, len(rows))
            return np.fromiter((i for r in rows for i in r), np.uint32, int(lens.sum())), lens

        return UnitCodes(self.cuts, encode, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids, without the mark put before the text."""
        raw = self.surface[ranges(self.surface_at[ids], self.surface_len[ids])].tobytes()
        return raw.removeprefix(b" ").decode(errors="replace")


@lru_cache(maxsize=1)
def _loaded(path: str) -> tuple[Pieces, UnitCodes]:
    """The vocabulary and its word codes: a worker's tasks share them, both are bounded."""
    pieces = Pieces(path)
    return pieces, pieces.codes()


def _marked(texts: list[bytes]) -> list[bytes]:
    """Texts with the mark that the model puts before each."""
    return [b" " + x if x else x for x in texts]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens and ids of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _loaded(path)[1]
        for batch in batches:
            for part in byte_slices(batch, "text"):
                ids, n = codes.ids(_marked(bytes_of(part, "text")))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.record_batch([part.column("id"), pa.array(n, pa.int64()),
                                       pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["id", "n_tokens", "ids"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the text of every list of ids (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(path)[0]
        for batch in batches:
            rows = batch.column("ids")
            texts = [pieces.decode(rows[k].values.to_numpy() if rows[k].is_valid else np.zeros(0, np.int64)) for k in range(len(rows))]
            yield pa.record_batch([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return narrow.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every text: n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), and whether
    decoding gives the text back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, codes = _loaded(path)
        for batch in batches:
            for part in byte_slices(batch, "text"):
                texts = bytes_of(part, "text")
                ids, n = codes.ids(_marked(texts))
                rows = np.split(ids, np.cumsum(n)[:-1])
                crc = [zlib.crc32(r.astype("<u4").tobytes()) for r in rows]
                back = [pieces.decode(r) == x.decode().replace(MARK, " ") for r, x in zip(rows, texts)]
                yield pa.record_batch([part.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_())],
                                      names=["id", "n_tokens", "ids_crc32", "round_trip"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, n_tokens long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)

"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the distinct ``WORDS``-word shingles of its whole text.
Texts with equal sets form a class; the join works on one member of each.

Every class gets ``trees`` minwise tokens and a sketch of ``SKETCH`` further
minwise values. In each tree a class starts in the node of its minwise token;
two sets of similarity s meet there with probability s. In a node

* every class is compared with the node's smallest member,
* in a node of at most ``small`` classes, which one task holds, every class is
  compared with the most similar one of another component, and then, of the
  classes that had one, all pairs between the components that are left,
* a larger node is branched: each class goes on to the nodes of 4 / 3 (one by the threshold) further
  minwise tokens on average. A pair at the threshold then meets once more on
  average and less similar groups die out.

A path may end, the more likely the deeper it goes, so the number of trees
follows the depth: a class that was branched d times in an unsettled node gets
``trees_for(d)`` trees, as many as it takes that a pair at the threshold is
apart in all of them with a probability of at most ``MISS`` (12 trees up to two
branchings, 28 for ten, 38 for fifteen). The further trees come in rounds of ``ROUND``, each with
minwise values of its own, until no class has gone deeper than its trees allow
for. No value of a round is used twice, and a tree that uses its share up gets new ones.

Nodes whose classes have all been linked into one component are settled: no
further comparison there can change the result. That ends the work on large
groups of near copies, whose members no token separates, without a cap.

A comparison first looks at the sketches (a pair at the threshold has fewer
than ``least_matches`` of 512 equal values once in about 2,000 cases), then confirms
on the full sets, rebuilt from the texts.

Edge cases: null, empty and blank texts have an empty set and are linked with
nothing; a text of fewer words than a shingle is one shingle; a row with a null
id belongs to its text's class but never names it, and is kept only if no row
with an id has its set; each row of a repeated id is placed by its own text; an empty
table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, bytes_of, mix
from tsfold.llm.units import _M, _M_INV, Texts, _powers
from tsfold.session import scratch_path

WORDS = 5
SKETCH = 512
TREES = 12
SMALL = 2000
MISS = 5e-4
ROUND = 24
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = mix(np.arange(1, TREES * 4 + SKETCH + WORDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    t = Texts([x.lower() for x in texts])
    n = len(t.buf)
    if not n:
        return [np.zeros(0, np.uint64)] * len(texts)
    word = ~_SPACE[t.buf]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    firsts, lasts = t.starts[t.lens > 0], t.ends[t.lens > 0] - 1
    begin[firsts] = word[firsts]
    end[lasts] = word[lasts]
    at, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((t.buf.astype(np.uint64) + np.uint64(1)) * _powers(_M, n), out=sums[1:])
    h = mix((sums[stop] - sums[at]) * _powers(_M_INV, n)[at] + (stop - at).astype(np.uint64))
    for i in np.flatnonzero(stop - at > 256).tolist():  # the polynomial is made for short words
        h[i] = int.from_bytes(hashlib.blake2b(t.buf[at[i]:stop[i]].tobytes(), digest_size=8).digest(), "little")
    lo, hi = np.searchsorted(at, t.starts), np.searchsorted(at, t.ends)
    many = mix(sum(h[i:len(h) - WORDS + 1 + i] * _ODD[-1 - i] for i in range(WORDS))) if len(h) >= WORDS else h[:0]
    out = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if b - a >= WORDS:
            s = np.sort(many[a:b - WORDS + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix((h[a:b] * _ODD[-WORDS:][:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_matches(s: float) -> int:
    """Equal sketch values that a pair of similarity ``s`` reaches but once in about 2,000 cases."""
    p = s + (1 - s) / 256
    return math.floor(SKETCH * p - 3.32 * math.sqrt(SKETCH * p * (1 - p)))


def apart(branchings: int, s: float = 0.75) -> float:
    """Probability that a pair of similarity ``s``, the threshold, is not together in a tree's nodes after so many branchings."""
    lost, second = 0.0, 1 / s - 1
    for _ in range(branchings):
        stay = 1 - s + s * lost  # of one token: not shared, or shared and lost later
        lost = (1 - second) * stay + second * stay ** 2
    return 1 - s * (1 - lost)


def trees_for(branchings: int, s: float = 0.75) -> int:
    """Trees after which a pair at the threshold is apart in all with a probability of at most ``MISS``."""
    lost = apart(branchings, s)
    return max(TREES, math.ceil(math.log(MISS) / math.log(lost))) if lost > 0 else TREES


def signatures(df: DataFrame, id_col: str, text_col: str, trees: int, family: int = 0) -> DataFrame:
    """id, hash of the text, n_shingles, digest of the set, first tokens and sketch of every row; each family has minwise
    values of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = _ODD[:trees + SKETCH, None]
        if family:
            odd = (mix(np.arange(trees + SKETCH, dtype=np.uint64) + np.uint64(family << 32)) | np.uint64(1))[:, None]
        for batch in batches:
            for part in byte_slices(batch, "text"):
                sizes, digests, tokens, sketches = [], [], [], []
                for s in shingle_sets(bytes_of(part, "text")):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(None)
                        tokens.append(None)
                        sketches.append(None)
                        continue
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = np.full(trees + SKETCH, np.uint64(2**64 - 1))
                    for k in range(0, len(s), 512):
                        np.minimum(low, (s[None, k:k + 512] * odd).min(axis=1), out=low)
                    tokens.append(low[:trees].view(np.int64))
                    sketches.append((mix(low[trees:]) >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.record_batch([part.column("id"), part.column("th"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                       pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                      names=["id", "th", "n", "digest", "tokens", "sketch"])

    return _texts(df, id_col, text_col).mapInArrow(
        run, "id long, th long, n long, digest binary, tokens array<long>, sketch binary")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash of the text (which tells apart the texts of a repeated id) and text."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _sketch_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SKETCH)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def likely(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose sketches agree in enough values."""
    enough = least_matches(num / den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_sketch_rows(batch.column("sa").to_pylist()) == _sketch_rows(batch.column("sb").to_pylist())).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= enough))

    side = reps.select("cid", "n", "sketch")
    both = (pairs.join(side.toDF("b", "nb", "sb"), "b").join(side.toDF("a", "na", "sa"), "a")
            .filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "tb"):
                left = bytes_of(part, "ta")
                unique = {x: s for x, s in zip(dict.fromkeys(left), shingle_sets(list(dict.fromkeys(left))))}
                ok = []
                for x, sb in zip(left, shingle_sets(bytes_of(part, "tb"))):
                    sa = unique[x]
                    at = np.minimum(np.searchsorted(sa, sb), len(sa) - 1)
                    both = int((sa[at] == sb).sum()) if len(sa) else 0
                    ok.append(both > 0 and den * both >= num * (len(sa) + len(sb) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(cid, label) of every class that has a link; label is the smallest class reachable.

    Each round a class takes the smallest label among its neighbours' and its
    own, then the label of that label, so chains shorten by more than half.
    """
    edges = _stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-edges")
    labels = _stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("cid"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        near = edges.join(labels.toDF("b", "lb"), "b").groupBy("a").agg(F.min("lb").alias("lb")).withColumnRenamed("a", "cid")
        step = labels.join(near, "cid").select("cid", F.least("label", "lb").alias("to"), F.col("label").alias("old"))
        jump = step.join(labels.select(F.col("cid").alias("to"), F.col("label").alias("far")), "to", "left")
        new = _stored(jump.select("cid", F.least("to", F.coalesce("far", "to")).alias("label"), "old"), "near-labels")
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("cid", "label")
        if not moved:
            return labels


def _close_pairs(rows: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """Pairs (a, b, node) of different labels whose sketches and sizes agree, of all pairs within a node; with
    ``best``, only each row's pair of the largest agreement.

    ``rows`` holds small nodes. They are sorted by node, so a node's rows are
    neighbours; all rows k places apart are compared at once, for every k that a
    node is wide enough for. A node cut by the end of a batch waits for the next.
    A pair that shares several of these nodes is reported in the smallest alone.
    """
    enough = least_matches(num / den)

    def close(node, cid, label, n, sketch, homes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stop = np.searchsorted(node, node, side="right")
        left, a, b, at = stop - np.arange(len(node)), [], [], []
        most, partner = np.zeros(len(node), np.int64), np.full(len(node), -1)
        for k in range(1, int(left.max(initial=1))):
            i = np.flatnonzero(left > k)
            j = i + k
            ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
            i, j = i[ok], j[ok]
            same = (sketch[i] == sketch[j]).sum(axis=1)
            ok = same >= enough
            i, j, same = i[ok], j[ok], same[ok]
            if best:
                for x, y in ((i, j), (j, i)):  # an index occurs once in each
                    more = same > most[x]
                    most[x[more]], partner[x[more]] = same[more], y[more]
            else:
                here = [min(homes[x] & homes[y]) == v for x, y, v in zip(i.tolist(), j.tolist(), node[i].tolist())]
                a.append(cid[i[here]])
                b.append(cid[j[here]])
                at.append(node[i[here]])
        if best:
            some = np.flatnonzero(partner >= 0)
            a, b, at = [cid[some]], [cid[partner[some]]], [node[some]]
        a, b, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, at))
        return np.minimum(a, b), np.maximum(a, b), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("node", "cid", "label", "n")] + [_sketch_rows(batch.column("sketch").to_pylist())]
            now.append(np.array([*map(frozenset, batch.column("homes").to_pylist()), None], object)[:-1])
            held = [np.concatenate(x) for x in zip(held, now)] if held else now
            if not len(held[0]):
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))
            found = close(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            yield pa.record_batch([pa.array(x) for x in found], names=["a", "b", "node"])
        if held and len(held[0]):
            yield pa.record_batch([pa.array(x) for x in close(*held)], names=["a", "b", "node"])

    homes = rows.groupBy("cid").agg(F.collect_set("node").alias("homes"))
    near = rows.join(homes, "cid").select("node", "cid", "label", "n", "sketch", "homes").repartition("node").sortWithinPartitions("node")
    return near.mapInArrow(run, "a long, b long, node long")


def _unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tree, node, cid) with label and node size, of nodes that hold more than one component."""
    rows = rows.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    mixed = (rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter("lo <> hi").select("node", "size"))
    return rows.join(mixed, "node")


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each class with the smallest class of its node."""
    first = rows.groupBy("node").agg(F.min("cid").alias("a"), F.count("*").alias("size")).filter("size > 1").select("node", "a")
    return rows.join(first, "node").filter("cid <> a").select("a", F.col("cid").alias("b")).distinct()


def _branch(rows: DataFrame, first: int, share: int, num: int, den: int) -> DataFrame:
    """Rows of the next level: every class goes to the node of a further minwise token, and in a share of
    den / num - 1 of the nodes to that of a second one. At the threshold one meeting goes on; less similar groups
    die out. The two tokens lie at ``first`` in each tree's ``share`` of the sketch."""
    def token(which: int):
        place = f"int(pmod(tree * {share} + {first + which}, {SKETCH}))"
        return F.expr(f"xxhash64(node, {place}, substring(sketch, {place} + 1, 1))")

    second = F.when(F.pmod(F.xxhash64("node", F.lit(first)), F.lit(num)) < den - num, token(1)).otherwise(token(0))
    return rows.select("tree", F.explode(F.array_distinct(F.array(token(0), second))).alias("node"), "cid", "n", "sketch")


def _roots(classes: DataFrame, family: int) -> DataFrame:
    """Rows of the first level: every class in the nodes of its first tokens."""
    return classes.select("cid", "n", "sketch", F.posexplode("tokens").alias("tree", "token")).select(
        "tree", F.xxhash64(F.lit(family), "tree", "token").alias("node"), "cid", "n", "sketch")


def _grouped(df: DataFrame, id_col: str, text_col: str, num: int, den: int, trees: int, small: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The stored signatures of all rows; digest, component (its smallest id) and the row (id, text hash) that stands
    for the component, of every class; and the (id, text hash) that occur more than once, if there are any."""
    s = num / den
    if not 0.5 <= s <= 1:
        raise ValueError("num / den must lie between 0.5 and 1")
    sig = _stored(signatures(df, id_col, text_col, trees), "near-signatures")
    reps = _stored(sig.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min(F.struct("id", "th")).alias("own"), F.first("n").alias("n"), F.first("tokens").alias("tokens"),
        F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id()), "near-classes")
    again: DataFrame | None = _stored(sig.filter("id IS NOT NULL").groupBy("id", "th").count().filter("count > 1").select("id", "th"), "near-again")
    again = None if again.isEmpty() else again
    rows = _roots(reps, 0).select("tree", "node", "cid")
    pairs = _stored(likely(_star(rows), reps, num, den), "near-pairs")
    place = reps.select("cid", F.col("own.id").alias("id"), F.col("own.th").alias("th"))
    texts = _texts(df, id_col, text_col)

    def texts_of(cids: DataFrame) -> DataFrame:
        """cid and text of the given classes."""
        found = texts.join(place.join(cids, "cid", "left_semi"), ["id", "th"])
        if again is not None:
            found = found.groupBy("id", "th", "cid").agg(F.min("text").alias("text"))
        return found.select("cid", "text")

    met = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    links = _stored(confirmed(pairs, _stored(texts_of(met), "near-texts"), num, den), "near-links")
    labels = components(links)
    open_rows = _stored(_unsettled(rows, labels).join(reps.select("cid", "n", "sketch"), "cid"), "near-open")
    seen = pairs

    def link(found: DataFrame) -> None:
        """Confirm pairs not looked at before and renew the components."""
        nonlocal links, labels, seen
        found = _stored(found.join(seen, ["a", "b"], "left_anti"), "near-pairs")
        if found.isEmpty():
            return
        met = found.select(F.col("a").alias("cid")).union(found.select("b")).distinct()
        fresh = _stored(confirmed(found, _stored(texts_of(met), "near-texts"), num, den), "near-links")
        seen = seen.unionByName(found)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            labels = components(links)

    families = 1
    branched: list[DataFrame] = []  # (cid, depth) of the classes of unsettled large nodes

    def anew(cids: DataFrame) -> DataFrame:
        """cid, n, first tokens and sketch of classes, from minwise values not used before."""
        nonlocal families
        sign = signatures(texts_of(cids), "cid", "text", ROUND, families).select(F.col("id").alias("cid"), "n", "tokens", "sketch")
        families += 1
        return _stored(sign, "near-classes")

    def descend(open_rows: DataFrame, width: int) -> None:
        """Compare small nodes of ``width`` trees and branch large ones until no node is large and unsettled."""
        level, share = 0, max(2, SKETCH // width // 2 * 2)
        while not open_rows.isEmpty():
            few, many = open_rows.filter(F.col("size") <= small), open_rows.filter(F.col("size") > small)
            deeper = not many.isEmpty()
            best = _stored(_close_pairs(few, num, den, True), "near-best")
            found = best.select("a", "b").distinct()
            if deeper:
                gone = _stored(many.select("cid", F.lit(level + 1).alias("depth")).distinct(), "near-branched")
                branched.append(gone)
                first = 2 * level % share
                if level and not first:  # the tree has used up its share of the sketch
                    many = many.drop("sketch").join(anew(gone.select("cid")).select("cid", "sketch"), "cid")
                children = _stored(_branch(many, first, share, num, den), "near-children")
                found = found.unionByName(likely(_star(children), reps, num, den)).distinct()
            link(found)
            # a class without a partner agrees with none in its node; the others are compared again where they are more
            # than one component
            partnered = best.select("node", F.col("a").alias("cid")).unionByName(best.select("node", F.col("b").alias("cid"))).distinct()
            rest = _stored(_unsettled(few.drop("label", "size").join(partnered, ["node", "cid"], "left_semi"), labels), "near-rest")
            if not rest.isEmpty():
                link(_close_pairs(rest, num, den, False).select("a", "b").distinct())
            if not deeper:
                break
            open_rows = _stored(_unsettled(children, labels), "near-open")
            level += 1

    descend(open_rows, trees)
    done, allows = trees, -1  # trees so far, and the depth they are enough for
    if done < trees_for(0, s):
        branched.append(reps.select("cid", F.lit(0).alias("depth")))
    while branched:
        while allows < 1000 and trees_for(allows + 1, s) <= done:
            allows += 1
        past = branched[0]
        for more in branched[1:]:
            past = past.unionByName(more)
        past = _stored(past.groupBy("cid").agg(F.max("depth").alias("depth")).filter(F.col("depth") > allows), "near-branched")
        deepest = past.agg(F.max("depth")).first()[0]
        if deepest is None:
            break
        branched[:] = [past]
        need = F.element_at(F.array(*(F.lit(trees_for(d, s)) for d in range(deepest + 1))), F.col("depth") + 1)
        rows = _roots(anew(past.select("cid")), families).join(past, "cid").filter(F.col("tree") + done < need).drop("depth")
        rows = _stored(_unsettled(rows, labels).drop("label", "size"), "near-open")
        link(likely(_star(rows), reps, num, den))
        descend(_stored(_unsettled(rows, labels), "near-open"), ROUND)
        done += ROUND
    linked = labels.join(reps.select("cid", "own"), "cid")
    linked = linked.join(linked.groupBy("label").agg(F.min("own").alias("first")), "label").select("cid", "first")
    named = reps.select("digest", "cid", "own").join(linked, "cid", "left").select("digest", F.coalesce("first", "own").alias("first"))
    return sig.select("id", "th", "n", "digest"), named, again


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100,
                    trees: int = TREES, small: int = SMALL) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id, kept."""
    sig, named, _ = _grouped(df, id_col, text_col, num, den, trees, small)
    component = F.coalesce("first.id", F.when(F.col("digest").isNull(), F.col("id")))
    return sig.join(named, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100,
             trees: int = TREES, small: int = SMALL) -> DataFrame:
    """The rows of ``df``, all columns, without near duplicates: of each component the row of the smallest id stays
    (of an id with several texts, the one that belongs to the component). Exact repeats of id and text fold into one row;
    rows without words, and rows without an id whose set no row with an id has, all stay."""
    sig, named, again = _grouped(df, id_col, text_col, num, den, trees, small)
    gone = (sig.join(named, "digest").filter("NOT (id <=> first.id AND th = first.th)")
            .select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct())
    rows = df.withColumn("_row_id", F.col(id_col).cast("long")).withColumn("_row_th", F.xxhash64(F.col(text_col).cast("string")))
    left = rows.join(gone, F.col("_row_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row_th") == F.col("_gone_th")), "left_anti")
    if again is not None:
        more = again.select(F.col("id").alias("_row_id"), F.col("th").alias("_row_th"))
        left = (left.join(more, ["_row_id", "_row_th"], "left_anti").select(left.columns)
                .union(left.join(more, ["_row_id", "_row_th"], "left_semi").dropDuplicates(["_row_id", "_row_th"]).select(left.columns)))
    return left.select(df.columns)

"""Near duplicates by one-permutation hashing.

A set of 64-bit hashes is cut into bins by the leading bits; the smallest hash of
each bin is the signature.  An empty bin copies a full one that its own random
order of the bins names first (optimal densification: each full bin is equally
likely, and two sets with the same full bins choose alike).  Runs of bins make band
keys, and sets with an equal key share a bucket.

Equal sets collapse first.  Inside a bucket the members are linked to one centre
only, so a bucket of n makes n - 1 candidates, not n squared.  A candidate counts
if the exact similarity of the full sets says so.  The members that a centre leaves
apart go on with another centre; see :func:`near_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.components import components
from textmill.llm.tables import stored
from textmill.llm.words import mix, signed, slices, word_hashes

@dataclass(frozen=True)
class Banding:
    """How signatures are cut: ``bins`` in bands of ``rows``; ``marks`` bits of a sketch for the members."""

    bins: int = 128
    rows: int = 4
    marks: int = 2048

    @property
    def bands(self) -> int:
        return self.bins // self.rows

    def recall(self, similarity: float) -> float:
        """How likely two sets of this similarity share a bucket."""
        return 1 - (1 - similarity**self.rows) ** self.bands

    @staticmethod
    def tuned(threshold: int, recall: float, bins: int, marks: int) -> Banding:
        """The longest bands, hence the fewest chance meetings, that reach the recall at
        the threshold with at most so many bins."""
        for rows in range(bins, 0, -1):
            found = Banding(bins // rows * rows, rows, marks)
            if found.recall(threshold / 100) >= recall:
                return found
        raise ValueError("too few bins for this recall")


@cache
def _edges(bins: int) -> np.ndarray:
    return np.array([k * 2**64 // bins for k in range(1, bins)], np.uint64)


@cache
def _order(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a full one."""
    return np.argsort(mix(np.arange(bins * bins, dtype=np.uint64) + np.uint64(1)).reshape(bins, bins), axis=1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingles(h: np.ndarray, before: np.ndarray, width: int, which: np.ndarray | None = None) -> list[np.ndarray]:
    """For each text, or those at ``which``, the sorted distinct hashes of its runs of ``width``
    words; a shorter text is one run, an empty one none."""
    n = np.diff(before)
    run = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        run = mix(run * np.uint64(5) ^ h[k:k + len(run)])
    out = []
    which = slice(None) if which is None else which
    for a, size in zip(before[:-1][which].tolist(), n[which].tolist()):
        if size >= width:
            out.append(_distinct(run[a:a + size - width + 1]))
        elif size:
            whole = np.zeros(1, np.uint64)
            for x in h[a:a + size]:
                whole = mix(whole * np.uint64(5) ^ x)
            out.append(mix(whole + np.uint64(size)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(members: np.ndarray, bins: int) -> np.ndarray:
    """The smallest member of each bin, empty bins filled; members are sorted."""
    cut = np.concatenate([[0], np.searchsorted(members, _edges(bins)), [len(members)]])
    full = cut[:-1] < cut[1:]
    sig = members[np.minimum(cut[:-1], len(members) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _order(bins)[empty]
        sig[empty] = sig[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return sig


def band_keys(sigs: np.ndarray, banding: Banding) -> np.ndarray:
    """One key for every band of every signature (rows of ``sigs``)."""
    rows = sigs.reshape(len(sigs), banding.bands, banding.rows)
    key = np.broadcast_to(mix(np.arange(banding.bands, dtype=np.uint64) + np.uint64(977)), rows.shape[:2])
    for k in range(banding.rows):
        key = mix(key * np.uint64(7) ^ rows[:, :, k])
    return key


def sketches(sigs: np.ndarray, sets: list[np.ndarray], banding: Banding) -> np.ndarray:
    """For every signature the bits that the members of its set set, as 64-bit numbers."""
    bits = np.zeros((len(sigs), banding.marks), np.uint8)
    for i, members in enumerate(sets):
        bits[i, ((members >> np.uint64(20)) & np.uint64(banding.marks - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def may_link(threshold: int, banding: Banding, n_x: np.ndarray, x: np.ndarray, n_y: np.ndarray, y: np.ndarray) -> np.ndarray:
    """False where sizes or sketches rule a link out; arrays of rows, or one row against many.

    A bit that only one side has set is a member that the other lacks, which bounds
    the intersection from above without error, so a link is never ruled out.
    Signatures have no say: in short sets their bins are copies of few members.
    """
    most = np.minimum(n_x - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64),
                      n_y - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))
    return ((100 * np.minimum(n_x, n_y) >= threshold * np.maximum(n_x, n_y))
            & ((100 + threshold) * most >= threshold * (n_x + n_y)))


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(lists), -1)


def _likely(threshold: int, banding: Banding):
    """Arrow task: the pairs (a, b, n_a, n_b, s_a, s_b) that may be links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n_a, n_b, s_a, s_b = batch.columns
                hit = may_link(threshold, banding, n_a.to_numpy(), _rows(s_a), n_b.to_numpy(), _rows(s_b))
                yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(hit))

    return run


def _blocks(threshold: int, banding: Banding):
    """Arrow group: one block, or two blocks of one bucket, compared row by row."""
    def run(block: pa.Table) -> pa.Table:
        node, n, component, mine, x = (block[c].combine_chunks() for c in ("node", "n", "component", "block", "sketch"))
        node, n, component, mine, x = node.to_numpy(), n.to_numpy(), component.to_numpy(), mine.to_numpy(), _rows(x)
        low = mine == mine.min()
        left, right = np.flatnonzero(low), np.flatnonzero(~low)
        found = []
        for k, i in enumerate(left):
            js = right if len(right) else left[k + 1:]
            js = js[component[js] != component[i]]
            hit = js[may_link(threshold, banding, n[i], x[i], n[js], x[js])]
            found.append(np.stack([np.minimum(node[hit], node[i]), np.maximum(node[hit], node[i])]))
        a, b = np.hstack(found)
        return pa.table({"a": a, "b": b})

    return run


def as_lists(x: np.ndarray) -> pa.Array:
    """Rows of 64-bit numbers as an Arrow column of lists."""
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(signed(x).ravel()))


SIGNED = "n long, digest binary, bands array<long>, sketch array<long>"


def signed_columns(sets: list[np.ndarray], banding: Banding) -> list[pa.Array]:
    """n, digest (null for an empty set), bands and sketch of each set."""
    sigs = np.zeros((len(sets), banding.bins), np.uint64)
    for i, members in enumerate(sets):
        if len(members):
            sigs[i] = signature(members, banding.bins)
    return [pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            as_lists(band_keys(sigs, banding)), as_lists(sketches(sigs, sets, banding))]


def _signed(width: int, banding: Banding):
    """Arrow task: (node, text, ...) to the node, its set's size, digest, bands and sketch, and the other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingles(*word_hashes(b.column(1)), width)
            yield pa.record_batch([b.column(0), *signed_columns(sets, banding), *b.columns[2:]],
                                  ["node", "n", "digest", "bands", "sketch", *b.schema.names[2:]])

    return run


def _members(width: int):
    """Arrow task: (node, text) to the node and its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingles(*word_hashes(b.column(1)), width)
            yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    return run


def signed_sets(texts: DataFrame, width: int = 5, banding: Banding = Banding()) -> DataFrame:
    """(node, n, digest, bands, sketch) of (node, text)."""
    return texts.select("node", "text").mapInArrow(_signed(width, banding), f"node long, {SIGNED}")


def _compare(threshold: int):
    """Arrow task: keeps the pairs (a, b, left, right) whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, threshold: int, banding: Banding) -> DataFrame:
    """The pairs (a, b) of similarity ``threshold`` hundredths or more, by their full sets.

    Pairs that sizes or sketches rule out go first; then only the texts that a pair
    names are read into sets.
    """
    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    likely = stored(
        pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        .mapInArrow(_likely(threshold, banding), "a long, b long"), "pairs")
    named = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = stored(texts.select("node", "text").join(named, "node", "left_semi").mapInArrow(
        _members(width), "node long, members binary"), "sets").dropDuplicates(["node"])
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    return likely.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(
        _compare(threshold), "a long, b long")


def all_pairs(rest: DataFrame, threshold: int, banding: Banding, small: int, block: int) -> DataFrame:
    """The pairs (a, b) of one bucket and different components that may be links.

    Small buckets are a self-join.  Others are cut into blocks by hash; every two
    blocks are a group of bounded size, and only the pairs that pass leave it.
    """
    sized = stored(rest.join(rest.groupBy("key").agg(F.count("*").alias("m")), "key"), "rest")
    few = sized.filter(F.col("m") <= small).select("key", "node", "component", "n")
    x, y = few.alias("x"), few.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node"))
                   & (F.col("x.component") != F.col("y.component"))
                   & (100 * F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n"))
                   ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / block))
    dealt = (sized.filter(F.col("m") > small).withColumn("block", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / block) - 1)))
             .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    return pairs.union(dealt.groupBy("key", "low", "high").applyInArrow(
        _blocks(threshold, banding), "a long, b long")).distinct()


def crowded_buckets(nodes: DataFrame) -> DataFrame:
    """(node, key) of the buckets that more than one node is in."""
    wide = nodes.select("node", F.explode("bands").alias("key"))
    crowded = wide.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return stored(wide.join(crowded.select("key"), "key").select("node", "key"), "buckets")


def near_links(nodes: DataFrame, buckets: DataFrame, texts: DataFrame, width: int = 5, threshold: int = 75,
               banding: Banding = Banding(), star_rounds: int = 2, small: int = 32, block: int = 1024) -> DataFrame:
    """(node, component) of the nodes that are linked with another one.

    ``nodes`` are distinct sets as :func:`signed_sets` gives them, ``buckets`` those of
    :func:`crowded_buckets`, ``texts`` their (node, text).  In each round every bucket
    that still holds several components names a centre and all members of other
    components are compared with it.  After ``star_rounds`` the pairs that no centre
    has decided, of one bucket and different components, are compared all: a link of
    two texts that share a bucket is never lost.
    """
    links, labels, done = None, None, None
    for r in range(star_rounds + 1):
        live = buckets
        if labels is not None:
            live = live.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = live.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
            live = live.join(open_.select("key"), "key", "left_semi").join(done, ["key", "node"], "left_anti")
        else:
            live = live.withColumn("component", F.col("node"))
        if r < star_rounds:
            # The order in which members become centres differs by round.
            order = F.col("node") if r == 0 else F.xxhash64(F.lit(r), "node")
            live = stored(live, "live")
            centre = live.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "component")).alias("c")).select(
                "key", F.col("c.node").alias("centre"), F.col("c.component").alias("own"))
            pairs = live.join(centre, "key").filter("component <> own").select(
                F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            now = centre.select("key", F.col("centre").alias("node"))
            done = stored(now if done is None else done.union(now), "centres")
        else:
            pairs = all_pairs(live.join(nodes.select("node", "n", "sketch"), "node"), threshold, banding, small, block)
        found = stored(verified(pairs, nodes, texts, width, threshold, banding), "found")
        if labels is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
    return labels


def _digested(width: int):
    """Arrow task: (node, text) to the digest of its set, and the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = shingles(*word_hashes(b.column(1)), width)
            yield pa.record_batch([pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                                   b.column(1)], ["digest", "text"])

    return run


def _of_ids_with_several_texts(every: DataFrame, classes: DataFrame, texts: DataFrame, odd: DataFrame, width: int,
                               ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and texts where some ids have different texts, and the links that these ids make.

    An id names a class of equal sets as long as it has one text.  Classes that such an
    odd id would name get numbers below 0, and their texts are found by their digests.
    """
    named = classes.filter("node is not null")
    renamed = stored(named.join(odd, "node", "left_semi").withColumn("node", -1 - F.monotonically_increasing_id()), "renamed")
    nodes = stored(named.join(odd, "node", "left_anti").unionByName(renamed), "nodes")
    theirs = texts.select("node", "text").join(odd, "node", "left_semi").mapInArrow(_digested(width), "digest binary, text string").join(
        renamed.select("digest", "node"), "digest").select("node", "text").dropDuplicates(["node"])
    read = texts.filter("node is not null").join(odd, "node", "left_anti").select("node", "text").union(theirs)
    held = every.filter("digest is not null").join(odd, "node", "left_semi").select(F.col("node").alias("id"), "digest").distinct().join(
        nodes.select("digest", "node"), "digest").select("id", "node")
    links = held.join(held.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    return nodes, read, links


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 75,
            banding: Banding = Banding(), carry: tuple[str, ...] = ()) -> DataFrame:
    """(node, n, digest, component, *carry) for every row; ``node`` is the id, ``carry`` columns of ``docs``.

    ``digest`` is that of the row's set, null if it is empty; ``component`` the
    smallest id that can be reached, null if the class of equal sets has no id.  Rows
    with one id are linked with each other, whatever their texts are.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = ", ".join(f"carry_{c} {texts.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)
    every = stored(texts.mapInArrow(_signed(width, banding), f"node long, {SIGNED}" + (f", {kinds}" if carry else "")), "sets")
    classes = stored(
        every.filter("digest is not null").groupBy("digest").agg(
            F.min("node").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch")), "classes")
    odd = stored(every.filter("digest is not null and node is not null").groupBy("node").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("node"), "odd-ids")
    if odd.isEmpty():
        nodes = classes.filter("node is not null")
        near = near_links(nodes, crowded_buckets(nodes), texts.filter("node is not null"), width, threshold, banding)
        first = F.coalesce("component", "node")
    else:
        nodes, read, links = _of_ids_with_several_texts(every, classes, texts, odd, width)
        near = near_links(nodes, crowded_buckets(nodes), read, width, threshold, banding)
        near = components(near.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
        label = nodes.select("digest", "node").join(near, "node", "left").select("digest", F.coalesce("component", "node").alias("label"))
        near = label.join(classes.select("digest", F.col("node").alias("id")), "digest").groupBy("label").agg(
            F.min("id").alias("component")).join(label, "label").join(nodes.select("digest", "node"), "digest").select("node", "component")
        first = F.col("component")
    component = nodes.select("digest", "node").join(near, "node", "left").select("digest", first.alias("component"))
    return every.join(component, "digest", "left").select(
        "node", "n", "digest", F.coalesce("component", "node").alias("component"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    threshold: int = 75, banding: Banding = Banding()) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    A null or empty text has no shingle and is its own component.  Rows with the
    same id belong together, even if their texts differ; a row without id belongs to the component of equal sets,
    if one has an id, and else has no component (kept: an id-less row is kept only
    then).  A repeated row gives a repeated result.
    """
    return grouped(docs, id_col, text_col, width, threshold, banding).select(
        F.col("node").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("node") == F.col("component"), F.col("component").isNull()).alias("kept"))

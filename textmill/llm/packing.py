"""Best-fit packing into bins of several permitted lengths.

Documents are cut into pieces no longer than the largest length.  Pieces are dealt
by hash to shards of bounded size, and each shard is packed by itself, the largest
piece first: a piece goes to the open bin that it leaves the least room in; if none
fits, a bin of the length with the least cost is opened.  In the end every bin
shrinks to the smallest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.tables import stored
from textmill.llm.words import space_words

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its length, in tokens (a row of a batch has some work of its own).
BIN_COST = 32


def opening(size: int, rest: int, capacities: Sequence[int], bin_cost: int) -> int:
    """The length of a new bin for a piece: the least cost for each token that the
    bin will hold, when ``rest`` tokens of smaller pieces may still come to fill it;
    on a tie the smaller length."""
    return min((c for c in capacities if c >= size),
               key=lambda c: ((c + bin_cost) / min(c, size + rest), c))


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list, list, list]:
    """For pieces in falling order of size: bin and offset of each; and the length of each bin."""
    capacities = sorted(capacities)
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    bins, offsets, rest = [], [], sum(sizes)
    for size in sizes:
        rest -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = opening(size, rest, capacities, bin_cost), len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if left > size:
            insort(room, (left - size, b))
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def _pack_group(capacities: Sequence[int], bin_cost: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group["n_tokens"].to_pylist()
        bins, offsets, lengths = pack(sizes, capacities, bin_cost)
        used = [0] * len(lengths)
        for b, s in zip(bins, sizes):
            used[b] += s
        return pa.table({
            "doc_id": group["doc_id"], "piece": group["piece"], "n_tokens": group["n_tokens"], "shard": group["shard"],
            "bin": pa.array(bins, pa.int64()), "bin_offset": pa.array(offsets, pa.int64()),
            "bin_capacity": pa.array([lengths[b] for b in bins], pa.int64()),
            "bin_used": pa.array([used[b] for b in bins], pa.int64()),
        })

    return run


def pack_documents(docs: DataFrame, n_tokens: Column, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES,
                   bin_cost: int = BIN_COST, shard_pieces: int = 20_000) -> DataFrame:
    """(doc_id, piece, n_tokens, shard, bin, bin_offset, bin_capacity, bin_used), one row a piece.

    ``n_tokens`` is the length of a row.  A row without tokens has no piece and no
    result.  Rows with the same id are pieces of their own; rows without id are
    packed like others.  The number of shards follows the number of tokens, so a
    shard's size is bounded at every scale; the hash of id and piece deals them out
    evenly, and a row without id has a number of its own for that.
    """
    largest = max(capacities)
    sized = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), n_tokens.cast("long").alias("n")), "lengths")
    # The table is stored, so the numbers of its rows stay the same.
    sized = sized.withColumn("name", F.coalesce("doc_id", -1 - F.monotonically_increasing_id())).filter("n > 0")
    pieces = sized.select("name", "doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {largest}")))).select(
        "name", "doc_id", F.col("pos").cast("long").alias("piece"),
        F.least(F.lit(largest).cast("long"), F.col("n") - F.col("pos") * largest).alias("n_tokens"))
    total = sized.agg(F.sum(F.expr(f"(n - 1) div {largest} + 1"))).first()[0] or 0
    shards = 1 + int(total) // shard_pieces
    return pieces.withColumn("shard", F.pmod(F.xxhash64("name", "piece", "n_tokens"), F.lit(shards))).drop("name").groupBy(
        "shard").applyInArrow(
        _pack_group(tuple(capacities), bin_cost),
        "doc_id long, piece long, n_tokens long, shard long, bin long, bin_offset long, bin_capacity long, bin_used long")


def token_count(text: Column) -> Column:
    """Words between white space and one end token; 0 for null and for a text without words."""
    return F.transform(F.array(F.size(space_words(text))), lambda n: F.when(n > 0, n + 1).otherwise(0))[0]

"""Splitting of oversized texts at natural boundaries by pointer doubling.

Every position where a text may be cut is a node. A node's successor is the farthest legal next cut
(the piece that starts ``overlap`` characters before the node and ends there is at most ``limit``
long), where a better boundary - a paragraph before a sentence before a word - in the last part of
that reach goes before a farther one; how large that part is, is a parameter. Squaring the successor table doubles the distance it jumps, so all cuts of all texts of a
batch are found in as many rounds as the longest text has binary digits of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulae.session import small

#: Fixed value: what counts as white space in a text: tab, line feed, form feed, carriage return, blank.
WHITE = np.array([9, 10, 12, 13, 32], dtype=np.uint32)
#: Fixed value: characters that end a sentence.
STOPS = np.array([ord(c) for c in ".!?…。！？;:"], dtype=np.uint32)

PIECES = T.StructType(
    [
        T.StructField("rec_table", T.StringType()),
        T.StructField("rec_key", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("cut_kind", T.StringType()),
        T.StructField("longest_stretch", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
#: Part of a node's reach, from its far end, in which a better boundary goes before a farther one; 0 takes the farthest legal cut.
PREFERRED = 0.5
CUTS = ("forced", "word", "sentence", "paragraph", "end")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def boundaries(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions after which a word may start, their rank (1 word, 2 sentence or line, 3 paragraph or page), and the longest stretch without white space.

    A cut lies behind the white space that it follows; the text's start and end are no cuts.
    """
    n = len(chars)
    white = np.isin(chars, WHITE)
    edges = np.flatnonzero(np.diff(np.concatenate(([1], white.view(np.int8), [1]))))  # where stretches without white space begin and end
    begins, ends = edges[0::2], edges[1::2]
    longest = int((ends - begins).max()) if len(begins) else 0
    if len(begins) and ends[-1] == n:
        at = begins[1:] if begins[0] == 0 else begins
        before = np.concatenate(([0], ends))[: len(begins)]
        before = before[1:] if begins[0] == 0 else before
    else:  # the text ends in white space
        at = begins[begins > 0]
        before = np.concatenate(([0], ends))[: len(begins)][begins > 0]
    lines = np.concatenate(([0], np.cumsum(chars == 10) + 2 * np.cumsum(chars == 12)))
    in_gap = lines[at] - lines[before]
    stop = np.isin(chars[np.maximum(before, 1) - 1], STOPS)
    rank = np.where(in_gap >= 2, 3, np.where(stop | (in_gap == 1), 2, 1))
    return at, rank, longest


def successors(at: np.ndarray, rank: np.ndarray, n: int, limit: int, overlap: int, preferred: float = PREFERRED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (the start, all cuts, the end), the rank of each, and the node each leads to.

    From a node the best-ranked cut in the ``preferred`` part of its reach is taken, the farthest of that
    rank; failing that the farthest cut at all; failing that the text is cut by force where the
    reach ends. Forced cuts form chains behind a cut that is followed by no other within its reach.
    """
    step = limit - overlap
    known = np.concatenate(([0], at, [n]))
    reach = np.concatenate(([limit], np.full(len(at) + 1, step)))
    gaps = np.flatnonzero(np.diff(known) > reach[:-1])
    forced = [np.arange(known[g] + reach[g], known[g + 1], step) for g in gaps]
    extra = np.concatenate(forced) if forced else np.empty(0, dtype=known.dtype)
    nodes = np.concatenate((known, extra))
    ranks = np.concatenate(([0], rank, [4], np.zeros(len(extra), dtype=rank.dtype)))
    order = np.argsort(nodes, kind="stable")
    nodes, ranks = nodes[order], ranks[order]
    last = len(nodes) - 1
    far = nodes + step
    far[0] = limit
    to = np.searchsorted(nodes, far, side="right") - 1
    half = far - (np.where(np.arange(len(nodes)) == 0, limit, step) * preferred).astype(int)
    chosen = np.zeros(len(nodes), dtype=bool)
    for r in (3, 2):
        of = np.flatnonzero(ranks == r)
        if len(of):
            k = np.searchsorted(nodes[of], far, side="right") - 1
            cand = of[np.maximum(k, 0)]
            good = ~chosen & (k >= 0) & (nodes[cand] > half) & (nodes[cand] > nodes) & (far < n)
            to = np.where(good, cand, to)
            chosen |= good
    return nodes, ranks, np.where(far >= n, last, to)


def greedy_cuts(successor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All nodes reached from ``starts``, by squaring the successor table of a whole batch."""
    reached = starts
    table = successor
    while True:
        more = np.union1d(reached, table[reached])
        if len(more) == len(reached):
            return reached
        reached, table = more, table[table]


def split_items(items: DataFrame, limits: DataFrame, with_text: bool = True, preferred: float = PREFERRED) -> DataFrame:
    """The pieces of every text longer than its collection's limit, see ``PIECES``.

    ``items``: ``rec_table``, ``rec_key``, ``collection``, ``text``, ``page_number``; ``limits``:
    ``collection``, ``max_chars``, ``overlap_chars``. Sizes count code points. Pieces are numbered
    from 1, none is longer than ``max_chars``, consecutive pieces share exactly ``overlap_chars``
    (an overlap of ``max_chars`` or more counts as ``max_chars - 1``, null as 0), and together they
    cover the text. ``cut_kind`` tells what the piece ends at; ``longest_stretch`` is the item's
    longest run without white space. ``page_number`` is the item's page plus the form feeds before
    the piece's first character that is not white space; null stays null.

    Null texts, texts up to the limit, and items whose collection has no limit (or one that is null or
    below 1) give no rows. Exactly repeated rows give one set of pieces. An empty table gives an empty
    result.

    Only oversized texts leave the JVM; apart from the removal of repeated rows nothing is shuffled.
    """
    good = limits.where("max_chars >= 1").groupBy("collection").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("o"))).alias("l"))
    good = good.select("collection", F.col("l.max_chars").alias("max_chars"), F.greatest(F.lit(0), F.least("l.o", F.col("l.max_chars") - 1)).alias("overlap_chars"))
    picked = items.select("rec_table", F.col("rec_key").cast("string").alias("rec_key"), "collection", "text", F.col("page_number").cast("int").alias("page_number"))
    picked = picked.join(small(good), "collection").where(F.char_length("text") > F.col("max_chars"))
    picked = picked.select("rec_table", "rec_key", "collection", "text", "page_number", "max_chars", "overlap_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(4_000_000 / max(1, whole.nbytes / max(1, whole.num_rows))))
            for begin in range(0, whole.num_rows, step):
                yield _pieces(whole.slice(begin, step), with_text, preferred)

    out = picked.mapInArrow(run, PIECES)
    return out.dropDuplicates() if with_text else out.drop("text").dropDuplicates()


def _pieces(b: pa.RecordBatch, with_text: bool, preferred: float) -> pa.RecordBatch:
    texts, pages = b.column(3).to_pylist(), b.column(4).to_pylist()
    limits, overlaps = b.column(5).to_pylist(), b.column(6).to_pylist()
    offset, tables, starts, per_text = 0, [], [], []
    for text, limit, overlap in zip(texts, limits, overlaps):
        chars = code_points(text)
        at, rank, longest = boundaries(chars)
        nodes, ranks, to = successors(at, rank, len(chars), limit, overlap, preferred)
        tables.append(to + offset)
        starts.append(offset)
        per_text.append((chars, nodes, ranks, longest, offset))
        offset += len(nodes)
    reached = greedy_cuts(np.concatenate(tables), np.array(starts)) if tables else np.empty(0, dtype=int)
    bounds = np.searchsorted(reached, [*starts, offset])
    row, no, of, begin_at, end_at, page, kind, stretch, piece = [], [], [], [], [], [], [], [], []
    for i, (chars, nodes, ranks, longest, base) in enumerate(per_text):
        cuts = reached[bounds[i] : bounds[i + 1]] - base
        ends = nodes[cuts[1:]]
        begins = np.concatenate(([0], ends[:-1] - overlaps[i])) if len(ends) else ends
        if pages[i] is not None:
            solid = np.flatnonzero(~np.isin(chars, WHITE))
            feeds = np.concatenate(([0], np.cumsum(chars == 12)))
            k = np.searchsorted(solid, begins)
            first = np.where(k < len(solid), solid[np.minimum(k, max(0, len(solid) - 1))] if len(solid) else begins, begins)
            page.extend((feeds[np.minimum(first, ends)] + pages[i]).tolist())
        else:
            page.extend([None] * len(ends))
        row.extend([i] * len(ends))
        no.extend(range(1, len(ends) + 1))
        of.extend([len(ends)] * len(ends))
        begin_at.extend(begins.tolist())
        end_at.extend(ends.tolist())
        kind.extend(CUTS[r] for r in ranks[cuts[1:]])
        stretch.extend([longest] * len(ends))
        piece.extend([texts[i][a:e] for a, e in zip(begins, ends)] if with_text else [None] * len(ends))
    take = pa.array(row, pa.int64())
    ints = [pa.array(x, pa.int32()) for x in (no, of, begin_at, end_at, page)]
    return pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), *ints, pa.array(kind, pa.string()), pa.array(stretch, pa.int32()), pa.array(piece, pa.string())], names=PIECES.names)

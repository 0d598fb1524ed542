"""Exact rank correlation between many factors, and what is decided from it.

Spearman is taken on the rows two factors share, so a rank depends on the pair
through the partner's null mask.  Factors with equal masks form a class; every
value is ranked once per class, not once per pair, and no row is expanded into
pairs: each task adds up its own pair sums and only those are shuffled.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz, safe_corr
from ..functions.ranks import ordered_blocks
from ..session import materialize
from .panel import KEYS

BATCH_DUPLICATE = 0.98
LIBRARY_DUPLICATE = 0.95
# cells whose ranks one task holds at a time at most, and ranks in all (128 MB, of which there are some three copies)
CELLS_PER_BUCKET = 20_000
NUMBERS_PER_TASK = 1 << 24
# ranks of a block of one column; a block is sorted and ranked whole, several at a time on an executor
NUMBERS_PER_BLOCK = 1 << 21
# pairs and cells multiplied at once where they make no rectangle
LOOSE_PAIRS, LOOSE_CELLS = 4_096, 512
# cells of a search for close pairs by the end of each round, out of the last number
SEARCH_CELLS = (1, 4, 16)
# what rounding of the sums may take from a bound
SEARCH_SLACK = 1e-9
PAIR_SCHEMA = "i int, j int, n double, sxy double, sxx double, syy double"


def widen(long: DataFrame, factors: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Long (keys, factor, score) to one column per factor."""
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("factor") == f, F.col("score"))).alias(f) for f in factors]
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Double columns of a batch as an array with NaN for NULL."""
    cols = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(cols) if len(batch) else np.empty((0, batch.num_columns))


def _count_shared(k: int):
    """Arrow batches to the number of rows where both columns are known, per pair."""

    def run(batches):
        both = np.zeros((k, k))
        rows = 0
        for batch in batches:
            known = (~np.isnan(_matrix(batch))).astype("float64")
            both += known.T @ known
            rows += len(known)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (i.astype("int32"), j.astype("int32"), both[i, j], np.full(len(i), float(rows)))],
            names=["i", "j", "n", "cells"],
        )

    return run


def _shared_counts(frame: DataFrame, factors: Sequence[str]) -> tuple[np.ndarray, int]:
    k = len(factors)
    parts = frame.select(*factors).mapInArrow(_count_shared(k), "i int, j int, n double, cells double")
    n, cells = np.zeros((k, k)), 0
    for r in parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells")).collect():
        n[r["i"], r["j"]] = n[r["j"], r["i"]] = r["n"]
        cells = int(r["cells"])
    return n, cells


WORD = 62


def _rank_block(keys: Sequence[str], need: list[list[int]]):
    """One block of one column, with the counts before it, to a rank per needed row class.

    `right` has a row without x holding the counts before the block per class,
    and a row per value that other blocks share: rows below it, and its copies.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i = left.column("i")[0].as_py()
        x = left.column("x").to_numpy()
        order = np.argsort(x, kind="stable")
        sx = x[order]
        starts = np.flatnonzero(np.r_[True, sx[1:] != sx[:-1]])
        ends = np.r_[starts[1:], len(sx)]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        facts = right.to_pylist()
        before = next(f["a"] for f in facts if f["x"] is None)
        ranks = np.empty((len(x), len(need[i])))
        for c, cls in enumerate(need[i]):
            word = left.column(f"b{cls // WORD}").to_numpy()[order]
            cum = np.r_[0, np.cumsum((word >> (cls % WORD)) & 1)]
            same = cum[ends] - cum[starts]
            per = before[cls] + cum[ends] - (same - 1) / 2.0
            for f in facts:
                if f["x"] is not None:
                    at = np.searchsorted(sx[starts], f["x"])
                    per[at] = f["a"][cls] + (f["b"][cls] + 1) / 2.0
            ranks[order, c] = np.where((word >> (cls % WORD)) & 1, per[group], np.nan)
        offsets = np.arange(len(x) + 1, dtype="int32") * len(need[i])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ranks.ravel()))
        return pa.table([*[left.column(c) for c in keys], left.column("i"), lists], names=[*keys, "i", "ranks"])

    return run


def _tiles(pairs: np.ndarray, cls: list[int], columns: list[dict]) -> list[tuple]:
    """The pairs as tiles (positions, columns of ranks at the left, at the right, whether it is a full rectangle).

    Pairs of the same two classes share their rows, so a rectangle of them is one product of two matrices. What is
    left goes by lists of pairs.
    """
    kind = np.array([[cls[i], cls[j]] for i, j in pairs]).reshape(-1, 2)
    left = np.array([columns[i][cls[j]] for i, j in pairs], dtype="int64")
    right = np.array([columns[j][cls[i]] for i, j in pairs], dtype="int64")
    order = np.lexsort((kind[:, 1], kind[:, 0]))
    cuts = np.flatnonzero((np.diff(kind[order], axis=0) != 0).any(axis=1)) + 1
    tiles, loose = [], []
    for at in np.split(order, cuts):
        rows, r = np.unique(left[at], return_inverse=True)
        cols, c = np.unique(right[at], return_inverse=True)
        if len(at) > 1 and len(rows) * len(cols) <= 3 * len(at):
            tiles.append((at, rows, cols, (r, c)))
        else:
            loose.append(at)
    loose = np.concatenate([np.empty(0, dtype="int64"), *loose]).astype("int64")
    tiles += [(at, left[at], right[at], None) for at in np.split(loose, range(LOOSE_PAIRS, len(loose), LOOSE_PAIRS)) if len(at)]
    return tiles


def _pair_sums(keys: Sequence[str], k: int, need: list[list[int]], cls: list[int], reps: list[int], pairs: np.ndarray, shared: np.ndarray, totals: np.ndarray | None = None):
    """Rank rows of one bucket of cells to partial sums per pair, ranks centred on their known mean.

    A column of ranks is a factor among the rows of one class. Its squares are summed once for all its pairs.
    `totals` are its squares over all buckets, given back with each pair.
    """
    reps, lows = np.array(reps), np.cumsum([0, *map(len, need)])
    columns = [{c: lows[i] + n for n, c in enumerate(need[i])} for i in range(k)]
    mids = np.concatenate([(shared[i, reps[need[i]]] + 1) / 2 for i in range(k)])
    tiles = _tiles(pairs, cls, columns)
    left = np.array([columns[i][cls[j]] for i, j in pairs], dtype="int64")
    right = np.array([columns[j][cls[i]] for i, j in pairs], dtype="int64")

    def run(table: pa.Table) -> pa.Table:
        cell = np.zeros(len(table), dtype="int64")
        for c in keys:
            codes = table.column(c).combine_chunks().dictionary_encode()
            cell = cell * len(codes.dictionary) + codes.indices.to_numpy()
        if len(keys) > 1:
            cell = np.unique(cell, return_inverse=True)[1]
        ranks = table.column("ranks").combine_chunks()
        starts, flat = ranks.offsets.to_numpy()[:-1], ranks.values.to_numpy()
        column = table.column("i").to_numpy()
        size = int(cell.max()) + 1
        dense = np.zeros((len(mids), size))
        order = np.argsort(column, kind="stable")
        edges = np.searchsorted(column[order], np.arange(k + 1))
        for i in range(k):
            rows = order[edges[i] : edges[i + 1]]
            at = np.arange(len(need[i]))[:, None]
            dense[lows[i] : lows[i + 1], cell[rows]] = np.nan_to_num(flat[starts[rows] + at] - mids[lows[i] : lows[i + 1], None])
        squares = np.einsum("cs,cs->c", dense, dense)
        sxy = np.empty(len(pairs))
        for at, a, b, rectangle in tiles:
            if rectangle:
                sxy[at] = (dense[a] @ dense[b].T)[rectangle]
            else:
                for s in range(0, size, LOOSE_CELLS):
                    part = np.einsum("ps,ps->p", dense[a, s : s + LOOSE_CELLS], dense[b, s : s + LOOSE_CELLS])
                    sxy[at] = part if s == 0 else sxy[at] + part
        i, j = pairs.T
        cols = [i.astype("int32"), j.astype("int32"), shared[i, j], sxy, squares[left], squares[right]]
        names = ["i", "j", "n", "sxy", "sxx", "syy"]
        if totals is not None:
            cols, names = [*cols, totals[left], totals[right]], [*names, "tx", "ty"]
        return pa.table([pa.array(v) for v in cols], names=names)

    return run


def bucket_cells(columns: int) -> int:
    """Cells whose ranks one task holds: fewer, the more columns of ranks a cell has."""
    return max(1, min(CELLS_PER_BUCKET, NUMBERS_PER_TASK // max(columns, 1)))


@dataclass
class Ranked:
    """Ranks of every factor among the rows of each null mask that a pair asks for, NaN at rows outside that mask."""

    rows: DataFrame
    keys: list[str]
    factors: list[str]
    wanted: np.ndarray
    need: list[list[int]]
    cls: list[int]
    reps: list[int]
    shared: np.ndarray
    buckets: int


def ranked_columns(
    frame: DataFrame, factors: Sequence[str], pairs: Sequence[tuple[str, str]] | None, stored: bool
) -> Ranked:
    """Each column ranked once per row class it needs. The columns are read three times, so they are stored first unless the caller did.

    A rank goes with the number of its row in the frame, not with the row's keys: eight bytes instead of a time and a name.
    """
    used = {f for pair in pairs for f in pair} if pairs else set(factors)
    factors, keys = [f for f in factors if f in used], ["row"]
    k = len(factors)
    frame = frame.select(*[nz(f).alias(f) for f in factors])
    if not stored:
        frame = materialize(frame)
    shared, cells = _shared_counts(frame, factors)
    cls, reps = [], []
    for i in range(k):
        same = next((c for c, r in enumerate(reps) if shared[i, r] == shared[i, i] == shared[r, r]), None)
        if same is None:
            reps.append(i)
            same = len(reps) - 1
        cls.append(same)
    place = {f: i for i, f in enumerate(factors)}
    wanted = [(place[a], place[b]) for a, b in pairs] if pairs else [(i, j) for i in range(k) for j in range(i + 1, k)]
    need = [set() for _ in range(k)]
    for a, b in wanted:
        need[a].add(cls[b])
        need[b].add(cls[a])
    need = [sorted(n) for n in need]
    words = [f"b{w}" for w in range(-(-len(reps) // WORD))]
    bits = []
    for w in range(len(words)):
        part = F.lit(0).cast("bigint")
        for c, r in enumerate(reps[w * WORD : (w + 1) * WORD]):
            part = part + F.when(F.col(factors[r]).isNotNull(), F.lit(1 << c)).otherwise(F.lit(0))
        bits.append(part.alias(words[w]))
    columns = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).alias("x")) for i, f in enumerate(factors)])
    numbered = frame.withColumn("row", F.monotonically_increasing_id())
    long = numbered.select(*keys, *bits, F.explode(columns).alias("c")).select(*keys, "c.i", "c.x", *words)
    long = long.where(F.col("x").isNotNull()).withColumn("_salt", F.xxhash64(*keys))
    tasks = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of blocks is given always: left to its size, a shuffle joins partitions into blocks that grow with the input
    blocks = -(-int(shared.trace()) * max(map(len, need), default=0) // NUMBERS_PER_BLOCK)
    cut = ordered_blocks(long, ["i", "x", "_salt"], max(blocks, frame.sparkSession.sparkContext.defaultParallelism)).drop("_salt")
    right = _block_facts(cut, len(reps))
    types = dict(cut.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", i int, ranks array<double>"
    rows = cut.groupBy("i", "blk").cogroup(right.groupBy("i", "blk")).applyInArrow(_rank_block(keys, need), schema)
    buckets = max(tasks, -(-cells // bucket_cells(sum(map(len, need)))))
    return Ranked(rows, keys, factors, np.array(wanted).reshape(-1, 2), need, cls, reps, shared, buckets)


def _middles(ranked: Ranked) -> np.ndarray:
    reps = np.array(ranked.reps, dtype="int64")
    return np.concatenate([np.empty(0), *[(ranked.shared[i, reps[need]] + 1) / 2 for i, need in enumerate(ranked.need)]])


def _added(totals: bool = False) -> list[Column]:
    sums = [F.max("n").alias("n"), *[F.sum(c).alias(c) for c in ("sxy", "sxx", "syy")]]
    return sums + [F.max(c).alias(c) for c in ("tx", "ty")] if totals else sums


def _bucket_sums(ranked: Ranked, pairs: np.ndarray, cells: tuple[int, int] | None = None, totals: np.ndarray | None = None) -> DataFrame:
    """Sums per pair of positions over all cells or a slice of them; ranks of factors in none of the pairs are not moved."""
    r, used = ranked, np.unique(pairs)
    rows = r.rows if len(used) == len(r.factors) else r.rows.where(F.col("i").isin(used.tolist()))
    cell, buckets = F.xxhash64(*r.keys), r.buckets
    if cells is not None:
        low, high = cells
        rows = rows.where(F.pmod(cell, F.lit(SEARCH_CELLS[-1])).between(low, high - 1))
        cell, buckets = F.floor(cell / SEARCH_CELLS[-1]), -(-r.buckets * (high - low) // SEARCH_CELLS[-1])
    run = _pair_sums(r.keys, len(r.factors), r.need, r.cls, r.reps, pairs, r.shared, totals)
    schema = PAIR_SCHEMA if totals is None else f"{PAIR_SCHEMA}, tx double, ty double"
    parts = rows.groupBy(F.pmod(cell, F.lit(buckets)).alias("bucket")).applyInArrow(run, schema)
    return parts.groupBy("i", "j").agg(*_added(totals is not None))


def _coefficients(sums: DataFrame) -> DataFrame:
    n = F.col("n")
    rho = F.when(n >= 2, F.try_divide(F.col("sxy"), F.sqrt("sxx") * F.sqrt("syy")))
    return sums.select("i", "j", n.cast("bigint").alias("n"), rho.alias("spearman"))


def _named(found: DataFrame, factors: Sequence[str]) -> DataFrame:
    name = F.array(*[F.lit(f) for f in factors])
    return found.select(F.get(name, F.col("i")).alias("left"), F.get(name, F.col("j")).alias("right"), "n", "spearman")


def spearman_matrix(
    frame: DataFrame,
    factors: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
    stored: bool = False,
) -> DataFrame:
    """(left, right, n, spearman) for every pair of columns, left before right, or for chosen pairs.

    A row of the frame is a cell, whatever its keys.  `spearman` is NULL below two shared rows or for a
    constant side.  The work is N rows per column: sorted into blocks once,
    ranked block by block, then brought together by cell in buckets, whose size falls with
    the number of factors and classes.
    """
    ranked = ranked_columns(frame, factors, pairs, stored)
    return _named(_coefficients(_bucket_sums(ranked, ranked.wanted)), ranked.factors)


@dataclass
class ClosePairs:
    """Pairs at or past a threshold, how many pairs were asked for, and (share of all cells, pairs still open) of each round."""

    pairs: DataFrame
    asked: int
    rounds: list[tuple[float, int]]

    @property
    def work(self) -> float:
        """Share of the products of all asked pairs over all cells that was computed."""
        return sum(share * pairs for share, pairs in self.rounds) / max(self.asked, 1)


def close_pairs(
    frame: DataFrame,
    factors: Sequence[str],
    threshold: float,
    pairs: Sequence[tuple[str, str]] | None = None,
    stored: bool = False,
) -> ClosePairs:
    """The rows of `spearman_matrix` with |spearman| >= threshold, where most pairs are given up after a share of the cells.

    A coefficient is a sum of products over cells, divided by the roots of two sums of squares that are known per column
    before any pair is looked at. After some of the cells the rest of the products is at most the root of the two
    remaining sums of squares (Cauchy-Schwarz), whatever the cells hold; a pair that cannot reach the threshold
    any more is certain not to and is left out of the cells to come. Cells are dealt to rounds by a hash, so a pair with coefficient r
    goes after about (1 - threshold) / (1 - r) of them. Each rank is moved once at most. This holds for any null masks, as the
    sums are over the rows that both columns know. The driver holds the open pairs, as the tasks do.
    """
    spark = frame.sparkSession
    ranked = ranked_columns(frame, factors, pairs, stored)
    ranked.rows = materialize(ranked.rows)
    totals = _square_totals(ranked)
    wanted, rounds, state = ranked.wanted, [], None
    for low, high in zip((0, *SEARCH_CELLS), SEARCH_CELLS):
        if not len(wanted):
            break
        rounds.append(((high - low) / SEARCH_CELLS[-1], len(wanted)))
        sums = _bucket_sums(ranked, wanted, (low, high), totals)
        if state is not None:
            sums = state.unionByName(sums).groupBy("i", "j").agg(*_added(totals=True))
        left = F.sqrt(F.greatest(F.col("tx") - F.col("sxx"), F.lit(0.0))) * F.sqrt(F.greatest(F.col("ty") - F.col("syy"), F.lit(0.0)))
        most = F.abs("sxy") + left
        reach = F.sqrt("tx") * F.sqrt("ty")
        sums = materialize(sums)
        if sums.isEmpty():
            # no cell fell into the slice, so it says nothing of any pair
            continue
        state = sums.where((reach > 0) & (most >= (threshold - SEARCH_SLACK) * reach))
        wanted = np.array([(r["i"], r["j"]) for r in state.select("i", "j").collect()], dtype="int64").reshape(-1, 2)
    if state is None:
        state = spark.createDataFrame([], PAIR_SCHEMA)
    done = _named(_coefficients(state), ranked.factors).where(F.abs("spearman") >= threshold)
    return ClosePairs(done, len(ranked.wanted), rounds)


def _square_totals(ranked: Ranked) -> np.ndarray:
    """Sum of squares of each column of ranks (a factor among the rows of one class) about its known mean."""
    lows = np.cumsum([0, *map(len, ranked.need)])
    mids = _middles(ranked)

    def run(batches):
        sums = np.zeros(lows[-1])
        for batch in batches:
            column, ranks = batch.column(0).to_numpy(), batch.column(1)
            starts, flat = ranks.offsets.to_numpy()[:-1], ranks.values.to_numpy()
            for i in np.unique(column):
                at = starts[column == i][:, None] + np.arange(lows[i + 1] - lows[i])
                sums[lows[i] : lows[i + 1]] += np.nansum((flat[at] - mids[lows[i] : lows[i + 1]]) ** 2, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype="int32")), pa.array(sums)], names=["c", "s"])

    parts = ranked.rows.select("i", "ranks").mapInArrow(run, "c int, s double")
    totals = np.zeros(lows[-1])
    for r in parts.groupBy("c").agg(F.sum("s").alias("s")).collect():
        totals[r["c"]] = r["s"]
    return totals


def _block_facts(cut: DataFrame, classes: int) -> DataFrame:
    """Per (i, blk): counts of each row class in earlier blocks, and the values that cross block borders."""

    def count(c):
        word, bit = F.col(f"b{c // WORD}"), c % WORD
        return F.sum(F.shiftright(word, bit).bitwiseAND(F.lit(1))).alias(f"n{c}")

    counts = [count(c) for c in range(classes)]
    n = [f"n{c}" for c in range(classes)]
    edges = cut.groupBy("i", "blk").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), *counts)
    by_block = Window.partitionBy("i").orderBy("blk")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    edges = materialize(
        edges.select(
            "i",
            "blk",
            "hi",
            (F.col("hi") == F.lead("lo").over(by_block)).alias("cross"),
            F.array(*[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("double") for c in n]).alias("a"),
            F.array(*[F.col(c).cast("double") for c in n]).alias("own"),
        )
    )
    none = F.lit(None).cast("array<double>")
    base = edges.select("i", "blk", F.lit(None).cast("double").alias("x"), "a", none.alias("b"))
    crossing = edges.where("cross").select("i", F.col("hi").alias("x")).distinct()
    copies = (
        cut.join(crossing, ["i", "x"])
        .groupBy("i", "x", "blk")
        .agg(*counts)
        .select("i", "x", "blk", F.array(*[F.col(c).cast("double") for c in n]).alias("c"))
    )
    # the first block that holds a crossing value ends with it
    below = F.zip_with(F.zip_with("a", "own", lambda p, q: p + q), "c", lambda p, q: p - q)
    sums = F.array(*[F.sum(F.col("c")[j]) for j in range(classes)])
    known = copies.join(edges.select("i", "blk", "a", "own"), ["i", "blk"]).withColumn("below", below)
    crossed = known.groupBy("i", "x").agg(F.min_by("below", "blk").alias("a"), sums.alias("b"))
    return base.unionByName(copies.select("i", "x", "blk").join(crossed, ["i", "x"]))


def factor_corr_matrix(frame: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Full symmetric matrix as rows (left, right, spearman), diagonal included."""
    frame = materialize(frame.select(*KEYS, *factors))
    half = spearman_matrix(frame, factors, stored=True).select("left", "right", "spearman")
    other = half.select(F.col("right").alias("left"), F.col("left").alias("right"), "spearman")
    diag = frame.agg(*[F.when(F.max(nz(f)) > F.min(nz(f)), 1.0).alias(f) for f in factors])
    diag = diag.unpivot([], list(factors), "left", "spearman")
    return half.unionByName(other).unionByName(diag.select("left", F.col("left").alias("right"), "spearman"))


def corr_matrix_pearson(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Complete-case Pearson matrix in one aggregation."""
    full = frame.select(*[nz(c).alias(c) for c in columns]).dropna()
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = full.agg(*[safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = one.unpivot([], one.columns, "pair", "corr")
    half = rows.select(
        F.substring_index("pair", "|", 1).alias("left"), F.substring_index("pair", "|", -1).alias("right"), "corr"
    )
    other = half.where("left != right").select(F.col("right").alias("left"), F.col("left").alias("right"), "corr")
    return half.unionByName(other)


def pair_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two score series on their common keys, both known."""
    a = left.select(*KEYS, nz("score").alias("left_score"))
    b = right.select(*KEYS, nz("score").alias("right_score"))
    return a.join(b, KEYS).dropna(subset=["left_score", "right_score"])


def dedup_batch(ranking: DataFrame, pairs: DataFrame, threshold: float = BATCH_DUPLICATE) -> DataFrame:
    """Greedy walk by rank: a factor is dropped if it is too close to a kept better one.

    `ranking` has (factor, pos) with pos unique; `pairs` comes from
    `spearman_matrix`.  Runs as rounds over the edge table: a factor is kept once
    all its better neighbours are dropped, dropped once one of them is kept.
    Output: factor, pos, kept, dedup_of, spearman.
    """
    near = pairs.where(F.abs("spearman") >= threshold)
    both = near.unionByName(
        near.select(F.col("right").alias("left"), F.col("left").alias("right"), "n", "spearman")
    )
    a = ranking.select(F.col("factor").alias("left"), F.col("pos").alias("worse_pos"))
    b = ranking.select(F.col("factor").alias("right"), F.col("pos").alias("better_pos"))
    edges = both.join(a, "left").join(b, "right").where("better_pos < worse_pos")
    edges = materialize(
        edges.select(F.col("left").alias("factor"), F.col("right").alias("better"), "better_pos", "spearman")
    )
    state = materialize(ranking.select("factor", "pos", F.lit(None).cast("boolean").alias("kept")))
    while state.where("kept IS NULL").limit(1).count():
        known = state.select(F.col("factor").alias("better"), F.col("kept").alias("better_kept"))
        view = edges.join(known, "better").groupBy("factor").agg(
            F.max(F.coalesce("better_kept", F.lit(False))).alias("hit"),
            F.max(F.col("better_kept").isNull()).alias("open"),
        )
        decided = (
            F.when(F.col("kept").isNotNull(), F.col("kept"))
            .when(F.col("hit"), F.lit(False))
            .when(~F.coalesce("open", F.lit(False)), F.lit(True))
        )
        state = materialize(state.join(view, "factor", "left").select("factor", "pos", decided.alias("kept")))
    kept = state.where("kept").select(F.col("factor").alias("better"))
    first = (
        edges.join(kept, "better")
        .groupBy("factor")
        .agg(F.min_by(F.struct("better", "spearman"), "better_pos").alias("hit"))
    )
    return state.join(first, "factor", "left").select(
        "factor",
        "pos",
        "kept",
        F.when(~F.col("kept"), F.col("hit.better")).alias("dedup_of"),
        F.when(~F.col("kept"), F.col("hit.spearman")).alias("spearman"),
    )


def library_corr(
    pairs: DataFrame, candidates: DataFrame, accepted: DataFrame, threshold: float = LIBRARY_DUPLICATE
) -> DataFrame:
    """Candidate against accepted factors, nearest first, with the too-close flag.

    `candidates` has (factor), `accepted` has (factor, ic).
    """
    both = pairs.select(F.col("left").alias("candidate"), F.col("right").alias("factor"), "spearman").unionByName(
        pairs.select(F.col("right").alias("candidate"), F.col("left").alias("factor"), "spearman")
    )
    hit = (
        both.where(F.col("spearman").isNotNull())
        .join(candidates.select(F.col("factor").alias("candidate")), "candidate")
        .join(accepted.select("factor", F.col("ic").alias("existing_ic")), "factor")
        .withColumn("abs_spearman", F.abs("spearman"))
    )
    w = Window.partitionBy("candidate").orderBy(F.desc("abs_spearman"), "factor")
    return hit.select(
        "candidate",
        "factor",
        "spearman",
        "abs_spearman",
        "existing_ic",
        F.row_number().over(w).alias("nearness"),
        (F.col("abs_spearman") >= threshold).alias("high"),
    )


def replace_or_block(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """Verdict per candidate: a close factor with lower or unknown IC is replaceable, else it blocks."""
    high = matches.where("high").join(
        candidates.select(F.col("factor").alias("candidate"), F.col("ic").alias("candidate_ic")), "candidate"
    )
    better = F.col("candidate_ic").isNotNull() & (
        F.col("existing_ic").isNull() | (F.col("candidate_ic") > F.col("existing_ic"))
    )
    per = high.groupBy("candidate").agg(
        F.sum(better.cast("bigint")).alias("replaceable"), F.sum((~better).cast("bigint")).alias("blocking")
    )
    verdict = (
        F.when(F.col("blocking") > 0, "rejected")
        .when(F.col("replaceable") > 0, "replacement_candidate")
        .otherwise("accepted")
    )
    return (
        candidates.select(F.col("factor").alias("candidate"), F.col("ic").alias("candidate_ic"))
        .join(per, "candidate", "left")
        .fillna(0, ["replaceable", "blocking"])
        .withColumn("verdict", verdict)
    )

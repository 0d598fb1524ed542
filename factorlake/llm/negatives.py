"""Hard negatives: exact top lists of inner products by lists that clusters of anchors share.

Anchors are clustered by angle. If a candidate i has the angle t to a cluster's centre and no member
lies further than s from it, then no member u has a score over |u| |i| cos(t - s), the angular upper
bound. So for a cluster the candidates are sorted by |i| cos(t - s) once, and every member walks that one list,
block of matrix products by block, until the bound of what follows is under the worst score of its full
top list; it has then certified its result.

The list of a cluster is never gathered. Candidates lie in cells (a hash of the label, the nearest of
some centres), large cells are split into parts; a part is a piece of every cluster's list, and is sorted for
a cluster when its members come. A cell as a whole has an upper bound for a cluster by the same inequality, from its
radius and its largest length. Anchors first walk the cell with the largest bound; the worst
score there is where they start in the other cells, and cells whose bound is lower are not visited.

Scores are whole numbers: a component x counts as floor(256 x). Products are taken in single or double precision
where all their sums are exact, else in 64-bit integers.

Two searches run: the first of the same label give an anchor's positives; the first of other labels
whose score is between `LOW` % of a positive's score and that score are its negatives.

Defined results: rows with null id, label or vector, or a null or non-finite component, and rows whose
scaled vector is longer than 2^30, take no part. Vectors of different lengths have no score. Of rows with one id the
first by label and vector takes part. Ties go to smaller ids.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import ship, tuned
from .samples import sampled

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Lowest score of a negative in percent of the positive's.
LOW = 80
#: Anchors that the centres are fitted on, in numbers of components; members wanted a cluster; most centres.
SAMPLE, MEMBERS, CENTRES = 1 << 20, 64, 128
#: Numbers of a part of a cell (rows times components), and groups of labels.
PART, GROUPS = 1 << 21, 64
#: Candidates of a list that are walked at first, and at most at once: each stretch is twice as long. Anchors that walk together.
STRETCH, LONGEST, TOGETHER = 512, 4096, 200
#: Added to angles before pruning, beyond all rounding.
SLACK = 1e-6
HIGHEST = (1 << 62) - 1


def usable(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, size, v): rows that take part, v scaled."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)
    rows = rows.select("id", "label", F.size("v").alias("size"), F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))
    return rows.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < float(1 << 60))


def single(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of each id; `ids` has all ids of the table in its one column."""
    twice = materialize(ids.toDF("c_id").groupBy("c_id").count().where("count > 1").select("c_id"))
    if twice.isEmpty():
        return rows
    on = F.col("id") == F.col("c_id")
    first = rows.join(twice, on, "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "size")).alias("r")).select("id", "r.label", "r.size", "r.v")
    return rows.join(twice, on, "left_anti").unionByName(first)


def lengths(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q * q).sum(axis=1))


def directions(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(lengths(q), 1e-300)[:, None]


def angles(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(directions(q) @ centres.T, -1.0, 1.0))


def centred(q: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """k directions that rows are near to: started far apart, then moved to the mean of their rows."""
    u = directions(q)
    picks, near = [0], u @ u[0]
    while len(picks) < k:
        picks.append(int(near.argmin()))
        near = np.maximum(near, u @ u[picks[-1]])
    centres = u[picks]
    for _ in range(steps):
        own = (u @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, u)
        filled = lengths(sums) > 1e-9
        centres[filled] = directions(sums[filled])
    return centres


def fit_centres(rows: DataFrame, anchor: Column, most: int = CENTRES, members: int = MEMBERS, part: int = PART) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: centres of the anchors' clusters and of the cells, fitted on a bounded sample of anchors.

    They only steer the work. Lengths that the sample lacks have one cell and one cluster without a centre.
    """
    by = rows.groupBy("size", grouping("label").alias("grp")).agg(F.sum("size").alias("n"), F.sum(anchor.cast("long")).alias("anchors"))
    top = by.agg(F.max("n"), F.sum("anchors"), F.max("size")).first()
    if not top[1]:
        return {}
    wanted = max(1, min(SAMPLE // max(1, top[2]), 64 * most))
    chosen = sampled(rows.where(anchor).where("size > 0").select("id", "v"), ["id"], wanted).collect()
    vectors: dict[int, list] = {}
    for r in chosen:
        vectors.setdefault(len(r["v"]), []).append(r["v"])
    clusters, cells = -(-int(top[1]) // members), -(-int(top[0]) // part)
    return {size: tuple(centred(np.array(v), max(1, min(most, n, len(v)))) for n in (clusters, cells)) for size, v in vectors.items()}


def grouping(label) -> Column:
    return F.pmod(F.xxhash64(label), F.lit(GROUPS)).cast("int")


def packed(q: np.ndarray) -> list[bytes]:
    """Rows as bytes of the smallest integers that hold them; the size of a row tells which."""
    top = np.abs(q).max(axis=1, initial=0)
    kinds = [np.int8, np.int16, np.int32, np.int64]
    kind = np.searchsorted([127, 32767, (1 << 31) - 1], top)
    out: list[bytes] = [b""] * len(q)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        raw = np.ascontiguousarray(q[at].astype(kinds[k]))
        for i, row in zip(at.tolist(), raw, strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(raw: list[bytes], size: int) -> np.ndarray:
    """64-bit rows of packed vectors of one length."""
    out = np.zeros((len(raw), size), dtype=np.int64)
    if size == 0:
        return out
    width = np.array([len(x) for x in raw]) // size
    for w, kind in ((1, np.int8), (2, np.int16), (4, np.int32), (8, np.int64)):
        at = np.flatnonzero(width == w)
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), dtype=kind).reshape(len(at), size)
    return out


def placed(rows: DataFrame, anchor: Column, centres: dict) -> DataFrame:
    """(id, label, grp, size, q, len, cell, off, cluster, turn): where a row lies, and as an anchor its cluster and angle."""
    kind = rows.schema["label"].dataType.simpleString()
    load = ship(rows.sparkSession, centres)

    def run(batches):
        known = load()
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                q = part.column("v").flatten().to_numpy().reshape(len(part), size)
                clusters, cells = known.get(int(size), (None, None))
                where = []
                for c in (cells, clusters):
                    if c is None:
                        where += [np.zeros(len(q), dtype=np.int32), np.full(len(q), np.pi)]
                    else:
                        a = angles(q, c)
                        own = a.argmin(axis=1)
                        where += [own.astype(np.int32), a[np.arange(len(q)), own]]
                taken = [part.column(c) for c in ("id", "label", "grp", "size", "is_anchor")]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(packed(q), pa.binary()), *map(pa.array, (lengths(q), *where))],
                    names=["id", "label", "grp", "size", "is_anchor", "q", "len", "cell", "off", "cluster", "turn"],
                )

    plain = rows.select("id", "label", grouping("label").alias("grp"), "size", anchor.alias("is_anchor"), "v")
    return plain.mapInArrow(
        run, f"id long, label {kind}, grp int, size int, is_anchor boolean, q binary, len double, cell int, off double, cluster int, turn double"
    )


CELL = ["size", "grp", "cell"]


def cells_for_clusters(rows: DataFrame, centres: dict, part: int) -> DataFrame:
    """(c_size, c_cluster, c_grp, c_cell, parts, reach, spread, only): what a cluster's members of length one can score in a cell at most.

    There are 128 clusters and 128 x 64 cells at most for each length of vectors. `only` is the label of a cell that has one.
    """
    spark = rows.sparkSession
    gaps = [(s, i, j, float(g)) for s, (a, c) in centres.items() for i, row in enumerate(np.arccos(np.clip(a @ c.T, -1, 1))) for j, g in enumerate(row)]
    between = spark.createDataFrame(gaps, "g_size int, g_cluster int, g_cell int, gap double")
    one = F.when(F.min("label") == F.max("label"), F.min("label"))
    cells = rows.groupBy(*CELL).agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / part).cast("int")).alias("parts"), F.max("len").alias("long"), F.max("off").alias("radius"), one.alias("only"))
    clusters = rows.where("is_anchor").groupBy("size", "cluster").agg(F.max("turn").alias("spread")).withColumnsRenamed({"size": "c_size", "cluster": "c_cluster"})
    both = clusters.join(cells, F.col("c_size") == F.col("size"))
    both = both.join(between, (F.col("g_size") == F.col("size")) & (F.col("g_cluster") == F.col("c_cluster")) & (F.col("g_cell") == F.col("cell")), "left")
    least = F.greatest(F.lit(0.0), F.coalesce("gap", F.lit(0.0)) - F.col("radius") - F.col("spread") - SLACK)
    reach = F.col("long") * F.greatest(F.lit(0.0), F.cos(least))
    return both.select("c_size", "c_cluster", F.col("grp").alias("c_grp"), F.col("cell").alias("c_cell"), "parts", reach.alias("reach"), "spread", "only")


class Part:
    """A part of a cell: candidates, and their lists by cluster."""

    def __init__(self, key):
        self.key, self.raw, self.id, self.label, self.cluster = key, [], [], [], None

    def homes(self, b):
        self.raw += b.column("q").to_pylist()
        self.id.append(b.column("id").to_numpy())
        self.label.append(b.column("label"))

    def close(self, size: int):
        self.q = unpacked(self.raw, size)
        self.raw = []
        self.id, self.label = np.concatenate(self.id), pa.concat_arrays(self.label)
        self.kinds = self.label.unique()
        self.label = pc.index_in(self.label, self.kinds).to_numpy()
        q = self.q.astype(np.float64)
        self.len, self.direction = lengths(q), directions(q)

    def sort_for(self, cluster: int, spread: float, centre):
        """The shared list of a cluster: candidates by their bound for members of length one."""
        if self.cluster == cluster:
            return
        self.cluster = cluster
        gap = 0.0 if centre is None else np.maximum(0.0, np.arccos(np.clip(self.direction @ centre, -1.0, 1.0)) - spread - SLACK)
        bound = self.len * np.maximum(0.0, np.cos(gap)) * (1 + 1e-9)
        self.order = np.argsort(-bound, kind="stable")
        self.bound, self.longest = bound[self.order], float(self.len.max(initial=0))
        self.listed: dict = {}

    def rows(self, i: int, j: int, kind) -> np.ndarray:
        """Candidates i to j of the list, as the numbers that products are taken in; kept for the cluster's other members."""
        if (i, kind) not in self.listed:
            self.listed[i, kind] = self.q[self.order[i:j]].astype(kind)
        return self.listed[i, kind]


def walk(part: Part, q: np.ndarray, length: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, owner: np.ndarray, cap: np.ndarray, low: np.ndarray, most: int):
    """(slot, id, score): the first `most` candidates of each slot, whose scores are from low to cap.

    A slot belongs to the anchor `owner`. Anchors walk the list of their cluster together, and leave it when all their slots are certified.
    """
    n, at, stretch = len(part.id), 0, STRETCH
    slots = np.arange(len(owner))
    low = low.copy()
    got = [np.zeros(0, dtype=np.int64)] * 3
    product = float(length.max(initial=0)) * part.longest
    kind = np.float32 if product < 1 << 24 else np.float64 if product < 1 << 53 else np.int64
    q = q.astype(kind)
    while at < n and len(slots):
        end = min(n, at + stretch)
        # a slot goes on while what follows can reach its worst score
        slots = slots[length[owner[slots]] * part.bound[at] + 1e-3 >= low[slots]]
        if not len(slots):
            break
        members, place = np.unique(owner[slots], return_inverse=True)
        score = (q[members] @ part.rows(at, end, kind).T).astype(np.int64)
        of = part.order[at:end]
        fits = (part.label[of][None, :] == labels[members][:, None]) == same
        if same:
            fits &= part.id[of][None, :] != ids[members][:, None]
        some = score[place]
        slot, col = np.nonzero(fits[place] & (some >= low[slots][:, None]) & (some <= cap[slots][:, None]))
        if len(slot):
            new = (slots[slot], part.id[of][col], some[slot, col])
            s, i, v = (np.concatenate(x) for x in zip(got, new, strict=True))
            order = np.lexsort((i, -v, s))
            s, i, v = s[order], i[order], v[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            got = [x[rank < most] for x in (s, i, v)]
            full = rank == most - 1
            low[s[full]] = np.maximum(low[s[full]], v[full])
        at, stretch = end, min(2 * stretch, LONGEST)
    return got


def walked(part: Part, some: pa.RecordBatch, same: bool, most: int) -> pa.RecordBatch:
    """(anchor, cap, id, score) of some members of the cluster that the part is sorted for."""
    ids, caps = some.column("id").to_numpy(), some.column("caps")
    owner = np.repeat(np.arange(len(some)), pc.list_value_length(caps).to_numpy())
    cap, low = caps.flatten().to_numpy(), some.column("lows").flatten().to_numpy()
    labels = pc.fill_null(pc.index_in(some.column("label"), part.kinds), -1).to_numpy()
    q = unpacked(some.column("q").to_pylist(), part.key[0])
    slot, found, score = walk(part, q, some.column("len").to_numpy(), ids, labels, same, owner, cap, low, most)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[owner[slot]], cap[slot], found, score)], names=["anchor", "cap", "id", "score"])


def searched(rows: DataFrame, visits: DataFrame, parts: DataFrame, centres: dict, same: bool, most: int) -> DataFrame:
    """(anchor, cap, id, score): the first candidates of the visited parts.

    visits has the part (v_size, v_grp, v_cell, v_part), the cluster (v_cluster, v_spread), and the anchor's id, label, q, len, caps, lows.
    """
    load = ship(rows.sparkSession, {s: a for s, (a, _) in centres.items()})
    sizes = parts.select(*[F.col(c).alias(f"p_{c}") for c in CELL], "p_parts")
    homes = rows.join(sizes, [F.col(c) == F.col(f"p_{c}") for c in CELL])
    none = F.lit(None).cast("array<long>")
    homes = homes.select("size", "grp", "cell", F.pmod(F.xxhash64("id"), F.col("p_parts")).cast("int").alias("part"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("spread"), "id", "label", "q", "len", none.alias("caps"), none.alias("lows"))
    asks = visits.select(*[F.col(f"v_{c}").alias(c) for c in (*CELL, "part", "cluster", "spread")], "id", "label", "q", "len", "caps", "lows")
    by = [*CELL, "part"]
    both = homes.unionByName(asks).repartition(*by).sortWithinPartitions(*by, "cluster")

    def run(batches):
        lists, part, open_ = load(), None, False
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in (*by, "cluster")), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                key, cluster, some = keys[i][:4], keys[i][4], b.slice(i, j - i)
                if part is None or part.key != key:
                    part, open_ = Part(key), True
                if cluster < 0:
                    part.homes(some)
                    continue
                if open_:
                    if part.id:
                        part.close(key[0])
                    open_ = False
                if not len(part.id):
                    continue
                centre = lists[key[0]][cluster] if key[0] in lists else None
                part.sort_for(cluster, some.column("spread")[0].as_py(), centre)
                for k in range(0, len(some), TOGETHER):
                    yield walked(part, some.slice(k, TOGETHER), same, most)

    return both.mapInArrow(run, "anchor long, cap long, id long, score long")


def firsts(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each anchor and cap, with their rank from 1."""
    order = Window.partitionBy("anchor", "cap").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def top_lists(rows: DataFrame, asks: DataFrame, bounds: DataFrame, centres: dict, same: bool, most: int) -> DataFrame:
    """(anchor, cap, id, score, rank): the first candidates of each anchor and cap over all cells.

    `asks` has id, label, grp, size, cluster, q, len, caps, lows. The cell with the largest bound is walked first,
    then those cells whose bound reaches what is still wanted.
    """
    parts = bounds.groupBy(*[F.col(f"c_{c}").alias(c) for c in CELL]).agg(F.max("parts").alias("p_parts"))
    hers = (F.col("size") == F.col("c_size")) & (F.col("cluster") == F.col("c_cluster"))
    if same:
        hers, part = hers & (F.col("grp") == F.col("c_grp")), ["c_size", "c_cluster", "c_grp"]
    else:
        # by label at most 64 groups: a cell of the own label only has no negatives
        part = ["c_size", "c_cluster"]
    ranked = bounds.withColumn("order", F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("reach"), "c_grp", "c_cell")))
    joined = asks.join(ranked, hers).where(F.col("only").isNull() | ((F.col("only") == F.col("label")) == F.lit(same)))

    def visits(cells):
        cells = cells.withColumn("v_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return cells.select(*[F.col(f"c_{c}").alias(f"v_{c}") for c in CELL], "v_part", F.col("c_cluster").alias("v_cluster"), F.col("spread").alias("v_spread"), "id", "label", "q", "len", "caps", "lows")

    # two cells at first: one of them may hold the own label only
    near = F.col("order") <= (1 if same else 2)
    start = materialize(firsts(searched(rows, visits(joined.where(near)), parts, centres, same, most), most))
    worst = start.where(F.col("rank") == most).groupBy(F.col("anchor").alias("w_anchor")).agg(F.map_from_entries(F.collect_list(F.struct("cap", "score"))).alias("worst"))
    later = joined.where(~near).join(worst, F.col("id") == F.col("w_anchor"), "left")
    raised = F.expr("CASE WHEN worst IS NULL THEN lows ELSE transform(caps, (c, i) -> greatest(lows[i], coalesce(worst[c], lows[i]))) END")
    later = later.withColumn("lows", raised).where(F.col("len") * F.col("reach") * (1 + 1e-9) + 1e-3 >= F.array_min("lows"))
    rest = searched(rows, visits(later), parts, centres, same, most)
    return firsts(start.drop("rank").unionByName(rest), most)


def hard_negatives(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, centres: int = CENTRES, members: int = MEMBERS, part: int = PART,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); `anchor` is a condition on the column `id`."""
    tuned(df.sparkSession)
    base = single(usable(df, key, vector, F.col("label") if label is None else label), df.select(F.col(key).cast("long")))
    own = fit_centres(base, anchor, centres, members, part)
    rows = materialize(placed(base, anchor, own))
    bounds = materialize(cells_for_clusters(rows, own, part))
    asks = rows.where("is_anchor").select("id", "label", "grp", "size", "cluster", "q", "len")
    first = asks.withColumn("caps", F.array(F.lit(HIGHEST))).withColumn("lows", F.array(F.lit(-HIGHEST)))
    found = materialize(top_lists(rows, first, bounds, own, True, positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("cap")))
    # scores of the positives, each once, and the lowest scores of their negatives: low * p <= 100 * n, rounded up
    caps = found.where("cap >= 0").groupBy(F.col("anchor").alias("c_anchor")).agg(F.sort_array(F.collect_set("cap")).alias("caps"))
    lowest = F.expr(f"transform(caps, c -> (c div 100) * {low} + ((c % 100) * {low} + 99) div 100)")
    second = asks.join(caps, F.col("id") == F.col("c_anchor")).withColumn("lows", lowest)
    mined = top_lists(rows, second, bounds, own, False, negatives)
    mined = mined.select(F.col("anchor").alias("m_anchor"), F.col("cap").alias("m_cap"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = found.join(mined, (F.col("anchor") == F.col("m_anchor")) & (F.col("cap") == F.col("m_cap")))
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", F.col("cap").alias("positive_score"), "negative_score")

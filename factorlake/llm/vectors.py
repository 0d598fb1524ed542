"""Embedding near-duplicates: an exact metric range join over pivots.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t).
Every vector is at home in the cell of its nearest pivot. By the triangle inequality a
vector can have a partner at home in another cell only if that cell's pivot is at most
2r further away than its own nearest pivot, and at most the cell's radius plus r away;
it visits those cells. Cells are joined on their own, also by label, and give
the number of links of each home vector and a forest of links. A large
cell is split by its homes, its visitors go to every part.

Equal vectors of one label are joined as one with their count. Pivots are `PIVOTS` vectors
at most, a bounded sample; every vector is placed and compared.

Defined results: a vector that is null, zero, holds null or non-finite components, has no
label or no id, links with nothing and is its own component (null for a null id).
Vectors of different lengths link with nothing. Repeated rows are separate vectors and links of
each other. Different vectors under one id share their component and the larger number of links.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import tuned
from .components import components, settle
from .samples import sampled

COSINE = 0.93
#: Most pivots, and the homes of a cell that are wanted.
PIVOTS = 64
CELL = 4_000
#: Added to distances before pruning, beyond all rounding.
SLACK = 1e-6


def comparable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, size, v) of the vectors that can link: v has double components."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").where(finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("size", F.size("v"))


def matrix(column) -> np.ndarray:
    """Rows of one Arrow list column, all of one length."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ pivots.T)))


def sample_pivots(classes: DataFrame, most: int, cell: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length: as many as make cells of the wanted size, by hash order."""
    sizes = {r["size"]: r["n"] for r in classes.groupBy("size", "label").count().groupBy("size").agg(F.max("count").alias("n")).collect()}
    out = {}
    for size, n in sizes.items():
        k = max(1, min(most, -(-n // cell)))
        rows = sampled(classes.where(F.col("size") == size).select("rep", "v"), ["rep"], k).collect()
        out[size] = unit(np.array([r["v"] for r in rows]))
    return out


def placed(classes: DataFrame, pivots: dict[int, np.ndarray], r: float) -> DataFrame:
    """(label, size, cell, role, rep, n, far, v): homes (role 0) and visits (role 1); far is the distance to the cell's pivot."""
    label_type = classes.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = b.filter(pa.array(sizes == size))
                d = distances(unit(matrix(rows.column("v"))), pivots[int(size)])
                home = d.argmin(axis=1)
                least = d[np.arange(len(d)), home]
                at, cell = np.nonzero(d <= least[:, None] + 2 * r + SLACK)
                role = (cell != home[at]).astype(np.int8)
                took = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [took.column("label"), took.column("size"), pa.array(cell.astype(np.int32)), pa.array(role), took.column("rep"), took.column("n"), pa.array(d[at, cell]), took.column("v")],
                    names=["label", "size", "cell", "role", "rep", "n", "far", "v"],
                )

    return classes.select("label", "size", "rep", "n", "v").mapInArrow(
        run, f"label {label_type}, size int, cell int, role tinyint, rep long, n long, far double, v array<double>"
    )


def split_cells(rows: DataFrame, r: float, cell: int) -> DataFrame:
    """Drops visits beyond a cell's radius, and adds `part`, which splits the homes of large cells."""
    by = ["label", "size", "cell"]
    cells = rows.where("role = 0").groupBy(*by).agg(F.max("far").alias("radius"), F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    cells = materialize(cells.select(*[F.col(c).alias(f"c_{c}") for c in by], "radius", "parts"))
    joined = rows.join(cells, [F.col(c) == F.col(f"c_{c}") for c in by]).where(F.col("far") <= F.col("radius") + r + SLACK)
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    joined = joined.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    role = F.when((F.col("role") == 0) & (F.col("part") == own), 0).otherwise(1).cast("tinyint")
    return joined.select(*by, "part", role.alias("role"), "rep", "n", "v")


class Cell:
    """One part of a cell: all homes, against which rows are held as they come."""

    def __init__(self, key):
        self.key, self.rep, self.n, self.u = key, [], [], []

    def homes(self, rep, n, u):
        self.rep.append(rep)
        self.n.append(n)
        self.u.append(u)

    def close(self):
        """No more homes come; the homes are compared with each other."""
        self.rep, self.n, self.u = np.concatenate(self.rep), np.concatenate(self.n), np.concatenate(self.u)
        self.label = np.arange(len(self.rep))
        self.found = np.zeros(len(self.rep), dtype=np.int64)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, rep, n, u, cosine: float):
        """Counts links of the homes with these rows; each row that links is hung under one home."""
        for i in range(0, len(rep), 1000):
            some = slice(i, i + 1000)
            home, row = np.nonzero(self.u @ u[some].T >= cosine)
            other = self.rep[home] != rep[some][row]
            home, row = home[other], row[other]
            self.found += np.bincount(home, weights=n[some][row], minlength=len(self.rep)).astype(np.int64)
            size = len(self.rep)
            label = settle(np.concatenate([self.label, size + np.arange(len(rep[some]))]), home, size + row)
            self.label = label[:size]
            hung = np.flatnonzero(label[size:] < size)
            self.out.append((rep[some][hung], self.rep[label[size:][hung]]))

    def result(self) -> pa.RecordBatch:
        """Counts of homes (a is null) and links (n is null) in one table."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        a = np.concatenate([*[x for x, _ in self.out], self.rep[moved]])
        b = np.concatenate([*[y for _, y in self.out], self.rep[self.label[moved]]])
        # a home has its own copies too
        counts = pa.array(self.found + self.n - 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(self.rep), pa.array(a, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(self.rep), pa.int64()), pa.array(b, pa.int64())]),
                pa.concat_arrays([counts, pa.nulls(len(a), pa.int64())]),
            ],
            names=["a", "b", "n"],
        )


def joined(rows: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n): for b null, a's number of links; else a link."""
    by = ["label", "size", "cell", "part"]
    rows = rows.repartition(*by).sortWithinPartitions(*by, "role")

    def run(batches):
        cell, open_ = None, False
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                if cell is None or cell.key != keys[i]:
                    if cell is not None:
                        if open_:
                            finish_homes(cell, cosine)
                        yield cell.result()
                    cell, open_ = Cell(keys[i]), True
                role, rep, n = (part.column(c).to_numpy() for c in ("role", "rep", "n"))
                u = unit(matrix(part.column("v")))
                h = int((role == 0).sum())
                if h:
                    cell.homes(rep[:h], n[:h], u[:h])
                if h < len(rep):
                    if open_:
                        finish_homes(cell, cosine)
                        open_ = False
                    cell.meet(rep[h:], n[h:], u[h:], cosine)
        if cell is not None:
            if open_:
                finish_homes(cell, cosine)
            yield cell.result()

    return rows.mapInArrow(run, "a long, b long, n long")


def finish_homes(cell: Cell, cosine: float) -> None:
    cell.close()
    rep, n, u = cell.rep, cell.n, cell.u
    cell.meet(rep, n, u, cosine)


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, pivots: int = PIVOTS, cell: int = CELL) -> DataFrame:
    """(id, n_links, component) of every row."""
    tuned(df.sparkSession)
    r = float(np.sqrt(2 - 2 * cosine))
    rows = materialize(comparable(df, key, vector, label))
    classes = materialize(rows.groupBy("label", "size", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    found = materialize(joined(split_cells(placed(classes, sample_pivots(classes, pivots, cell), r), r, cell), cosine))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.max("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    solved = classes.join(counts, "rep").join(roots, F.col("rep") == F.col("node"), "left")
    solved = solved.select(F.col("label").alias("c_label"), F.col("v").alias("c_v"), "n_links", F.coalesce("root", "rep").alias("component"))
    whole = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    out = whole.join(materialize(solved), (F.col("label") == F.col("c_label")) & (F.col("v") == F.col("c_v")) & F.col("id").isNotNull(), "left")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component"))

"""Hard negatives by two-dimensional block matrix multiplication.

Anchors are dealt into blocks, rows into blocks, dimensions into chunks.  A
task multiplies one anchor block with one row block over one chunk and gives a
partial tile of int64 scores; partial tiles of the chunks are shuffled by strips
of anchors and added, and only the best of a whole strip leave the task.  So no
task holds more than one tile, whatever the table's size, and scores are never
rows.

Two passes: the anchors' positives (the first ``POSITIVES`` rows of their label,
multiplied within labels only), then for each positive the first ``NEGATIVES``
rows of other labels whose score is between ``LEAST`` percent of the positive's
and the positive's.

Components are integers (floor of ``SCALE`` times the component), so sums are
exact in any order.  A product runs in float64 where no sum can reach 2^53, in
int64 otherwise; beyond int64 sums wrap.  A strip is sent in the narrowest
integers that hold it.

Rows with a null label, a null vector, or a null or non-finite component take
no part.  A shorter vector counts as filled up with zeros.  Rows are known by
their number in the order of vec_id (nulls last), which also breaks ties, so
repeated rows are each a row, anchor, positive or negative by themselves; a
null vec_id is never an anchor.  Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import freed, trim
from .storage import discard, materialize

SCALE, POSITIVES, NEGATIVES, LEAST = 256, 5, 5, 80
#: Anchors and rows of a tile and dimensions of a chunk, about; results don't change with these.
ANCHORS, ROWS, WIDTH = 512, 8192, 32
#: Scores of all partial tiles of a strip.
STRIP = 1 << 22

TILE = "part long, ab int, rb int, strip int, chunk int, width int, tile binary, a_row binary, a_label binary, r_row binary, r_label binary, p_row binary, p_score binary"

#: Names of the second side of a product.
OTHER = ["r_part", "r_ab", "r_rb", "r_chunk", "r_row", "r_label", "r_v"]


def prepared(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> tuple[DataFrame, str]:
    """Written rows row, vec_id, label, v (array of long), anchor."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    own = vectors.withColumn("__anchor", F.coalesce(anchor, F.lit(False)))
    own = own.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("v"), F.col("__anchor").alias("anchor"))
    own = own.where(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    own = own.withColumn("v", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))
    return materialize(own.orderBy(F.asc_nulls_last("vec_id")).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of up to ``width`` integers as rows of a matrix."""
    column = column.combine_chunks()
    size = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(np.arange(len(size)), size), at] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 inner products of the rows of a with those of b."""
    most = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    lo, hi = int(x.min()), int(x.max())
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= lo and hi <= np.iinfo(kind).max:
            return np.dtype(kind).itemsize, x.astype(kind).tobytes()
    return 8, x.tobytes()


def _wide(width: int, tile: bytes) -> np.ndarray:
    return np.frombuffer(tile, f"<i{width}").astype(np.int64)


def _multiply(width: int, strip: int):
    """Partial tiles of one anchor block, row block and chunk, by strips of anchors."""
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in TILE.split(", ")])

    def run(own: pa.Table, of: pa.Table) -> pa.Table:
        if not own.num_rows or not of.num_rows:
            return schema.empty_table()
        own, of = own.sort_by("row"), of.rename_columns([c[2:] for c in OTHER]).sort_by("row")
        part, ab, rb, chunk = (own[c][0].as_py() for c in ("part", "ab", "rb", "chunk"))
        scores = _product(_matrix(own["v"], width), _matrix(of["v"], width))
        out = []
        for k, i in enumerate(range(0, own.num_rows, strip)):
            some = own.slice(i, strip)
            size, tile = _narrow(scores[i : i + strip])
            row = {"part": part, "ab": ab, "rb": rb, "strip": k, "chunk": chunk, "width": size, "tile": tile}
            if chunk == 0:
                longs = lambda t, c: t[c].to_numpy().astype(np.int64).tobytes()
                row |= {"a_row": longs(some, "row"), "a_label": longs(some, "label"), "r_row": longs(of, "row"), "r_label": longs(of, "label")}
                for c in ("p_row", "p_score"):
                    # As many to each anchor: how many, then these.
                    lists = [x.as_py() for x in some[c]]
                    row[c] = np.array([[len(x), *x, *[0] * (POSITIVES - len(x))] for x in lists], np.int64).tobytes()
            out.append(row)
        trim()
        return pa.Table.from_pylist(out, schema)

    return run


def _added(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Whole scores of a strip, and whose they are."""
    head = table.slice(table["chunk"].to_pylist().index(0), 1).to_pylist()[0]
    who = {c: np.frombuffer(head[c], "<i8") for c in ("a_row", "a_label", "r_row", "r_label", "p_row", "p_score")}
    scores = np.zeros(len(who["a_row"]) * len(who["r_row"]), np.int64)
    for width, tile in zip(table["width"], table["tile"], strict=True):
        scores += _wide(width.as_py(), tile.as_buffer())
    return scores.reshape(len(who["a_row"]), -1), who


def _best_same(table: pa.Table) -> pa.Table:
    """The first rows of each anchor's label in a tile."""
    scores, who = _added(table)
    out: list[tuple[int, int, int]] = []
    for s, me, label in zip(scores, who["a_row"].tolist(), who["a_label"], strict=True):
        at = np.flatnonzero((who["r_label"] == label) & (who["r_row"] != me))
        if len(at) > POSITIVES:
            at = at[s[at] >= np.partition(s[at], -POSITIVES)[-POSITIVES]]
        at = at[np.lexsort((who["r_row"][at], -s[at]))][:POSITIVES]
        out += [(me, int(who["r_row"][i]), int(s[i])) for i in at]
    return pa.table(dict(zip(("a_row", "p_row", "p_score"), (pa.array([r[c] for r in out], pa.int64()) for c in range(3)), strict=True)))


def _best_window(percent: int, first: int):
    """The first rows of other labels in each window of each anchor in a tile."""

    def run(table: pa.Table) -> pa.Table:
        scores, who = _added(table)
        p_row, p_score = (who[c].reshape(-1, POSITIVES + 1) for c in ("p_row", "p_score"))
        out: list[tuple[int, int, int, int, int]] = []
        for s, me, label, rows, bars in zip(scores, who["a_row"].tolist(), who["a_label"], p_row.tolist(), p_score.tolist(), strict=True):
            n = rows[0]
            least = min((-(-percent * x // 100) for x in bars[1 : n + 1]), default=0)
            at = np.flatnonzero((who["r_label"] != label) & (s >= min(least, (1 << 63) - 1)) & (s <= max(bars[1 : n + 1], default=0)))
            at = at[np.lexsort((who["r_row"][at], -s[at]))]
            down = -s[at]
            for p, x in zip(rows[1 : n + 1], bars[1 : n + 1], strict=True):
                i = int(np.searchsorted(down, -x))
                for j in at[i : i + first]:
                    if 100 * int(s[j]) < percent * x:
                        break
                    out.append((me, p, x, int(who["r_row"][j]), int(s[j])))
        return pa.table(dict(zip(("a_row", "p_row", "p_score", "n_row", "n_score"), (pa.array([r[c] for r in out], pa.int64()) for c in range(5)), strict=True)))

    return run


class Grid:
    """How the table is dealt: numbers of anchor blocks, row blocks and chunks."""

    def __init__(self, n_anchors: int, n_rows: int, dims: int, anchors: int = ANCHORS, rows: int = ROWS, width: int = WIDTH):
        up = lambda a, b: max(1, -(-a // b))
        self.ab, self.rb, self.chunks, self.width = up(n_anchors, anchors), up(n_rows, rows), up(dims, width), width
        self.strip = max(1, STRIP // (self.chunks * min(rows, max(n_rows, 1))))

    def reduced(self, anchors: DataFrame, rows: DataFrame, reduce, schema: str) -> DataFrame:
        """``reduce`` of each strip of whole scores of anchors (part, row, label, v, p_row, p_score) with rows (part, row, label, v) of the same part."""
        block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        cut = F.slice("v", F.col("chunk") * self.width + 1, self.width).alias("v")
        head = lambda c: F.when(F.col("chunk") == 0, F.col(c)).alias(c)
        left = anchors.withColumn("ab", block(self.ab)).withColumn("rb", every(self.rb)).withColumn("chunk", every(self.chunks))
        left = left.select("part", "ab", "rb", "chunk", "row", head("label"), cut, head("p_row"), head("p_score"))
        right = rows.withColumn("rb", block(self.rb)).withColumn("ab", every(self.ab)).withColumn("chunk", every(self.chunks))
        right = right.select("part", "ab", "rb", "chunk", "row", head("label"), cut).toDF(*OTHER)
        key = ["part", "ab", "rb", "chunk"]
        tiles = left.groupBy(*key).cogroup(right.groupBy(*OTHER[:4])).applyInArrow(_multiply(self.width, self.strip), TILE)
        return tiles.groupBy("part", "ab", "rb", "strip").applyInArrow(reduce, schema)


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, scale: int = SCALE, blocks: tuple[int, int, int] = (ANCHORS, ROWS, WIDTH)) -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor`` says which rows are anchors."""
    if not 0 < positives <= POSITIVES:
        raise ValueError(f"positives must be from 1 to {POSITIVES}")
    rows, at_rows = prepared(vectors, anchor, vec_id, vector, label, scale)
    n = rows.agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dims")).first()
    grid = Grid(n.anchors, n.rows, n.dims or 1, *blocks)
    none = F.array().cast("array<long>")
    some = rows.where("anchor")

    within = some.select(F.col("label").alias("part"), "row", "label", "v", none.alias("p_row"), none.alias("p_score"))
    same = rows.select(F.col("label").alias("part"), "row", "label", "v").join(some.select(F.col("label").alias("part")).distinct(), "part", "left_semi")
    found = grid.reduced(within, same, _best_same, "a_row long, p_row long, p_score long")
    order = Window.partitionBy("a_row").orderBy(F.desc("p_score"), "p_row")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives)
    lists = found.groupBy("a_row").agg(F.sort_array(F.collect_list(F.struct("k", "p_row", "p_score"))).alias("p"))
    lists, at_lists = materialize(lists.select(F.col("a_row").alias("row"), F.col("p.p_row").alias("p_row"), F.col("p.p_score").alias("p_score")), "negatives-positives")

    one = F.lit(0).cast("long").alias("part")
    asked = some.join(lists, "row").select(one, "row", "label", "v", "p_row", "p_score")
    found = grid.reduced(asked, rows.select(one, "row", "label", "v"), _best_window(least, negatives), "a_row long, p_row long, p_score long, n_row long, n_score long")
    order = Window.partitionBy("a_row", "p_row").orderBy(F.desc("n_score"), "n_row")
    best, _ = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives), "negatives-best")
    name = lambda key, alias: rows.select(F.col("row").alias(key), F.col("vec_id").alias(alias))
    named = best.join(name("a_row", "anchor_id"), "a_row").join(name("p_row", "positive_id"), "p_row").join(name("n_row", "negative_id"), "n_row")
    discard(vectors.sparkSession, at_lists)
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))

"""Hard negatives by a block matrix multiplication in two dimensions (SUMMA-style).

Scores of anchors against all rows are a matrix product. Anchors and rows are dealt into blocks by
a hash, and each vector is cut into chunks of dimensions. A tile (anchor block, row block) gets the
chunks of both, multiplies them chunk by chunk and adds the products up in place, so that partial
products are never moved. Tiles are read twice, and made twice rather than kept, since they hold
eight bytes for each anchor and row, a hundredth of the table's square:

* every tile gives each anchor's best rows of its label, and the best of these over all tiles are
  the anchor's positives;
* positives go with their anchors to the tiles again, each tile gives the best rows of other
  labels inside the window of each positive, and the best of these over all tiles are the answer.

No block or tile grows with the table, and a task holds two blocks and STRIPE rows of one tile at a
time: a row block has about ROWS rows, an anchor block about ANCHORS (fewer of long vectors: CELLS
components at most about), and rows with one id or one vector are dealt apart. The table is sent once for
each anchor block, twice in all.

A row takes part if its label and vector are there and all components are finite numbers. Scores
are exact: products run in doubles where no sum can pass 2^53, in int64 beyond; components whose
scaled size passes REACH, sums of which int64 couldn't hold, raise an error. Defined cases: vectors of several
lengths (missing components count as zero), vectors without components (score zero), null ids
(never anchors; last among ties), repeated ids (separate rows; a repeated anchor mines for each of its
rows, and its other rows may be its positives), empty tables, other columns (ignored), anchors without
positives or positives without negatives (no rows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stash, read

ANCHORS, ROWS, WIDTH = 2048, 4096, 32
#: Components of a block, and anchors whose scores are held at once.
CELLS, STRIPE = 1 << 19, 64
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
SCALE = 256
#: Components stay below this size after scaling, so that 2,048 of their products fit an int64.
REACH = 1 << 26
#: A key behind all others.
NONE = np.iinfo(np.int64).max


def vectors(table: DataFrame) -> DataFrame:
    """i (a number of our own), vec_id, label, v (scaled components, rounded down): rows that take part."""
    x = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    finite = ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("e", lambda c: F.when(F.abs(c) * SCALE < REACH, F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long")).cast("int"))
    return x.filter(F.col("label").isNotNull() & F.col("e").isNotNull() & finite).select(F.monotonically_increasing_id().alias("i"), "vec_id", moved.alias("label"), scaled.alias("v"))


def _matrix(side: pa.Table) -> np.ndarray:
    """The rows of one chunk, in the order of i."""
    parts = side.sort_by("i")["part"].combine_chunks()
    lengths = np.diff(parts.offsets.to_numpy())
    width = max(1, lengths.max(initial=0))
    m = np.zeros((len(side), width), np.int64)
    m[np.arange(width) < lengths[:, None]] = parts.flatten().to_numpy()
    return m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in int64."""
    k = min(a.shape[1], b.shape[1])
    a, b = a[:, :k], b[:, :k]
    if k * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Stripe:
    """Scores of some anchors of a tile: keys that sort by falling score, ties by the rows' places, and back."""

    def __init__(self, scores: np.ndarray):
        self.bits = scores.shape[1].bit_length()
        self.ranks = None
        if scores.size and max(int(scores.max()), -int(scores.min())) >> (61 - self.bits):
            # too large to leave room for places: ranks stand for them
            self.ranks, at = np.unique(scores, return_inverse=True)
            scores = at.reshape(scores.shape)
        self.keys = (-scores << self.bits) + np.arange(scores.shape[1])

    def read(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores."""
        scores = -(keys >> self.bits)
        return keys & ((1 << self.bits) - 1), scores if self.ranks is None else self.ranks[scores]

    def window(self, low: int, high: int) -> tuple[int, int]:
        """The first key of scores from low to high, and the first behind them."""
        if self.ranks is not None:
            low, high = (int(x) for x in (np.searchsorted(self.ranks, low, "left"), np.searchsorted(self.ranks, high, "right") - 1))
        return -high << self.bits, (1 - low) << self.bits


class Tile:
    """An anchor block against a row block. Rows are in the order of ties."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        first, own = (side.filter(pc.equal(side["chunk"], 0)).sort_by("i").combine_chunks() for side in (anchors, rows))
        order = _by_id(own["vec_id"].combine_chunks(), own["i"].to_numpy())
        own = own.take(pa.array(order))
        self.ai, self.alabel, self.ri, self.rlabel = (side[c].to_numpy() for side in (first, own) for c in ("i", "label"))
        self.aid, self.rid = (side["vec_id"].combine_chunks() for side in (first, own))
        self.wanted = first["wanted"] if "wanted" in first.column_names else None
        part = lambda side, c: _matrix(side.filter(pc.equal(side["chunk"], c)))
        self.chunks = [(part(anchors, c), part(rows, c)[order]) for c in pc.unique(rows["chunk"]).to_pylist()]

    def stripes(self) -> Iterator[tuple[np.ndarray, Stripe]]:
        """Numbers of anchors and their scores, chunk added to chunk."""
        for at in range(0, len(self.ai), STRIPE):
            total = np.zeros((len(self.ai[at : at + STRIPE]), len(self.ri)), np.int64)
            for a, b in self.chunks:
                total += _product(a[at : at + STRIPE], b)
            yield np.arange(at, at + len(total)), Stripe(total)


def sides(v: DataFrame, anchors: DataFrame, counts: tuple[int, int, int], most_anchors: int, most_rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows by chunk, as often as tiles ask for them; counts: of anchors, rows and dimensions.

    What else anchors have rides on their first chunk.
    """
    na, nr, chunks = (max(1, -(-n // most)) for n, most in zip(counts, (most_anchors, most_rows, width)))
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = F.slice("v", F.col("chunk") * width + 1, F.lit(width)).alias("part")
    more = [F.when(F.col("chunk") == 0, F.col(c)).alias(c) for c in anchors.columns if c not in v.columns]
    cut = lambda df, *own: df.withColumn("chunk", every(chunks)).select("ablock", "rblock", "chunk", "i", "vec_id", "label", part, *own)
    left = cut(anchors.withColumn("ablock", block(na, 1)).withColumn("rblock", every(nr)), *more)
    right = cut(v.withColumn("rblock", block(nr, 2)).withColumn("ablock", every(na)))
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table: columns of their own


def over_tiles(left: DataFrame, right: DataFrame, told: Callable[[Tile], list[list]], names: str) -> DataFrame:
    """What is told of each tile: columns of whole numbers."""
    columns = names.split()

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = told(Tile(anchors, rows)) if len(anchors) and len(rows) else [[] for _ in columns]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=columns)

    return left.groupBy("ablock", "rblock").cogroup(right.groupBy("ablock", "rblock")).applyInArrow(run, ", ".join(f"{c} long" for c in columns))


def _by_id(rid: pa.Array, ri: np.ndarray) -> np.ndarray:
    """Rows by rising id (null last), then number; a stable sort by score keeps it among ties."""
    return np.lexsort((ri, rid.fill_null(0).to_numpy(zero_copy_only=False), rid.is_null().to_numpy(zero_copy_only=False)))


def _best(v: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "i")
    return v.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def positives(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """anchor (its number), rank, i, id, score."""

    def told(t: Tile) -> list[list]:
        out: list[list] = [[] for _ in range(4)]
        for js, stripe in t.stripes():
            keys = np.where((t.rlabel == t.alabel[js, None]) & (t.ri != t.ai[js, None]), stripe.keys, NONE)
            if most < keys.shape[1]:
                keys = np.partition(keys, most - 1, axis=1)[:, :most]
            row, column = np.nonzero(keys < NONE)
            places, scores = stripe.read(keys[row, column])
            for values, more in zip(out, (t.ai[js[row]], t.ri[places], t.rid.take(pa.array(places)).to_pylist(), scores)):
                values.extend(more)
        return out

    return _best(over_tiles(left, right, told, "anchor i id score"), ["anchor"], most)


def negatives(left: DataFrame, right: DataFrame, most: int, least_share: int, most_share: int) -> DataFrame:
    """anchor, anchor_id, positive, positive_id, positive_score, rank, i, id, score; left has the positives wanted."""

    def told(t: Tile) -> list[list]:
        out: list[list] = [[] for _ in range(8)]
        for js, stripe in t.stripes():
            falling = np.sort(np.where(t.rlabel != t.alabel[js, None], stripe.keys, NONE), axis=1)
            for j, keys in zip(js, falling):
                for p in t.wanted[int(j)].as_py():
                    # least * positive <= 100 * negative <= most * positive, in whole numbers
                    first, end = np.searchsorted(keys, stripe.window(-(-least_share * p["score"] // 100), most_share * p["score"] // 100))
                    if first < end:
                        places, scores = stripe.read(keys[first : min(end, first + most)])
                        own = (t.ai[j], t.aid[int(j)].as_py(), p["i"], p["id"], p["score"])
                        for values, more in zip(out, (*([x] * len(places) for x in own), t.ri[places], t.rid.take(pa.array(places)).to_pylist(), scores)):
                            values.extend(more)
        return out

    return _best(over_tiles(left, right, told, "anchor anchor_id positive positive_id positive_score i id score"), ["anchor", "positive"], most)


def mine(table: DataFrame, every: int = 100, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, most_anchors: int = ANCHORS, most_rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    stash = Stash(table.sparkSession, "negatives")
    v = stash.keep(vectors(table))
    anchors = v.filter(F.col("vec_id") % every == 0)
    n, dims = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    fit = max(1, CELLS // max(1, dims))
    how = (anchors.count(), n, dims), min(most_anchors, fit), min(most_rows, fit), width
    found = positives(*sides(v, anchors, *how), n_positives)
    wanted = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "i", "id", "score"))).alias("wanted"))
    asked = stash.keep(anchors.join(wanted, F.col("i") == F.col("anchor")).drop("anchor"))
    hard = negatives(*sides(v, asked, *how), n_negatives, least, most)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""

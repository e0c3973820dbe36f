"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the axis, with its
sign, that it then lies nearest to. Two hashes name a bucket of a table. A vector is posted to its own bucket of each
table and, as probes, to those next in line, and candidates are checked exactly.

First, vectors are drawn together into *balls*, narrow enough (at most ten degrees around a member) that any two members
are surely linked. A ball goes through the tables once, so a group of very many near copies costs a few rows there,
and its links are counted by multiplication: between two balls whose angle and radii settle it, all pairs are linked or none.
What is not settled so is counted member by member, in blocks.

The centres of two balls with linked members may lie apart by the least similarity's angle and both radii. The wider a ball,
the more tables it is posted to, as many as balls at that angle need to meet in one. How wide balls may become follows from
that: as wide as keeps the tables few, which is narrower where vectors are longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import spread_join
from pulsegrid.llm.components import components
from pulsegrid.llm.vectors import by_length, matrix, runs, usable
from pulsegrid.session import cut_lineage

TABLES, PROBES, ROUNDS, SALTS = 8, 4, 3, 64
#: The share of pairs at the widest angle that may meet in none of their tables, and how many tables are worth a wider ball.
MISS, WORTH = 5e-4, 60
#: More than the tables there can be: a bucket's number and its table's make one key.
KEYS = 1 << 20
#: Degrees between the radii for which a number of tables is worked out, and how many pairs and tables are tried for it.
STEP, TRIED = 2.5, (250, 4)
#: Degrees: the angles that balls may reach from their centres, widest first. Under half the angle of the least similarity.
BALLS, MARGIN = (10.0, 7.5, 5.0, 2.5, 1.0), 1e-5
#: Rows of a bucket that meet in one group; a larger bucket is cut into blocks that meet in pairs.
MEET, MEMBERS = 2048, 1024
SKETCH_BITS = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of rows whose length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), -1, 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows padded with zeros to a power of two and turned at random; the same for a seed."""
    size = 1 << max(1, int(np.ceil(np.log2(max(2, x.shape[1])))))
    signs = np.random.default_rng([20, seed]).choice([-1.0, 1.0], (3, size))
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
    """Bucket numbers of unit vectors in a table, the own one first, then the likeliest others: rows x probes."""
    first, second = turned(x, 2 * table), turned(x, 2 * table + 1)
    size, axes, loss = first.shape[1], [], []
    for z in (first, second):
        top = np.argsort(-np.abs(z), axis=1, kind="stable")[:, :min(3, size)]
        value = np.take_along_axis(z, top, axis=1)
        axes.append(top + size * (value < 0))
        loss.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
    both = (axes[0][:, :, None] * (2 * size) + axes[1][:, None, :]).reshape(len(x), -1)
    cost = (loss[0][:, :, None] + loss[1][:, None, :]).reshape(len(x), -1)
    order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(both, order, axis=1).astype(np.int64)


def sketches(x: np.ndarray) -> np.ndarray:
    """Signs of ``SKETCH_BITS`` random directions, two words a row."""
    size = turned(x[:1], 0).shape[1]
    z = np.concatenate([turned(x, 1000 + i) for i in range(-(-SKETCH_BITS // size))], axis=1)[:, :SKETCH_BITS]
    return np.packbits(z > 0, axis=1).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def angles(cosine: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(cosine, -1, 1)))


def _led(ball_angle: float):
    """Balls in order of bucket to ``(ball, leader, reach)``: the first ball of a bucket leads those it can take in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = leader = centre = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, ball, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            radius = batch.column(3).to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            if key is not None and k[0] == key:
                new[0] = False
                ball_of, x_of = np.concatenate([[leader], ball]), np.concatenate([centre, x])
            else:
                ball_of, x_of = np.concatenate([[0], ball]), np.concatenate([x[:1], x])
            head = np.maximum.accumulate(np.where(new, np.arange(1, len(k) + 1), 0))
            reach = angles(cosines(x, x_of[head])) + radius
            takes = (reach <= ball_angle) & (ball_of[head] != ball)
            key, leader, centre = k[-1], ball_of[head[-1]], x_of[head[-1]][None]
            yield pa.RecordBatch.from_arrays([pa.array(ball), pa.array(np.where(takes, ball_of[head], ball)), pa.array(np.where(takes, reach, radius))],
                                             names=["ball", "leader", "reach"])

    return run


def draw_together(balls: DataFrame, round: int, ball_angle: float) -> tuple[DataFrame, DataFrame]:
    """One round over ``(ball, centre, radius, n, least)``: the map ``(ball, leader)`` and the balls that are left.

    Buckets of the first round are cut by a hash of the ball into ``SALTS``, so that a group of any size is spread over
    tasks; what is left of it after that is a few rows.
    """
    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                key = buckets(unit(matrix(batch.column("centre"))), 100 + round)[:, 0]
                if not round:
                    key = key * SALTS + batch.column("salt").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("ball", "centre", "radius"))],
                                                 names=["key", "ball", "centre", "radius"])

    rows = balls.select("ball", "centre", "radius", F.pmod(F.xxhash64("ball"), F.lit(SALTS)).alias("salt"))
    led = cut_lineage(rows.mapInArrow(keyed, "key long, ball long, centre array<float>, radius double")
                      .repartition("key").sortWithinPartitions("key", "ball").mapInArrow(_led(ball_angle), "ball long, leader long, reach double"), "led")
    facts = balls.select("ball", "n", "least").join(led, "ball").groupBy(F.col("leader").alias("ball")).agg(
        F.max("reach").alias("radius"), F.sum("n").alias("n"), F.min("least").alias("least"))
    left = cut_lineage(balls.select("ball", "centre").join(facts, "ball").select("ball", "centre", "radius", "n", "least"), "balls")
    return led.select("ball", "leader"), left


def tables_needed(size: int, angle: float) -> int:
    """How many tables vectors of ``size`` places at an angle of ``angle`` degrees need, tried out on random pairs; ``TABLES`` at least."""
    if size < 2:
        return TABLES
    rng = np.random.default_rng([21, size])
    x, y = unit(rng.standard_normal((TRIED[0], size))), rng.standard_normal((TRIED[0], size))
    y = unit(y - (x * y).sum(axis=1)[:, None] * x)
    y = x * np.cos(np.radians(angle)) + y * np.sin(np.radians(angle))
    met = 0.0
    for t in range(TRIED[1]):
        a, b = buckets(x, t, PROBES), buckets(y, t, PROBES)
        met += ((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean() / TRIED[1]
    if met >= 1:
        return TABLES
    # Pairs of which none met are taken to meet half as often as could just have been seen.
    met = met or 0.5 / (TRIED[0] * TRIED[1])
    return max(TABLES, int(np.ceil(np.log(MISS) / np.log1p(-met))))


def ball_angle(size: int, limit: float) -> float:
    """The widest of ``BALLS`` whose balls are worth their tables, for vectors of ``size`` places; the narrowest, if none is."""
    return next((b for b in BALLS if tables_needed(size, limit + 2 * b) <= WORTH), BALLS[-1])


def _posted(tables: list[int]):
    """Balls to ``(key, own, ball, s1, s2, radius)``, one row a table and probe; a ball of radius r takes part in
    ``tables[ceil(r / STEP)]`` tables."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("centre")))
                words, ball, radius = sketches(x), batch.column("ball").to_numpy(), batch.column("radius").to_numpy()
                needed = np.array(tables)[np.ceil(radius / STEP).astype(np.int64)]
                for t in range(needed.max()):
                    i = np.flatnonzero(needed > t)
                    b = buckets(x[i], t, PROBES)
                    for p in range(b.shape[1]):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(b[:, p] * KEYS + t), pa.array(np.full(len(i), p == 0)), pa.array(ball[i]), pa.array(words[i, 0]),
                            pa.array(words[i, 1]), pa.array(radius[i])], names=["key", "own", "ball", "s1", "s2", "radius"])

    return run


def _met(least_angle: float):
    """Groups ``(key, i, j)`` of posted rows to candidate pairs ``(a, b)`` of balls, a < b, by their sketches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            if table.num_rows < 2:
                continue
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            own, ball, block = table["own"].to_numpy(), table["ball"].to_numpy(), table["block"].to_numpy()
            # Unsigned, as bits of a negative number are counted without its sign.
            s, radius = np.stack([table["s1"].to_numpy(), table["s2"].to_numpy()]).view(np.uint64), table["radius"].to_numpy()
            left = np.flatnonzero(block == i)
            right = np.flatnonzero(block == j)
            for at in range(0, len(left), 256):
                l = left[at:at + 256]  # noqa: E741
                differ = sum(np.bitwise_count(w[l][:, None] ^ w[right][None, :]).astype(np.int64) for w in s)
                p = np.minimum(0.5, (least_angle + radius[l][:, None] + radius[right][None, :]) / 180)
                near = (differ <= SKETCH_BITS * p + 6 * np.sqrt(SKETCH_BITS * p * (1 - p))) & (own[l][:, None] | own[right][None, :])
                a, b = np.nonzero(near)
                a, b = ball[l][a], ball[right][b]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
                if pairs.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0].copy()), pa.array(pairs[1].copy())], names=["a", "b"])

    return run


def candidate_pairs(balls: DataFrame, least_angle: float) -> DataFrame:
    """Distinct pairs ``(a, b)`` of balls that share a bucket and whose sketches allow a link between them."""
    facts = balls.agg(F.max("radius"), F.max(F.size("centre"))).first()
    widest, size = facts[0] or 0.0, facts[1] or 1
    tables = [tables_needed(size, least_angle + widest + min(widest, i * STEP)) for i in range(int(np.ceil(widest / STEP)) + 1)]
    posted = cut_lineage(balls.select("ball", "centre", "radius").mapInArrow(
        _posted(tables), "key long, own boolean, ball long, s1 long, s2 long, radius double"), "posted")
    large = posted.groupBy("key").count().where(F.col("count") > MEET).select("key", F.ceil(F.col("count") / MEET).cast("int").alias("blocks"))
    cut = (posted.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
           .withColumn("block", F.pmod(F.xxhash64("ball"), "blocks").cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    groups = cut.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "ball", "s1", "s2", "radius")
    return (groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_met(least_angle), "a long, b long").distinct())


def _settled(least: float):
    """Pairs with both balls' columns to ``(a, b, n_a, n_b, all)``: true if all members are linked, null if some may be."""
    limit = float(angles(np.array([least]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = cosines(matrix(batch.column("centre_a")), matrix(batch.column("centre_b")))
            reach = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            angle = angles(cosine)
            single = reach == 0
            every = np.where(single, cosine >= least, angle + reach <= limit - MARGIN)
            none = np.where(single, cosine < least, angle - reach > limit + MARGIN)
            keep = pa.array(~none)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("a", "b", "n_a", "n_b")),
                                              pa.array(every[~none], mask=~every[~none])], names=["a", "b", "n_a", "n_b", "all"])

    return run


def _counted(least: float):
    """Groups ``(a, b, i, j)`` of members of two balls to ``(a, b, id, n)``: how many of the other side each is linked to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 4):
            side, ids, x = table["side"].to_numpy(), table["id"].to_numpy(), matrix(table["v"].combine_chunks())
            norm = np.sqrt((x * x).sum(axis=1))
            linked = (x[side == 0] @ x[side == 1].T) / (norm[side == 0][:, None] * norm[side == 1][None, :]) >= least
            n = np.zeros(len(ids), np.int64)
            n[side == 0], n[side == 1] = linked.sum(axis=1), linked.sum(axis=0)
            hit = n > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), table[c][0].as_py())) for c in ("a", "b")] + [
                    pa.array(ids[hit]), pa.array(n[hit])], names=["a", "b", "id", "n"])

    return run


def near_duplicates(table: DataFrame, least: float = 0.9, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``table``: ``(<id>, n_links, component_id, kept)``.

    ``n_links`` counts the other vectors found with a cosine of at least ``least``, ``component_id`` is the smallest id
    reachable by links, itself included, and ``kept`` says that it is the row's own. Vectors that take no part (see
    ``vectors.usable``) link with nothing and are their own component; only vectors of one length can be linked; repeats of an id are
    one vector and repeat its row; a row without an id has a null component and isn't kept. Twice the widest of ``BALLS`` must be
    less than the angle of ``least``, else an error.
    """
    limit = float(angles(np.array([least]))[0])
    if 2 * BALLS[0] >= limit:
        raise ValueError("the balls are too wide for this similarity")
    found = reduce(DataFrame.union, [_linked(part, least, limit) for part in by_length(cut_lineage(usable(table, id, vector), "vectors"))])
    rows = table.select(id).join(found, F.col(id) == F.col("__of"), "left")
    component = F.coalesce("component_id", F.col(id))
    return rows.select(id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                       F.coalesce(F.col(id) == component, F.lit(False)).alias("kept"))


def _linked(members: DataFrame, least: float, limit: float) -> DataFrame:
    """``(__of, n_links, component_id)`` of vectors ``(id, v)`` of one length."""
    size = members.agg(F.max(F.size("v"))).first()[0] or 1
    widest = ball_angle(size, limit)
    balls = members.select(F.col("id").alias("ball"), F.col("v").cast("array<float>").alias("centre"), F.lit(0.0).alias("radius"),
                           F.lit(1).cast("long").alias("n"), F.col("id").alias("least"))
    into, balls = draw_together(balls, 0, widest)
    later = None
    for r in range(1, ROUNDS):
        step, balls = draw_together(balls, r, widest)
        later = step if later is None else later.withColumnRenamed("leader", "mid").join(
            step.withColumnRenamed("ball", "mid"), "mid").select("ball", "leader")
    # A ball of the first round is at most one SALTS-th of a group; the map of the later rounds has a row a ball.
    into = cut_lineage(into.withColumnRenamed("leader", "mid").join(later.withColumnRenamed("ball", "mid"), "mid")
                       .select(F.col("ball").alias("id"), F.col("leader").alias("ball"), F.col("mid").alias("first")), "members")
    side = lambda s: balls.select(F.col("ball").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("centre", "radius", "n")])
    pairs = cut_lineage(candidate_pairs(balls, limit).join(side("a"), "a").join(side("b"), "b")
                        .mapInArrow(_settled(least), "a long, b long, n_a long, n_b long, all boolean"), "pairs")
    open_ = pairs.where(F.col("all").isNull())
    chunks = lambda n: F.ceil(F.col(n) / MEMBERS).cast("int")
    vectors = members.join(into, "id").select("id", "v", "ball")

    def of(s: str, i: str, j: str, n: int):
        other = "b" if s == "a" else "a"
        rows = open_.join(vectors.withColumnRenamed("ball", s), s)
        return rows.select("a", "b", F.pmod(F.xxhash64("id"), chunks(f"n_{s}")).cast("int").alias(i), F.explode(
            F.sequence(F.lit(0), chunks(f"n_{other}") - 1)).alias(j), F.lit(n).alias("side"), "id", "v").select("a", "b", "i", "j", "side", "id", "v")

    counted = cut_lineage(of("a", "i", "j", 0).union(of("b", "j", "i", 1)).repartition("a", "b", "i", "j")
                          .sortWithinPartitions("a", "b", "i", "j", "side").mapInArrow(_counted(least), "a long, b long, id long, n long"), "counted")
    whole = pairs.where("all")
    edges = whole.select("a", "b").union(counted.select("a", "b").distinct())
    roots = components(edges, "embedding-components")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("n_b").alias("more")).union(whole.select("b", "n_a")).groupBy("ball").agg(F.sum("more").alias("more"))
    rooted = balls.select("ball", "n", "least").join(roots.withColumnRenamed("node", "ball"), "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    least_of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = cut_lineage(rooted.join(least_of, "root").join(by_ball, "ball", "left").select(
        "ball", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links")), "ball-facts")
    extra = counted.groupBy("id").agg(F.sum("n").alias("extra"))
    return (spread_join(into.select("id", "ball"), facts, "ball", F.col("id")).join(extra, "id", "left")
             .select(F.col("id").alias("__of"), (F.col("links") + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id"))

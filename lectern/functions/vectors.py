"""Vectors as arrays of float: products, pairs by tiles, exact neighbours by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block in blocked similarity; a pair of blocks is a task's work.
BLOCK_ROWS = 2048
#: Centres of near vectors at most: the driver holds them, and each task.
MOST_CENTRES = 2048
#: Stripes that vectors are dealt to, unless one would hold more values than the second; pairs that a task multiplies out at once.
STRIPES, STRIPE_VALUES, TILE_PAIRS = 24, 1 << 22, 1 << 21
#: Stripes that groups of vectors are dealt to, unless one would hold more than STRIPE_VALUES values; groups on a side of a product; pairs of groups looked at together.
GROUP_STRIPES, TILE_ROWS, PAIRS_AT_ONCE = 12, 1024, 1 << 16
#: Queries that go to every task at once, and vectors that meet them at once there.
QUERIES_AT_ONCE, VECTORS_AT_ONCE = 4096, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` over its length (plus 1e-9)."""
    size = F.sqrt(dot(v, v)) + 1e-9
    return F.transform(v, lambda x: x.cast("double") / size)


def _reach(vectors: DataFrame, vector: str, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radii, sizes) of blocks of near vectors: the centres are vectors of a bounded sample, each vector is in the block of its nearest centre."""
    centres = np.array([r[0] for r in vectors.select(vector).orderBy(F.xxhash64(vector)).limit(blocks).collect()], np.float64)
    centres = np.unique(centres, axis=0)

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most, n = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for batch in batches:
            block, away = _block_of(batch["v"], centres)
            np.maximum.at(most, block, away)
            n += np.bincount(block, minlength=len(centres))
        yield pd.DataFrame({"block": np.arange(len(centres)), "r": most, "n": n})

    rows = vectors.select(F.col(vector).alias("v")).mapInPandas(far, "block int, r double, n long").groupBy("block").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect()
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in rows:
        radii[r["block"]], sizes[r["block"]] = r["r"], r["n"]
    return centres, radii, sizes


def _block_of(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it) of each vector."""
    v = np.stack(vectors.to_list()).astype(np.float64)
    square = np.maximum((v * v).sum(1)[:, None] + (centres * centres).sum(1) - 2 * v @ centres.T, 0)
    block = square.argmin(1)
    return block, np.sqrt(square[np.arange(len(v)), block])


def _stripes(sizes: np.ndarray, centres: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts of each block, where its parts begin in the third, stripe of each part): stripes hold some ``rows`` vectors of blocks that lie near."""
    parts = np.maximum(1, -(-sizes // rows))
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    order = np.argsort(centres @ axis, kind="stable")
    place = np.concatenate([first[b] + np.arange(parts[b]) for b in order])
    size = np.repeat(sizes[order] / parts[order], parts[order])
    stripe = np.zeros(len(place), np.int64)
    stripe[place] = (np.cumsum(size) - size / 2) // rows
    return parts, first, stripe


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, stripe_rows: int | None = None) -> DataFrame:
    """All pairs a < b of unit vectors with cosine >= ``least``: (a, b, cosine).

    Exact, by tiles: near vectors share a block of some ``block_rows`` (at most MOST_CENTRES of them), and two blocks meet as a matrix product
    only if their centres and radii let a pair reach ``least``: unit vectors of cosine c are sqrt(2 - 2 c) apart. Near blocks share a stripe,
    a large one is dealt to several; a task has two stripes, so a vector crosses the network some STRIPES times, whatever their number, until a stripe
    holds STRIPE_VALUES values. A task yields its pairs piece by piece, and only those over the threshold. Vectors that are
    all alike, or a low ``least``, leave all tiles; the higher ``least``, the fewer.
    """
    n = vectors.count()
    centres, radii, sizes = _reach(vectors, vector, min(MOST_CENTRES, max(1, -(-n // block_rows)))) if n else (np.zeros((1, 1)), np.zeros(1), np.zeros(1, np.int64))
    near = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-6  # stored vectors are unit ones but for rounding
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(-1), 0)) if len(centres) <= 512 else np.stack([np.sqrt(((centres - c) ** 2).sum(1)) for c in centres])
    meets = apart - radii[:, None] - radii[None] <= near
    rows_ = stripe_rows or max(block_rows, min(-(-n // STRIPES), STRIPE_VALUES // centres.shape[1]))
    parts, first, stripe_of = _stripes(sizes, centres, rows_)

    @F.pandas_udf("struct<home:int,stripe:int>")
    def placed(v: pd.Series, h: pd.Series) -> pd.DataFrame:
        home = _block_of(v, centres)[0] if len(v) else np.zeros(0, np.int64)
        return pd.DataFrame({"home": home.astype(np.int32), "stripe": stripe_of[first[home] + h.to_numpy() % parts[home]].astype(np.int32)})

    # stripes meet where any of their blocks do
    count = int(stripe_of.max()) + 1
    holds = np.zeros((count, len(centres)), bool)
    holds[stripe_of, np.repeat(np.arange(len(centres)), parts)] = True
    both = (holds.astype(np.float32) @ meets.astype(np.float32) @ holds.T.astype(np.float32)) > 0
    links = vectors.sparkSession.createDataFrame([(i, np.flatnonzero(both[i]).tolist()) for i in range(count)], "stripe int, others array<int>")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("at", placed("v", F.xxhash64("id"))).select("id", "v", "at.home", "at.stripe")
    rows = rows.join(F.broadcast(links), "stripe").withColumn("other", F.explode("others"))
    tiles = rows.select("id", "v", "home", (F.col("stripe") <= F.col("other")).alias("left"), F.least("stripe", "other").alias("i"), F.greatest("stripe", "other").alias("j"))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["id"].to_numpy(), np.stack(b["v"].to_list()), b["home"].to_numpy(), b["left"].to_numpy(bool), (b["i"] == b["j"]).to_numpy()) for b in batches if len(b)]
        ids, v, home, left, alone = (np.concatenate(x) for x in zip(*held, strict=True))
        same = bool(alone[0])
        mine, theirs = np.flatnonzero(left), np.arange(len(ids)) if same else np.flatnonzero(~left)
        mine = mine[np.argsort(home[mine], kind="stable")]
        for b in np.unique(home[mine]):
            y = theirs[meets[b][home[theirs]]]
            x = mine[home[mine] == b]
            matrix = v[y].astype(np.float64).T
            for lo in range(0, len(x) if len(y) else 0, max(1, TILE_PAIRS // len(y))):
                part = x[lo : lo + max(1, TILE_PAIRS // len(y))]
                s = v[part].astype(np.float64) @ matrix
                r, c = np.nonzero(s >= least)
                one, two = ids[part[r]], ids[y[c]]
                ok = one < two if same else one != two
                if ok.any():
                    yield pd.DataFrame({"a": np.minimum(one, two)[ok], "b": np.maximum(one, two)[ok], "cosine": s[r, c][ok]})

    return tiles.groupBy("i", "j").applyInPandas(pairs, "a long, b long, cosine double")


def _members(starts: np.ndarray, size: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the pair, row, row) of all pairs of members of pairs of groups, and where a pair's begin."""
    n = size[one].astype(np.int64) * size[two]
    first = np.cumsum(n) - n
    k = np.repeat(np.arange(len(one)), n)
    at = np.arange(len(k)) - first[k]
    return k, starts[one][k] + at // size[two][k], starts[two][k] + at % size[two][k], first


def _range(v: np.ndarray, starts: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, highest) cosine of the members of each pair of groups, in single precision."""
    low, high = np.empty(len(p), np.float32), np.empty(len(p), np.float32)
    for lo in range(0, len(p), PAIRS_AT_ONCE):
        to = slice(lo, lo + PAIRS_AT_ONCE)
        _, i, j, first = _members(starts, size, p[to], q[to])
        s = np.concatenate([np.einsum("ij,ij->i", v[i[x : x + PAIRS_AT_ONCE]], v[j[x : x + PAIRS_AT_ONCE]]) for x in range(0, len(i), PAIRS_AT_ONCE)])
        low[to], high[to] = np.minimum.reduceat(s, first), np.maximum.reduceat(s, first)
    return low, high


def _exact(ids: np.ndarray, v: np.ndarray, starts: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(p, q, weight, a, b) of those pairs of groups (numbers ``p``, ``q``) of which all members have a cosine of ``least``, with their best edge."""
    out = []
    for lo in range(0, len(p), PAIRS_AT_ONCE):
        one, two = p[lo : lo + PAIRS_AT_ONCE], q[lo : lo + PAIRS_AT_ONCE]
        k, i, j, first = _members(starts, size, one, two)
        s = np.concatenate([np.einsum("ij,ij->i", v[i[x : x + PAIRS_AT_ONCE]].astype(np.float64), v[j[x : x + PAIRS_AT_ONCE]].astype(np.float64)) for x in range(0, len(i), PAIRS_AT_ONCE)])
        some = np.flatnonzero((np.minimum.reduceat(s, first) >= least)[k])
        k, weight, i, j = k[some], np.round(s[some], 9), ids[i[some]], ids[j[some]]
        a, b = np.minimum(i, j), np.maximum(i, j)
        if len(k) and (k[1:] == k[:-1]).any():
            top = np.lexsort((b, a, -weight, k))
            top = top[np.r_[True, k[top][1:] != k[top][:-1]]]
            k, weight, a, b = k[top], weight[top], a[top], b[top]
        out.append((one[k], two[k], weight, a, b))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (p, q, np.zeros(0), p, q)


def _meet(ids, v, g, size, cell, left, same: bool, least: float, most: int, take) -> Iterator[pd.DataFrame]:
    """What ``take`` gives for the groups of two stripes (``left`` tells which), or of one (``same``), by rows (id, vector, group, size, cell)."""
    order = np.lexsort((ids, g, size))
    ids, v, g = ids[order], v[order], g[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    names, size, cell, left = g[starts], size[order][starts], cell[order][starts], left[order][starts]
    mean = np.add.reduceat(v, starts, axis=0, dtype=np.float64) / size[:, None]
    single = v.astype(np.float32)
    slack = (v.shape[1] + 8) * 2.0**-23 * max(1.0, float(np.einsum("ij,ij->i", single, single).max()))
    mean, seen = mean.astype(np.float32), take(names, size, cell)
    mine, theirs = np.flatnonzero(left), np.arange(len(names)) if same else np.flatnonzero(~left)
    x_mean, y_mean, low = mean[mine], mean[theirs], np.float32(least - slack)
    for lo in range(0, len(mine), TILE_ROWS):
        hi = min(len(mine), lo + TILE_ROWS)
        fit = int(np.searchsorted(size[theirs], most - size[mine[lo]], "right"))  # smaller groups come first
        for begin in range(lo if same else 0, fit, TILE_ROWS):
            end = min(fit, begin + TILE_ROWS)
            s = x_mean[lo:hi] @ y_mean[begin:end].T
            if same and begin < hi:  # of its own stripe a group meets those after it
                s[np.arange(begin, end) <= np.arange(lo, hi)[:, None]] = -np.inf
            near = s >= low
            n = np.count_nonzero(near)
            seen.live += n
            if n == 0:
                continue
            alone = size[mine[hi - 1]] == 1 and size[theirs[end - 1]] == 1
            if alone and (bar := seen.bar(mine[lo:hi], theirs[begin:end], slack)) > low:
                near = s >= bar
            at = np.flatnonzero(near)
            p, q = mine[lo + at // (end - begin)], theirs[begin + at % (end - begin)]
            ok = np.flatnonzero((size[p] + size[q] <= most) & seen.wanted(p, q))
            p, q = p[ok], q[ok]
            if alone:
                lowest = highest = s.ravel()[at[ok]]
            else:
                lowest, highest = _range(single, starts, size, p, q)
            ok = seen.close(p, q, lowest, highest, least, slack)
            p, q = p[ok], q[ok]
            if len(p) and (out := seen.see(*_exact(ids, v, starts, size, p, q, least))) is not None:
                yield out
    yield seen.rest()


def _group_tiles(rows: DataFrame, least: float, most: int, take, schema: str, stripes: int) -> DataFrame:
    """Groups of ``rows`` (id, v, g, size, cell) meet once each: a group lies in one of ``stripes``, a task has two of them, so a vector crosses the network ``stripes`` times.

    Two groups fit if all their pairs have a cosine of ``least`` and they have at most ``most`` members together. If so, their means
    have a product of ``least`` too: those are multiplied in single precision, and only what reaches ``least`` but for rounding is looked at
    vector by vector. ``take`` makes an object for each task from (names, sizes, cells) of its groups: ``wanted`` leaves numbers of groups
    out, ``see`` gets pairs that fit, with their best edge (weight, a, b), and may give a frame, ``rest`` gives the last one.
    """
    others = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))
    dealt = rows.withColumn("stripe", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(stripes)).cast("int")).withColumn("other", others)
    tiles = dealt.select("id", "v", "g", "size", "cell", (F.col("stripe") <= F.col("other")).alias("left"), F.least("stripe", "other").alias("i"), F.greatest("stripe", "other").alias("j"))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(b["id"].to_numpy(), np.stack(b["v"].to_list()), b["g"].to_numpy(), b["size"].to_numpy(), b["cell"].to_numpy(), b["left"].to_numpy(bool), (b["i"] == b["j"]).to_numpy()) for b in batches if len(b)]
        ids, v, g, size, cell, left, alone = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        yield from _meet(ids, v, g, size, cell, left, bool(alone[0]), least, most, take)

    return tiles.repartition(2 * stripes * (stripes + 1), "i", "j").groupBy("i", "j").applyInPandas(met, schema)


class _Strongest:
    """Of each group the strongest edge to a group of another cell that fits, and how many pairs may fit, in any cell."""

    def __init__(self, names: np.ndarray, size: np.ndarray, cell: np.ndarray):
        self.names, self.cell, self.live = names, cell, 0
        self.weight, self.a, self.b = np.full(len(names), -np.inf), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        self.about = np.full(len(names), -np.inf, np.float32)

    def bar(self, mine: np.ndarray, theirs: np.ndarray, slack: float) -> np.float32:
        """What a product of single vectors must reach to be of use to any of these."""
        return np.float32(min(self.about[mine].min(), self.about[theirs].min()) - 3 * slack)

    def wanted(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.cell[p] != self.cell[q]

    def close(self, p: np.ndarray, q: np.ndarray, lowest: np.ndarray, highest: np.ndarray, least: float, slack: float) -> np.ndarray:
        """Which pairs can fit and be the strongest of either, by the products of their members but for rounding."""
        sure = np.flatnonzero(lowest >= least + slack)
        np.maximum.at(self.about, p[sure], highest[sure])
        np.maximum.at(self.about, q[sure], highest[sure])
        return np.flatnonzero((lowest >= least - slack) & (highest >= np.minimum(self.about[p], self.about[q]) - 3 * slack))

    def see(self, p, q, weight, a, b) -> None:
        for code in (p, q):
            near = np.flatnonzero(weight >= self.weight[code])
            near = near[np.lexsort((b[near], a[near], -weight[near], code[near]))]
            c = code[near]
            near = near[np.r_[True, c[1:] != c[:-1]]] if len(near) else near
            c, w, x, y = code[near], weight[near], a[near], b[near]
            better = (w > self.weight[c]) | (x < self.a[c]) | ((x == self.a[c]) & (y < self.b[c]))
            c = c[better]
            self.weight[c], self.a[c], self.b[c] = w[better], x[better], y[better]

    def rest(self) -> pd.DataFrame:
        has = np.isfinite(self.weight)
        has[0] = True  # that row tells how many there are
        has = np.flatnonzero(has)
        live = np.zeros(len(has), np.int64)
        live[0] = self.live
        return pd.DataFrame({"g": self.names[has], "weight": self.weight[has], "a": self.a[has], "b": self.b[has], "live": live})


class _Every:
    """All pairs of groups that fit."""

    def __init__(self, names: np.ndarray, size: np.ndarray, cell: np.ndarray):
        self.names, self.size, self.live = names, size, 0

    def bar(self, mine, theirs, slack) -> float:
        return -np.inf

    def wanted(self, p, q) -> np.ndarray:
        return np.ones(len(p), bool)

    def close(self, p, q, lowest, highest, least, slack) -> np.ndarray:
        return np.flatnonzero(lowest >= least - slack)

    def see(self, p, q, weight, a, b) -> pd.DataFrame:
        one, two = self.names[p], self.names[q]
        turned = one > two
        n, m = self.size[p], self.size[q]
        return pd.DataFrame({"g": np.where(turned, two, one), "h": np.where(turned, one, two), "weight": weight, "a": a, "b": b, "n_g": np.where(turned, m, n), "n_h": np.where(turned, n, m)})

    def rest(self) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        return self.see(none, none, np.zeros(0), none, none)


def group_stripes(n: int, width: int, block_rows: int = BLOCK_ROWS) -> int:
    """Stripes for ``n`` vectors of ``width`` values: few where there are few, for each sends all vectors once more."""
    return max(1, min(GROUP_STRIPES, -(-n // (4 * block_rows))), -(-n * width // STRIPE_VALUES))


def strongest_partners(rows: DataFrame, least: float, most: int, stripes: int) -> DataFrame:
    """(g, weight, a, b, live) of each task: a group of ``rows`` (id, v, g, size, cell) with its strongest edge to one of another cell that fits (weight -inf: none).

    ``live`` adds up to no less than the number of pairs of groups that fit, whatever their cells.
    """
    return _group_tiles(rows, least, most, _Strongest, "g long, weight double, a long, b long, live long", stripes)


def fitting_groups(rows: DataFrame, least: float, most: int, stripes: int) -> DataFrame:
    """(g, h, weight, a, b, n_g, n_h): all pairs g < h of groups of ``rows`` (id, v, g, size) that fit, with their strongest edge and sizes."""
    return _group_tiles(rows.withColumn("cell", F.lit(0)), least, most, _Every, "g long, h long, weight double, a long, b long, n_g int, n_h int", stripes)


def group_homes(rows: DataFrame, n: int, cell_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(g, size, home) of the groups of ``rows`` (id, v, g, size), ``n`` vectors, and the number of homes: the nearest centre of the vector that names the group."""
    sample = rows.select("v").orderBy(F.xxhash64("v"), "id").limit(min(MOST_CENTRES, -(-2 * n // cell_rows))).collect()
    centres = np.unique(np.array([r[0] for r in sample], np.float64), axis=0)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series((_block_of(v, centres)[0] if len(v) else np.zeros(0)).astype(np.int32))

    return rows.filter("id = g").select("g", "size", home("v").alias("home")), len(centres)


def _both(one: np.ndarray, two: np.ndarray, none: int) -> np.ndarray:
    """Ranks of the edges of two groups that are one now: the better, where both fit."""
    return np.where((one < none) & (two < none), np.minimum(one, two), none)


def merged_in_cells(rows: DataFrame, least: float, most: int) -> DataFrame:
    """Of each group of ``rows`` (id, v, g, size, held, cell, weight, a, b) what becomes of it by edges within its cell: (g, new, size, near, weight, a, b).

    ``weight, a, b`` is its strongest edge out of the cell (weight -inf: none). Groups merge as in ``complete_linkage``, while the edge between them is stronger than those of either
    out of the cell; groups ``held`` don't. ``near`` is the weight of the strongest edge that is left (of a held group: that it has), null without one;
    the edge returned is the one out of the cell, if it is the strongest of a group that merged with none, else its weight is null.
    """

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["g", "id"], kind="stable")
        ids, v, g = part["id"].to_numpy(), np.stack(part["v"].to_list()).astype(np.float64), part["g"].to_numpy()
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        part = part.iloc[starts]
        names, size, held = part["g"].to_numpy(), part["size"].to_numpy().astype(np.int64), part["held"].to_numpy(bool)
        out_w, out_a, out_b = part["weight"].to_numpy(), part["a"].to_numpy(), part["b"].to_numpy()
        s = v @ v.T
        r, c = np.nonzero(np.triu(s >= least, 1))
        w, k = np.round(s[r, c], 9), np.flatnonzero(np.isfinite(out_w))
        a, b = np.minimum(ids[r], ids[c]), np.maximum(ids[r], ids[c])
        del s
        # all edges by rank: of the vectors, then of groups out of the cell
        order = np.lexsort((np.r_[b, out_b[k]], np.r_[a, out_a[k]], -np.r_[w, out_w[k]]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        weight = np.r_[w, out_w[k]][order]
        none = np.int32(len(order))
        rank = np.full((len(ids), len(ids)), none, np.int32)
        rank[r, c] = rank[c, r] = place[: len(r)]
        if len(starts) < len(ids):
            every = np.maximum.reduceat(np.maximum.reduceat(rank, starts, axis=0), starts, axis=1) < none
            rank = np.where(every, np.minimum.reduceat(np.minimum.reduceat(rank, starts, axis=0), starts, axis=1), none)
        rank[size[:, None] + size > most] = none
        outer = np.full(len(names), none, np.int32)
        outer[k] = place[len(r) :]
        now, root, whole, arg = np.arange(len(names)), np.arange(len(names)), np.ones(len(names), bool), rank.argmin(1)
        best = rank[now, arg]
        while True:
            free = (best < none) & (best < outer) & ~held
            p = np.flatnonzero(free & free[arg] & (arg[arg] == now) & (now < arg))
            q = arg[p]
            if not len(p):
                break
            again = np.isin(arg, np.r_[p, q])
            again[p] = again[q] = True
            size[p] += size[q]
            outer[p] = np.minimum(outer[p], outer[q])
            whole[p], root[q] = False, p
            rank[p], rank[q] = _both(rank[p], rank[q], none), none
            rank[:, p], rank[:, q] = _both(rank[:, p], rank[:, q], none), none
            full = size[p][:, None] + size > most
            rank[p] = np.where(full, none, rank[p])
            rank[:, p] = np.where(full.T, none, rank[:, p])
            again = np.flatnonzero(again)
            arg[again] = rank[again].argmin(1)
            best[again] = rank[again, arg[again]]
        while (root[root] != root).any():
            root = root[root]
        top = np.minimum(best, outer)[root]
        near = np.where(top < none, np.r_[weight, np.nan][top], np.nan)
        outward = whole & (root == now) & ~held & (outer < best)
        return pd.DataFrame({"g": names, "new": names[root], "size": size[root].astype(np.int32), "near": near, "weight": np.where(outward, out_w, np.nan), "a": out_a, "b": out_b})

    out = rows.groupBy("cell").applyInPandas(merged, "g long, new long, size int, near double, weight double, a long, b long")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("near", "weight")})


class Best:
    """The ``k`` highest scores of each of ``n`` queries, ties to the least id, as blocks of scores come: of a block only what reaches the k-th so far is looked at."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count, self.least = 0, np.full(n, -np.inf)

    def see(self, some: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of the queries numbered ``some`` by the rows ``ids``; -inf is none."""
        if scores.shape[1] > self.k and (fresh := ~np.isfinite(self.least[some])).any():
            # nothing is known of a query yet: its own k-th of the block is its least
            kth = np.partition(scores[fresh], -self.k, axis=1)[:, -self.k]
            self.least[some[fresh]] = np.maximum(self.least[some[fresh]], np.where(np.isfinite(kth), kth - 1e-11, -np.inf))
        r, c = np.nonzero(scores >= np.maximum(self.least[some], np.finfo(np.float64).min)[:, None])
        self.waiting.append((some[r], ids[c], np.round(scores[r, c], 12)))
        self.count += len(r)
        if self.count > max(self.ids.size, 1 << 18):
            self._settle()

    def _settle(self) -> None:
        if not self.waiting:
            return
        row, ids, scores = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        touched = np.unique(row)
        row, ids, scores = np.concatenate([row, np.repeat(touched, self.k)]), np.concatenate([ids, self.ids[touched].ravel()]), np.concatenate([scores, self.scores[touched].ravel()])
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        begins = np.searchsorted(row, touched)
        at = begins[:, None] + np.arange(self.k)
        self.ids[touched], self.scores[touched] = ids[at], scores[at]
        # rounding moves a score by less than 1e-12
        self.least[touched] = np.maximum(self.least[touched], self.scores[touched, -1] - 1e-11)
        self.waiting, self.count = [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of all that is held."""
        self._settle()
        row, at = np.nonzero(np.isfinite(self.scores))
        return row, self.ids[row, at], self.scores[row, at]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """For each query the ``k`` vectors of highest product, ties by key: (query, id, cosine, rank).

    The stated queries go in blocks of ``queries_at_once`` against all vectors: each task keeps its best ``k`` a query,
    then a window over at most ``k`` rows a task and query ranks them.
    """
    out, total = None, queries.count()
    parts = max(1, -(-total // queries_at_once))
    for part in range(parts):
        some = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else queries
        rows = some.select(key, vector).orderBy(key).collect()  # a block of queries
        ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)

        def best(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            held, every = Best(len(ids), k), np.arange(len(ids))
            for batch in batches:
                vectors_ = np.stack(batch["v"].to_list()).astype(np.float64) if len(batch) else None
                for lo in range(0, len(batch) if len(ids) else 0, VECTORS_AT_ONCE):
                    held.see(every, batch["id"].to_numpy()[lo : lo + VECTORS_AT_ONCE], matrix @ vectors_[lo : lo + VECTORS_AT_ONCE].T)
            number, found, scores = held.rows()
            yield pd.DataFrame({"query": ids[number], "id": found, "cosine": scores})

        found = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(best, "query long, id long, cosine double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def voted(neighbours: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Similarity-weighted label of each query; null where the best label has less than ``least`` of the votes."""
    by = neighbours.join(labels, "id").groupBy("query", "label").agg(F.sum("cosine").alias("votes"))
    total = by.groupBy("query").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", (-F.col("label")).alias("m")))["m"].alias("m"), F.max("votes").alias("votes"))
    share = F.col("votes") / F.col("all")
    return total.select("query", F.when(share >= least, -F.col("m")).alias("label"), F.round(share, 4).alias("share"))

"""Least squares over a lattice of specifications, by sweeping.

A specification is a base (the regressors of all) and the controls of its mask. Its fit is the Gram matrix swept on its
columns, and a mask differs from the mask without its last control by one sweep; a walk down the tree of masks therefore
costs one sweep per specification, for a whole batch of Grams (folds or draws) at once. Sweeps only go forward (a branch
works on a copy), so rounding doesn't add up along the walk. A pivot that leaves little of a column is not trusted: such
fits are done again by ``ols.fit``, which takes the pseudo-inverse where rank is lacking.

Specifications are dealt in blocks (of masks) times batches (of draws); a task holds a batch of Grams and one path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.functions.stats import t_two_sided
from polyspec.operators import moments, ols
from polyspec.operators.patterns import need_of

#: Controls whose subsets make a block, and the share of a column that a trusted pivot leaves.
FREE, PIVOT = 7, 1e-9
FIT_COLUMNS = ("r2", "ll", "ll_null", "ll_gain", "ll_gain_per_obs", "aic", "bic", "hqic")


def rank_masks(masks: np.ndarray, k: int) -> np.ndarray:
    """Places of masks over ``k`` items by size, and by positions within a size (combinatorial numbers)."""
    size = np.array([int(m).bit_count() for m in masks], np.int64)
    first = np.cumsum([0, *[comb(k, s) for s in range(k + 1)]])
    table = np.array([[comb(n, s) for s in range(k + 2)] for n in range(k + 1)], dtype=object)
    place, left = np.array([comb(k, int(s)) - 1 for s in size], dtype=object), size.copy()
    for at in range(k):
        has = (masks >> at) & 1 == 1
        place[has] -= table[k - 1 - at][left[has]]
        left[has] -= 1
    return first[size] + place.astype(np.int64)


@dataclass(frozen=True)
class Space:
    """The specifications of a model over Gram columns ``columns``: outcomes x masks of controls. ``masks``: the sampled
    ones in order, or None for all."""

    columns: list[str]
    y: list[str]
    x: list[str]
    controls: list[str]
    holes: list[str]
    masks: list[int] | None
    group: str | None = None

    @property
    def n_masks(self) -> int:
        return len(self.masks) if self.masks is not None else 1 << len(self.controls)

    def places(self) -> tuple[list[int], list[int], list[int]]:
        """Gram columns of the outcomes, of x, and of the controls."""
        at = {c: i for i, c in enumerate(self.columns)}
        return [at[c] for c in self.y], [at[c] for c in self.x], [at[c] for c in self.controls]

    def y_needs(self) -> dict[int, list[int]]:
        """Outcomes by what they and all specifications need."""
        base = need_of([*self.x, *([self.group] if self.group else [])], self.holes)
        out: dict[int, list[int]] = {}
        for i, c in enumerate(self.y):
            out.setdefault(base | need_of([c], self.holes), []).append(i)
        return out

    def mask_need(self, masks: np.ndarray) -> np.ndarray:
        need = np.zeros(len(masks), np.int64)
        for i, c in enumerate(self.controls):
            bit = need_of([c], self.holes)
            if bit:
                need |= np.where((masks >> i) & 1 == 1, bit, 0)
        return need

    def needs(self) -> list[int]:
        """Every need that occurs."""
        own = [need_of([c], self.holes) for c in self.controls]
        if self.masks is not None:
            subsets = set(self.mask_need(np.array(self.masks, np.int64)).tolist())
        else:
            subsets = {0}
            for bit in own:
                subsets |= {s | bit for s in subsets}
        return sorted({b | s for b in self.y_needs() for s in subsets})

    def blocks(self, spark: SparkSession, apart: bool = False) -> DataFrame:
        """unit, need, block, ys, masks, ids: specifications of one need, in blocks of masks that share a path. ``ids`` are
        of the first outcome; the i-th outcome's are i * n_masks more. With ``apart`` each specification is a unit."""
        holed = [i for i, c in enumerate(self.controls) if c in self.holes]
        plain = [i for i in range(len(self.controls)) if i not in holed]
        free = plain[: max(0, min(FREE, len(plain)))]
        fixed = [*holed, *plain[len(free) :]]
        k, sampled, y_needs, own_need, n_masks = len(self.controls), self.masks, self.y_needs(), self.mask_need, self.n_masks
        schema = "unit long, need long, block long, ys array<int>, masks array<long>, ids array<long>"

        def rows(block: int, masks: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
            needs = own_need(masks)
            for base, ys in y_needs.items():
                for need in np.unique(needs).tolist():
                    here = needs == need
                    if not apart:
                        yield base | need, base | need, block, ys, masks[here].tolist(), ids[here].tolist()
                        continue
                    for mask, i in zip(masks[here].tolist(), ids[here].tolist(), strict=True):
                        for y in ys:
                            yield y * n_masks + i, base | need, 0, [y], [mask], [i]

        def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low = np.arange(1 << len(free), dtype=np.int64)
            for pdf in batches:
                out = []
                for block in pdf["id"]:
                    if sampled is None:
                        masks = sum((((low >> b) & 1) << i for b, i in enumerate(free)), np.zeros_like(low))
                        masks = masks + sum(((int(block) >> b) & 1) << i for b, i in enumerate(fixed))
                        ids = rank_masks(masks, k)
                    else:
                        ids = np.arange(int(block) << FREE, min(len(sampled), (int(block) + 1) << FREE), dtype=np.int64)
                        masks = np.array([sampled[i] for i in ids], np.int64)
                    out += rows(int(block), masks, ids)
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        n = 1 << len(fixed) if sampled is None else -(-len(sampled) >> FREE) if sampled else 0
        return spark.range(n, numPartitions=max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(expand, schema)


def sweep(a: np.ndarray, c: np.ndarray, r: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Batches a (b, q, q), c (b, q, y) and r (b, y) swept on column j: then a holds the inverse over the swept columns, c
    their coefficients and r the squared error left. Also where the pivot isn't to be trusted."""
    d = a[:, j, j]
    weak = ~(d > PIVOT)
    d = np.where(weak, 1.0, d)[:, None]
    row, own, col = a[:, j, :] / d, c[:, j, :] / d, a[:, :, j]
    a2 = a - col[:, :, None] * row[:, None, :]
    c2 = c - col[:, :, None] * own[:, None, :]
    r2 = r - c[:, j, :] * own
    a2[:, j, :], c2[:, j, :], a2[:, :, j] = row, own, -col / d
    a2[:, j, j] = 1 / d[:, 0]
    return a2, c2, r2, weak


@dataclass
class Node:
    """A specification's fits over a batch: coefficients b (b, k, y) of ``cols``, the diagonal of the inverse (b, k), squared
    error rss (b, y), summed error (b, y), and where these aren't to be trusted."""

    mask: int
    cols: list[int]
    b: np.ndarray
    inverse: np.ndarray
    rss: np.ndarray
    error: np.ndarray
    weak: np.ndarray


def walk(g: np.ndarray, base: list[int], controls: list[int], masks: np.ndarray, ys: list[int]) -> Iterator[Node]:
    """Fits of the outcomes ``ys`` on base and the controls of each mask, for a batch of Grams whose last row is the 1's."""
    one = g.shape[1] - 1
    used = [c for i, c in enumerate(controls) if ((masks >> i) & 1).any()]
    q = list(dict.fromkeys([*base, *used, one]))
    at = {c: i for i, c in enumerate(q)}
    dx = np.sqrt(np.clip(np.einsum("bii->bi", g)[:, q], 0, None))
    dx = np.where(dx > 0, dx, 1.0)
    dy = np.sqrt(np.clip(np.einsum("bii->bi", g)[:, ys], 0, None))
    dy = np.where(dy > 0, dy, 1.0)
    a = g[:, q][:, :, q] / dx[:, :, None] / dx[:, None, :]
    c = g[:, q][:, :, ys] / dx[:, :, None] / dy[:, None, :]
    r = np.einsum("bii->bi", g)[:, ys] / dy**2
    weak = np.zeros(len(g), bool)
    for col in reversed(base):  # an intercept stands last: sweeping it first centres the rest
        a, c, r, w = sweep(a, c, r, at[col])
        weak = weak | w
    order = [i for i in range(len(controls)) if ((masks >> i) & 1).any()]
    stack = [(0, np.unique(masks), a, c, r, weak)]
    while stack:
        depth, some, a, c, r, weak = stack.pop()
        while depth < len(order) and not ((some >> order[depth]) & 1).any():
            depth += 1
        if depth == len(order):
            mask = int(some[0])
            cols = [*base, *[col for i, col in enumerate(controls) if mask >> i & 1]]
            own = [at[x] for x in cols]
            scale = dx[:, own]
            error = c[:, at[one]] * dx[:, [at[one]]] * dy if one not in cols else np.zeros_like(r)
            yield Node(mask, cols, c[:, own] * dy[:, None, :] / scale[:, :, None], np.einsum("bii->bi", a)[:, own] / scale**2, np.clip(r, 0, None) * dy**2, error, weak)
            continue
        has = (some >> order[depth]) & 1 == 1
        if has.all():
            a, c, r, w = sweep(a, c, r, at[controls[order[depth]]])
            stack.append((depth + 1, some, a, c, r, weak | w))
            continue
        stack.append((depth + 1, some[~has], a, c, r, weak))
        a, c, r, w = sweep(a, c, r, at[controls[order[depth]]])
        stack.append((depth + 1, some[has], a, c, r, weak | w))


def specification_rows(pdf: pd.DataFrame) -> tuple[np.ndarray, dict[int, int], list[int]]:
    """Masks of a block, the first outcome's id of each, and the outcomes."""
    masks, ids = (np.concatenate([np.asarray(v, np.int64) for v in pdf[c]]) for c in ("masks", "ids"))
    return masks, dict(zip(masks.tolist(), ids.tolist(), strict=True)), [int(y) for y in pdf["ys"].iloc[0]]


def full_fits(space: Space, grams: DataFrame, kfold: int, metric: str, labels: list[str]) -> DataFrame:
    """A row per specification: the full fit, and the metric of each fold. grams: need, fold, gram."""
    from polyspec.estimators import FULL_SCHEMA

    y_at, x_at, z_at = space.places()
    n_columns, n_masks, xs, zs = len(space.columns), space.n_masks, space.x, space.controls
    names = [*[c.split()[0] for c in FULL_SCHEMA.split(", ")], "scores"]

    def fit(gram: pd.DataFrame, specs: pd.DataFrame) -> pd.DataFrame:
        out, tails = [], []
        if not len(specs) or not len(gram):
            return pd.DataFrame([], columns=names)
        masks, ids, ys = specification_rows(specs)
        g = moments.unpack(np.stack(gram.sort_values("fold")["gram"].to_numpy()), n_columns)
        total = g.sum(0)
        folds = np.zeros((kfold, *total.shape))
        if kfold:
            folds[np.sort(gram["fold"].to_numpy())] = g
        batch = np.concatenate([total[None], total[None] - folds]) if kfold else total[None]
        ycols, n = [y_at[y] for y in ys], total[-1, -1]
        for node in walk(batch, x_at, z_at, masks, ycols):
            k = len(node.cols)
            for i, (y, yc) in enumerate(zip(ys, ycols, strict=True)):
                weak = np.flatnonzero(node.weak)
                b, singular = node.b[:, :, i], False
                if len(weak):
                    again = ols.fit(batch[weak], node.cols, yc, full=False, p_of=0)
                    b = b.copy()
                    b[weak] = again["b"]
                    singular = bool(weak[0] == 0 and again["singular"][0])
                if node.weak[0]:
                    r = {key: v[0] for key, v in ols.fit(total[None], node.cols, yc, p_of=0).items()}
                else:
                    r = {key: v[0] for key, v in ols.finish(b[:1], node.inverse[:1], node.rss[:1, i], node.error[:1, i] / n, total[None, -1, -1], total[None, yc, yc], total[None, yc, -1], k).items()}
                scores = ols.score_folds(batch[1:], folds, b[1:], node.cols, yc, metric).tolist() if kfold else []
                controls = [c for j, c in enumerate(zs) if node.mask >> j & 1]
                tails.append((r["t"], n - k))
                out.append([y * n_masks + ids[node.mask], labels[y], controls, [*xs, *controls], r["b"].tolist(), r["se"].tolist(), None, int(n), k, r["b"][0], None, *[r[c] for c in FIT_COLUMNS], singular, True, scores])
        p = t_two_sided(np.concatenate([t for t, _ in tails]), np.concatenate([np.full(len(t), d) for t, d in tails]))
        at = np.cumsum([0, *[len(t) for t, _ in tails]])
        for row, s, e in zip(out, at[:-1], at[1:], strict=True):
            row[names.index("p")], row[names.index("pval")] = p[s:e].tolist(), p[s]
        return pd.DataFrame(out, columns=names)

    blocks = lambda: space.blocks(grams.sparkSession)  # noqa: E731  a frame of its own for each side of a join
    dealt = grams.join(blocks().select("need", "block"), "need")
    keys, tasks = ["need", "block"], max(8, grams.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(blocks().repartition(tasks, *keys).groupBy(*keys)).applyInPandas(fit, FULL_SCHEMA + ", scores array<double>")


def drawn_fits(space: Space, totals: DataFrame, drawn: DataFrame, draws: int, schema: str, apart: bool = False) -> DataFrame:
    """spec_id, draw, beta, p, r2, beta_null, p_null: the focal coefficient of each specification and draw, with an intercept
    in place of any const; and its null twin, whose outcome is less the full fit's slope times x: the same residuals, so the
    coefficient is less that slope. totals: need, gram; drawn: unit, draw, gram (unit: the need, or with ``apart`` the id)."""
    y_at, x_at, z_at = space.places()
    p, n_masks = len(space.columns), space.n_masks
    const = [c == "const" for c in space.controls]
    x_own = [at for at, c in zip(x_at, space.x, strict=True) if c != "const"]
    names = [c.split()[0] for c in schema.split(", ")]
    lanes = totals.sparkSession.sparkContext.defaultParallelism
    size = max(16, min(moments.DRAWS_AT_ONCE, -(-draws // lanes)))

    def fit(gram: pd.DataFrame, specs: pd.DataFrame) -> pd.DataFrame:
        gram = gram.sort_values("draw")
        if not len(specs) or not (gram["draw"] >= 0).any():
            return pd.DataFrame({c: [] for c in names})
        masks, ids, ys = specification_rows(specs)
        g = moments.unpack(np.stack(gram["gram"].to_numpy()), p)
        total, g = g[:1], g[1:]
        draw = gram["draw"].to_numpy(np.int32)[1:]
        ycols = [y_at[y] for y in ys]
        # A const among the controls gives way to the intercept: masks with and without it are one.
        bare = masks & ~sum((1 << i for i, c in enumerate(const) if c), 0)
        nodes = {node.mask: node for node in walk(g, [*x_own, p], z_at, bare, ycols)}
        slopes = {node.mask: node for node in walk(total, x_at, z_at, masks, ycols)}
        columns = {c: [] for c in ("spec_id", "beta", "se", "r2", "slope", "df")}
        n, one = g[:, -1, -1], np.ones(len(g))
        for mask in np.unique(masks).tolist():
            node, whole = nodes[int(bare[np.flatnonzero(masks == mask)[0]])], slopes[mask]
            for i, (y, yc) in enumerate(zip(ys, ycols, strict=True)):
                k = len(node.cols)
                r = ols.finish(node.b[:, :, i], node.inverse, node.rss[:, i], np.zeros(len(g)), n, g[:, yc, yc], g[:, yc, -1], k, full=False)
                beta, se, r2 = r["b"][:, 0].copy(), r["se"][:, 0].copy(), r["r2"].copy()
                if node.weak.any():
                    again = ols.fit(g[node.weak], node.cols, yc, full=False, p_of=0)
                    beta[node.weak], se[node.weak], r2[node.weak] = again["b"][:, 0], again["se"][:, 0], again["r2"]
                slope = ols.fit(total, whole.cols, yc, full=False, p_of=0)["b"][0, 0] if whole.weak[0] else whole.b[0, 0, i]
                for c, v in zip(columns, (np.full(len(g), y * n_masks + ids[mask]), beta, se, r2, one * slope, n - k), strict=True):
                    columns[c].append(v)
        v = {c: np.concatenate(x) for c, x in columns.items()}
        null = v["beta"] - v["slope"]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(v["se"] == 0, np.nan, np.stack([v["beta"], null]) / np.where(v["se"] == 0, 1, v["se"]))
        own, of_null = t_two_sided(t, np.broadcast_to(v["df"], t.shape))
        return pd.DataFrame({"spec_id": v["spec_id"].astype(np.int64), "draw": np.tile(draw, len(columns["beta"])), "beta": v["beta"], "p": own, "r2": v["r2"], "beta_null": null, "p_null": of_null})

    blocks = lambda: space.blocks(totals.sparkSession, apart)
    batch = F.floor(F.col("draw") / size).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(-(-draws // size) - 1)))
    dealt = drawn.select("unit", "draw", "gram", batch.alias("batch")).join(blocks().select("unit", "block"), "unit").select("unit", "block", "batch", "draw", "gram")
    first = blocks().select("unit", "need", "block").join(totals, "need").select("unit", "block", every.alias("batch"), F.lit(-1).alias("draw"), "gram")
    specs = blocks().select("unit", "block", "ys", "masks", "ids", every.alias("batch"))
    keys = ["unit", "block", "batch"]
    tasks = max(8, lanes)
    left = dealt.unionByName(first).repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(specs.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(fit, schema)

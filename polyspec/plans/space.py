"""The space of specifications: subsets of controls, composites of outcomes, samples of both."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CONTROLS, MAX_ENUMERATED = 62, 20


def space_size(items: list) -> int:
    return 2 ** len(items)


def all_subsets(items: list[str]) -> list[tuple[str, ...]]:
    """By size, then by position: the empty set first, the full set last."""
    return [c for k in range(len(items) + 1) for c in combinations(items, k)]


def bitmask(spec, items: list[str]) -> int:
    """Bit i stands for items[i]."""
    return sum(1 << items.index(s) for s in spec)


def from_mask(mask: int, items: list[str]) -> tuple[str, ...]:
    return tuple(s for i, s in enumerate(items) if mask >> i & 1)


def sample_masks(n: int, size: int, seed: int | None, empty: bool = True) -> list[int]:
    """Masks over ``n`` items without replacement, exhaustive where ``size`` covers the space."""
    total = 2**n - (not empty)
    if size >= total:
        return list(range(not empty, 2**n))
    rng = np.random.default_rng(seed)
    if total <= 1 << 20:
        return [int(m) + (not empty) for m in rng.choice(total, size, replace=False)]
    seen: dict[int, None] = {}
    while len(seen) < size:
        seen[int(rng.integers(0, total)) + (not empty)] = None
    return list(seen)


def sample_z_masks(n_z: int, n_masks: int, seed: int | None = None) -> list[int]:
    return sample_masks(n_z, n_masks, seed)


def sample_y_masks(n_y: int, n_masks: int, seed: int | None = None) -> list[int]:
    return sample_masks(n_y, n_masks, seed, empty=False)


def mask_controls(mask: Column, items: list[str]) -> Column:
    """The controls of a mask column, in order."""
    named = F.array(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(c)) for i, c in enumerate(items)], F.lit(None).cast("string"))
    return F.filter(named, lambda x: x.isNotNull())


def controls_mask(controls: Column, items: list[str]) -> Column:
    """The mask of a column of control names."""
    return sum((F.when(F.array_contains(controls, c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(items)), F.lit(0).cast("long"))


def specs_frame(spark: SparkSession, controls: list[str], masks: list[int] | None = None) -> DataFrame:
    """spec_id, z_mask, controls, n_controls, is_null, is_full, by size and then position (or as given)."""
    if len(controls) > MAX_CONTROLS or masks is None and len(controls) > MAX_ENUMERATED:
        raise ValueError(f"at most {MAX_CONTROLS} controls, of which {MAX_ENUMERATED} can be enumerated; sample the space beyond that")
    k = len(controls)
    masks = [bitmask(s, controls) for s in all_subsets(controls)] if masks is None else masks
    return spark.createDataFrame(list(enumerate(masks)), "spec_id long, z_mask long").select(
        "spec_id",
        "z_mask",
        mask_controls(F.col("z_mask"), controls).alias("controls"),
        F.bit_count("z_mask").cast("int").alias("n_controls"),
        (F.col("z_mask") == 0).alias("is_null"),
        (F.col("z_mask") == 2**k - 1).alias("is_full"),
    )


def reservoir_sample(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """A uniform sample of k rows: those of least seeded hash, found by a distributed top-k."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(k)


def selection_keys(specs) -> list[frozenset[str]]:
    """Specifications as sets of names; anything but a list of lists of strings is refused."""
    if not isinstance(specs, list) or not all(isinstance(s, (list, tuple, set, frozenset)) and all(isinstance(c, str) for c in s) for s in specs):
        raise ValueError("specs must be a list of lists of column names")
    return [frozenset(s) for s in specs]

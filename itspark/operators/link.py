"""Linking further sources to a cohort by composite key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.functions.recode import key_suffix
from itspark.operators.dedup import collapse_keys, drop_conflicts
from itspark.operators.keys import join_keys

#: Cells of the hash space per part: a cell without a heavy key is rarely as full as a part.
CELLS = 16


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_key_hashes(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``hash`` of the keys that hold more rows than a task's fair share, exactly.

    The share is one of ``parts``, by default the shuffle partitions, so there are fewer such keys than
    parts, whatever the data. Two passes: rows per cell of the hash space, and then rows per key of the few
    cells that hold more than a share. Both are counted map-side, the cells are as many as ``CELLS`` times the
    parts, and light keys leave the map side of the second pass only if they share a cell with a heavy one.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.select(_key_hash(keys).alias("hash"))
    cell = F.pmod("hash", F.lit(CELLS * parts)).alias("cell")
    cells = hashed.groupBy(cell).agg(F.count(F.lit(1)).alias("n"))
    share = cells.agg(F.sum("n")).scalar() / F.lit(parts)
    full = cells.filter(F.col("n") > share).select("cell")
    # Fewer rows than parts, each of one number.
    found = hashed.join(F.broadcast(full), F.pmod("hash", F.lit(CELLS * parts)) == F.col("cell"), "left_semi")
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share).select("hash")


def _spread(left: DataFrame, right: DataFrame, keys: Sequence[str], ways: int, parts: int | None = None):
    """Salt the heavy left keys ``ways`` times and repeat only their right rows once per salt.

    The salt depends on the row and on its map task alone, so a retried task repeats it. The heavy keys are
    fewer than the parts, so they are sent to all tasks.
    """
    heavy = F.broadcast(heavy_key_hashes(left, keys, parts).select(F.col("hash").alias("_heavy")))
    columns = left.columns
    salt = F.pmod(F.pmod(F.xxhash64(*columns), F.lit(ways)) + F.spark_partition_id(), F.lit(ways))
    salts = F.sequence(F.lit(0), F.lit(ways - 1))
    is_heavy = F.col("_heavy").isNotNull()
    left = left.join(heavy, _key_hash(keys) == F.col("_heavy"), "left").withColumn("_salt", F.when(is_heavy, salt).otherwise(0).cast("int")).drop("_heavy")
    right = right.join(heavy, _key_hash(keys) == F.col("_heavy"), "left")
    right = right.withColumn("_salt", F.explode(F.when(is_heavy, salts).otherwise(F.array(F.lit(0))))).drop("_heavy")
    return left, right


def link_left(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] | None = None,
    na_matches: bool = True,
    fill: Mapping[str, object] | None = None,
    marker: str | None = None,
    spread: int = 0,
) -> DataFrame:
    """Left join on all common columns, or on ``keys``; null keys match null keys by default.

    ``fill`` replaces what is null after the join, ``marker`` names a 1/0 column telling matched rows.
    ``spread`` above 1 splits the left rows of heavy keys over that many tasks.
    """
    keys = list(keys) if keys is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the two tables share no column")
    new = [c for c in right.columns if c not in keys]
    twice = sorted(set(new) & set(left.columns))
    if twice:
        raise ValueError(f"columns in both tables that are not keys: {twice}")
    if marker:
        right = right.withColumn(marker, F.lit(1))
        new.append(marker)
    kept = list(left.columns)
    on = list(keys)
    if spread > 1:
        left, right = _spread(left, right, keys, spread)
        on.append("_salt")
    # The right key columns get names of their own, so that each side is plain by name below.
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in on})

    def same(k: str) -> Column:
        mine, theirs = F.col(k), F.col(f"_right_{k}")
        return mine.eqNullSafe(theirs) if na_matches else mine == theirs

    joined = left.join(right, reduce(Column.__and__, [same(k) for k in on]), "left").select(*kept, *new)
    defaults = dict(fill or {})
    if marker:
        defaults[marker] = 0
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}) if defaults else joined


@dataclass(frozen=True)
class SourceSpec:
    """A table to link: what to take, how to recode it once de-duplicated, what to fill when unmatched."""

    name: str
    df: DataFrame
    columns: Mapping[str, str]
    recode: Callable[[DataFrame], DataFrame] | None = None
    keep: Sequence[str] | None = None
    fill: Mapping[str, object] = field(default_factory=dict)


def prepare_source(
    spec: SourceSpec,
    keys: Sequence[str],
    trim: str | None = "mother_id",
    trim_to: int = 6,
    mark_conflicts: bool = False,
) -> DataFrame:
    """Select and rename, trim the id, reduce to one row per key, recode.

    Conflicting keys drop out, or stay with null values and ``conflicted`` true under ``mark_conflicts``.
    """
    df = spec.df.select(*[F.col(old).alias(new) for old, new in spec.columns.items()])
    if trim:
        df = df.withColumn(trim, key_suffix(F.col(trim), trim_to))
    df = collapse_keys(df, keys) if mark_conflicts else drop_conflicts(df, keys)
    if spec.recode:
        df = spec.recode(df)
    values = spec.keep if spec.keep is not None else [c for c in df.columns if c not in (*keys, "conflicted")]
    if not mark_conflicts:
        return df.select(*keys, *values)
    # A recode may turn null into a default (an unticked box is 0): blank the conflicting keys again.
    conflicted = F.col("conflicted")
    return df.select(*keys, *[F.when(~conflicted, F.col(c)).alias(c) for c in values], "conflicted")


def link_sources(
    cohort: DataFrame,
    sources: Sequence[SourceSpec],
    keys: Sequence[str],
    trim: str | None = "mother_id",
    trim_to: int = 6,
    na_matches: bool = False,
    status: bool = False,
    spread: int = 0,
) -> DataFrame:
    """Left-join every source. A conflicting key counts as unmatched, as if its rows had been dropped.

    Cohort ids can become equal when trimmed; ``spread`` splits keys that many rows share.

    With ``na_matches`` off the joins reuse the key partitioning of the de-duplication. ``status`` adds
    ``link_<name>``: ``matched``, ``conflict`` or ``absent``.
    """
    linked = cohort
    for spec in sources:
        source = prepare_source(spec, keys, trim, trim_to, mark_conflicts=status)
        fill = dict(spec.fill)
        if status:
            how = f"link_{spec.name}"
            state = F.when(F.col("conflicted"), "conflict").otherwise("matched")
            source = source.withColumn(how, state).drop("conflicted")
            fill[how] = "absent"
        linked = link_left(linked, source, keys, na_matches=na_matches, fill=fill, spread=spread)
    return linked


def link_report(linked: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per source and link status, all three states listed, from a table linked with ``status``."""
    states = ("matched", "conflict", "absent")
    counts = linked.agg(
        *[F.count_if(F.col(f"link_{n}") == s).alias(f"{n}|{s}") for n in names for s in states]
    )
    pairs = ", ".join(f"'{n}', '{s}', `{n}|{s}`" for n in names for s in states)
    return counts.selectExpr(f"stack({len(names) * len(states)}, {pairs}) as (source, status, n)")


def bind_on_period(*tables: DataFrame, on: Sequence[str] = ("series", "period")) -> DataFrame:
    """Put tables side by side by key, where equal-length tables would be bound by row position.

    Every key of any table keeps its row; what another table lacks is null. Null keys meet null keys.
    """
    return reduce(lambda a, b: join_keys(a, b, on, "full"), tables)

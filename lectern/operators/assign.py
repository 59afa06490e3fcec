"""Names dealt to groups in turn, where one name may stand in several groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import shared_folder

#: Rows of names of several groups that one task goes through.
BLOCK = 2_000_000


def _numbered(df: DataFrame, group: str, order: list[Column], saved, parts: int, **values: Column) -> DataFrame:
    """``df`` with, for each of ``values``, its sum over the rows before in the same group.

    Rows are dealt out by ranges of group and order, so that a large group lies in several partitions: sums within a partition's share of a group are added to the
    totals of the shares before, of which there are at most as many for a group as partitions.
    """
    dealt = saved(df.repartitionByRange(parts, F.col(group), *order).withColumns({"_part": F.spark_partition_id(), **{f"_v_{k}": v for k, v in values.items()}}))
    share = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shares = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = dealt.groupBy(group, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    earlier = totals.select(group, "_part", *[before(f"_t_{k}", shares).alias(f"_e_{k}") for k in values])
    within = dealt.withColumns({f"_w_{k}": before(f"_v_{k}", share) for k in values})
    return within.join(earlier, [group, "_part"]).select(*df.columns, *[(F.col(f"_w_{k}") + F.col(f"_e_{k}")).alias(k) for k in values])


def _first_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, g): the group whose turn reaches a name first, from rows(n, g, gh, before) in the order of names.

    ``before``: what the group has taken before the name, but for names of these rows; those are counted here, which holds one number for a group that takes any.
    """
    won: dict[str, int] = {}
    name, best = None, None
    for batch in batches:
        found = []
        for n, g, gh, before in zip(*(batch.column(c).to_pylist() for c in ("n", "g", "gh", "before")), strict=True):
            if n != name:
                if best is not None:
                    found.append((name, best[2]))
                    won[best[2]] = won.get(best[2], 0) + 1
                name, best = n, None
            claim = (before + won.get(g, 0), gh, g)
            best = claim if best is None else min(best, claim)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], ["n", "g"])
    if best is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([best[2]])], ["n", "g"])


def deal_in_turn(items: DataFrame, group: str, name: str, block: int = BLOCK) -> DataFrame:
    """(group, name, turn, ord): each name goes to the first group whose turn reaches it.

    Groups stand in the order of the SHA-256 of their names, a group's names from the greatest SHA-256 to the least. In each turn every group takes
    its first name that none has taken; ``turn`` counts from 1, ``ord`` is the place in the whole order. Repeated (group, name) rows count once, null names and groups are left out.

    All groups have their names in one order, so a group reaches a name in the turn after as many as it took of the names before, and names are settled in that order:
    a name goes to the group that has taken fewest, then the first. Names of one group only are counted by windows. The others depend on each other in a chain: they are
    cut at hashes of names into blocks of about ``block`` rows, one task streams through a block, and the next begins with its counts. So no table or group is gathered,
    and the time grows with the rows of such names.
    """
    spark = items.sparkSession
    at, count = shared_folder(spark, "turns"), 0

    def saved(df: DataFrame, by: str | None = None) -> DataFrame:
        nonlocal count
        count += 1
        (df.write.partitionBy(by) if by else df.write).parquet(f"{at}/{count}")
        return spark.read.schema(df.schema).parquet(f"{at}/{count}")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select(F.col(group).cast("string").alias("g"), F.col(name).cast("string").alias("n")).where("g IS NOT NULL AND n IS NOT NULL").distinct()
    rows = rows.withColumns({"gh": F.sha2("g", 256), "nh": F.sha2("n", 256)})
    shared = rows.groupBy("n").agg((F.count(F.lit(1)) > 1).alias("many"))
    state = saved(rows.join(shared, "n"))
    order = [F.desc("nh"), F.col("n")]
    blocks = -(-state.where("many").count() // block)
    counted = _numbered(state, "g", order, saved, parts, low=(~F.col("many")).cast("long")).where("many")
    # the greatest hashes are in block 0
    place = F.floor((F.lit(2**32 - 1) - F.conv(F.substring("nh", 1, 8), 16, 10).cast("long")) * F.lit(blocks) / F.lit(2**32))
    told = saved(counted.select("n", "g", "gh", "nh", "low", place.cast("int").alias("block")), "block") if blocks else None
    won, taken = None, state.where("NOT many").select("g", "gh", "n", "nh")
    for b in range(blocks):
        mine = told.where(F.col("block") == b)
        mine = mine.withColumn("before", F.col("low")) if won is None else mine.join(won, "g", "left").withColumn("before", F.col("low") + F.coalesce("won", F.lit(0)))
        got = saved(mine.select("n", "g", "gh", "nh", "before").repartition(1).sortWithinPartitions(*order).mapInArrow(_first_reached, "n string, g string"))
        taken = taken.unionByName(got.select("g", F.sha2("g", 256).alias("gh"), "n", F.sha2("n", 256).alias("nh")))
        new = got.groupBy("g").agg(F.count(F.lit(1)).alias("won"))
        if b + 1 < blocks:
            won = saved(new if won is None else won.unionByName(new).groupBy("g").agg(F.sum("won").alias("won")))
    one = F.lit(1).cast("long")
    first = _numbered(taken, "g", order, saved, parts, turn=one).withColumns({"turn": F.col("turn") + 1, "_all": F.lit(0)})
    ranked = _numbered(first, "_all", [F.col("turn"), F.col("gh"), F.col("g")], saved, parts, ord=one)
    return ranked.select(F.col("g").alias(group), F.col("n").alias(name), "turn", (F.col("ord") + 1).alias("ord"))


def quotas(candidates: DataFrame, curated: DataFrame, kinds: list[str], short: int, total: int, longest_short: int = 3) -> DataFrame:
    """(kind, name, ord) of the names of each kind: curated ones first, then dealt ones of at most ``longest_short`` characters until there are ``short``
    of these, then longer ones up to ``total``. candidates(kind, group, name), curated(kind, name, ord).

    Kinds are served in the given order and no name twice; too few names are an error.
    """
    chosen = curated.select("kind", "name", F.col("ord").cast("long"))
    for kind in kinds:
        for few in (True, False):
            mine = candidates.where((F.col("kind") == kind) & ((F.length("name") <= longest_short) == F.lit(few)))
            left = mine.join(chosen.select("name").distinct(), "name", "left_anti")
            have = chosen.where(F.col("kind") == kind)
            due = (short - have.where(F.length("name") <= longest_short).count()) if few else (total - have.count())
            got = deal_in_turn(left.select("group", "name"), "group", "name").where(F.col("ord") <= due)
            if (n := got.count()) < due:
                raise ValueError(f"{due - n} {'short' if few else 'long'} names of {kind} are missing")
            start = have.count()
            chosen = chosen.unionByName(got.select(F.lit(kind).alias("kind"), "name", (F.col("ord") + start).alias("ord")))
    return chosen

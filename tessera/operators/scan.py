"""The walk over lines as a segmented scan: which section goes on in each line, without a row loop and without one task for a group.

A walk has few states: no section, a section, or the ingredient section with a gap of 0 up to the tolerance. What a stretch of
lines does is therefore a map of these states, and maps compose: lines are sorted by range and cut where the sort's tasks end, each
block is scanned by windows on its own, its map is a few numbers, the maps of a group's blocks are composed in order, and lines
before a block's first start then take the state that comes in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

LIST = "ingredients"


def placed(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], label: str = "placed") -> DataFrame:
    """df sorted by group and order, stored with _at, the place of a row, and _block, the sort's task. At most one group goes on from a block into the next."""
    return saved(df.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_block", F.shiftright("_at", 33))


def cut_groups(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The groups that lie in several blocks: fewer than there are blocks."""
    return rows.groupBy(*by).agg(F.min("_block").alias("_a"), F.max("_block").alias("_b")).where("_a < _b").select(*by)


def same(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in by))


def going_on(lines: DataFrame, by: tuple[str, ...], order: tuple[str, ...], starts: Column, plain: Column, structure: Column, free: Column, sure: Column, on: dict[str, Column], tolerance: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, keep, active) of each line: the section that it goes on with, null if it starts one, stands alone or no section goes on.

    starts: the section that begins with a line, else null. plain: whether a line goes on with a section or ends it; lines that
    are neither leave the state alone. A plain line goes on with the ingredients if it is `free` and `sure`, or free and the gap
    is below the tolerance; structure closes the gap, other lines widen it. It goes on with another section if on[section].
    """
    flags = {"_start": starts, "_plain": plain, "_structure": structure, "_free": free, "_sure": sure, **{f"_on_{s}": c for s, c in on.items()}}
    rows = placed(lines.select(*by, *order, *keep, *(F.coalesce(c, F.lit(False)).alias(n) if n != "_start" else c.alias(n) for n, c in flags.items())), by, order)
    own = Window.partitionBy(*by, "_block").orderBy("_at")
    widens = F.col("_plain") & ~F.col("_structure")
    rows = rows.withColumns({
        "_count": F.sum(widens.cast("bigint")).over(own), "_section": F.last("_start", True).over(own), "_since": F.last(F.when(F.col("_start").isNotNull(), F.col("_at")), True).over(own),
    })
    rows = rows.withColumn("_base", F.max(F.when(F.col("_start").isNotNull() | (F.col("_plain") & F.col("_structure")), F.col("_count"))).over(own))
    # Lines since the gap was last 0, without this one; before the block's first 0, since the block began.
    rows = rows.withColumn("_gap", F.col("_count") - widens.cast("bigint") - F.coalesce("_base", F.lit(0)))

    def ends(section: str, gap: Column = F.col("_gap")) -> Column:
        if section == LIST:
            return F.col("_plain") & (~F.col("_free") | (~F.col("_sure") & (gap >= tolerance)))
        return F.col("_plain") & ~F.col(f"_on_{section}") if section in on else F.col("_plain")

    known = (LIST, *on)
    broken = F.when(F.col("_section") == LIST, ends(LIST))
    for section in on:
        broken = broken.when(F.col("_section") == section, ends(section))
    rows = rows.withColumn("_broken", F.max(F.when(broken.otherwise(F.col("_plain")), F.col("_at"))).over(own))
    alive = F.col("_since").isNotNull() & (F.col("_broken").isNull() | (F.col("_broken") < F.col("_since")))
    rows = saved(rows.select(*by, *order, *keep, "_at", "_block", "_plain", "_free", "_sure", *(f"_on_{s}" for s in on), "_since", "_base", "_gap", "_count", F.when(alive, F.col("_section")).alias("_state")), "scanned")

    # The map of each block of the groups that lie in several.
    cut = cut_groups(rows, by)
    inside = rows.join(F.broadcast(cut), same(rows, cut, by), "left_semi")
    head = F.col("_since").isNull()
    firsts = {f"_end_{s}": F.min(F.when(head & ends(s), F.col("_at"))) for s in on}
    firsts |= {f"_end_{LIST}_{g}": F.min(F.when(head & ends(LIST, F.when(F.col("_base").isNull(), F.col("_gap") + g).otherwise(F.col("_gap"))), F.col("_at"))) for g in range(tolerance + 1)}
    firsts["_end_"] = F.min(F.when(head & F.col("_plain"), F.col("_at")))
    last = F.max_by(F.struct("_state", F.col("_since").isNotNull().alias("fixed"), F.col("_base").isNull().alias("open"), (F.col("_count") - F.coalesce("_base", F.lit(0))).alias("gap")), "_at")
    maps = inside.groupBy(*by, "_block").agg(last.alias("_last"), *(c.alias(n) for n, c in firsts.items()))

    def first_end(m: Column, section: Column, gap: Column) -> Column:
        out = F.when(section == LIST, F.element_at(F.array(*(m[f"_end_{LIST}_{g}"] for g in range(tolerance + 1))), (gap + 1).cast("int")))
        for s in on:
            out = out.when(section == s, m[f"_end_{s}"])
        return out.when(section.isNotNull(), m["_end_"])

    def step(acc: Column, m: Column) -> Column:
        before = F.element_at(acc, -1)
        end, last = first_end(m, before["section"], before["gap"]), m["_last"]
        section = F.when(last["fixed"], last["_state"]).when(end.isNull(), before["section"])
        gap = F.least(F.when(last["fixed"] | ~last["open"], last["gap"]).otherwise(last["gap"] + before["gap"]), F.lit(tolerance).cast("bigint"))
        # What came into this block stands in the entry before; the new one is what it leaves.
        stood = F.struct(m["_block"].alias("block"), before["section"].alias("section"), before["gap"].alias("gap"), end.alias("end"))
        return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(stood, F.struct(F.lit(None).cast("bigint").alias("block"), section.alias("section"), gap.alias("gap"), F.lit(None).cast("bigint").alias("end"))))

    fields = F.struct("_block", "_last", *firsts)
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("block"), F.lit(None).cast("string").alias("section"), F.lit(0).cast("bigint").alias("gap"), F.lit(None).cast("bigint").alias("end")))
    chains = maps.groupBy(*by).agg(F.sort_array(F.collect_list(fields)).alias("_maps"))  # a row for each block of a cut group
    into = chains.select(*by, F.explode(F.reduce("_maps", none, step)).alias("_in")).where("_in.section is not null and _in.block is not null")
    into = saved(into.select(*by, F.col("_in.block").alias("_block"), F.col("_in.section").alias("_came"), F.col("_in.end").alias("_till")), "incoming")  # fewer rows than blocks
    told = rows.join(F.broadcast(into), same(rows, into, by) & (rows["_block"] == into["_block"]), "left")
    came = F.when(F.col("_came").isNotNull() & (F.col("_till").isNull() | (rows["_at"] < F.col("_till"))), F.col("_came"))
    active = F.when(F.col("_plain"), F.when(F.col("_since").isNull(), came).otherwise(F.col("_state")))
    return told.select(*(rows[c] for c in (*by, *order, *keep)), active.alias("active"))

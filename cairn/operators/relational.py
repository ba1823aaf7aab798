"""Relational operators of the index and of retrieval, over any tables with the named columns."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert as compaction: the last row of each key."""
    at = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(at).select("r.*")


def queue_compacted(events: DataFrame) -> DataFrame:
    """One row a path: event and time of the latest, the greatest priority, pending again."""
    return events.groupBy("path").agg(
        F.max_by("event_type", F.struct("created_at", "id")).alias("event_type"), F.max("priority").alias("priority"), F.max("created_at").alias("created_at"), F.lit("pending").alias("status")
    )


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n pending rows to work on next."""
    return queue.filter("status = 'pending'").orderBy(F.desc("priority"), "created_at", "path").limit(n)


def claimed(queue: DataFrame, batch: DataFrame) -> DataFrame:
    """The queue with the paths of a batch under work from now on."""
    marked = queue.join(batch.select("path").withColumn("_c", F.lit(True)), "path", "left")
    return marked.withColumns({"status": F.when(F.col("_c"), "processing").otherwise(F.col("status")), "claimed_at": F.when(F.col("_c"), F.current_timestamp()).otherwise(F.col("claimed_at"))}).drop("_c")


def reclaimed(queue: DataFrame, before: Column) -> DataFrame:
    """The queue with rows pending again that were claimed before a time and never settled."""
    stuck = (F.col("status") == "processing") & (F.col("claimed_at").isNull() | (F.col("claimed_at") <= before))
    return queue.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def changed(scanned: DataFrame, stored: DataFrame, key: str, hash_: str) -> DataFrame:
    """Hash gate: scanned rows whose hash is new or another."""
    old = stored.select(key, F.col(hash_).alias("_old"))
    return scanned.join(old, key, "left").filter(~F.col(hash_).eqNullSafe(F.col("_old"))).drop("_old")


def without(df: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    return df.join(gone, on, "left_anti")


def exact_else(df: DataFrame, exact: Column, partial: Column, limit: int, order: list[str]) -> DataFrame:
    """Rows that match exactly; only where there are none, rows that match in part. One pass and a top-k a branch."""
    ranked = df.withColumn("_kind", F.when(exact, 1).when(partial, 2)).filter("_kind is not null")
    best = ranked.agg(F.min("_kind").alias("_kind"))
    return ranked.join(F.broadcast(best), "_kind").orderBy(*order).limit(limit).drop("_kind")


def enclosing(points: DataFrame, intervals: DataFrame, on: str, own: str | None = None, key: Column | None = None, after: bool = False, prefer: Column | None = None) -> DataFrame:
    """For each point (id, on, at) the smallest interval (on, start, end, name) that holds it; ties go to the first start, then name.

    Places are whole numbers under 2 ** 62. Intervals with a greater `prefer` go first. With `own`, a column of points, only intervals with another
    `key` count; with `after`, only those that begin before the point.

    No pairs of points and intervals are made: an interval is cut into blocks of 2 ** k places, two of a size at most, a block keeps the
    first interval (with `own` of two keys, as one of them is another), and a place asks the one block of each size that it lies in.
    """
    order = F.struct(-(F.lit(0) if prefer is None else prefer), F.col("end") - F.col("start"), "start", "name").alias("_o")
    begin = F.try_add(F.col("start").cast("long"), F.lit(1)) if after else F.col("start").cast("long")
    rows = intervals.select(on, begin.alias("_a"), F.col("end").cast("long").alias("_b"), (F.lit(0) if own is None else key).alias("_key"), order).filter("_a <= _b and _key is not null")

    def firsts(df: DataFrame, *by: str) -> DataFrame:
        named = df.groupBy(*by, "_key").agg(F.min("_o").alias("_o"))
        n = F.row_number().over(Window.partitionBy(*by).orderBy("_o"))
        return named if own is None else named.withColumn("_n", n).filter("_n <= 2").drop("_n")

    size = F.length(F.bin(F.col("_b") - F.col("_a") + 1)) - 1
    cut = firsts(rows, on, "_a", "_b").withColumn("_k", F.explode(F.sequence(F.lit(0), size))).withColumns({"_l": F.expr("-shiftright(-_a, _k)"), "_r": F.expr("shiftright(_b + 1, _k)")}).filter("_l < _r")
    blocks = cut.select(on, "_k", F.explode(F.expr("array_compact(array(if(_l % 2 <> 0, _l, null), if(_r % 2 <> 0, _r - 1, null)))")).alias("_p"), "_key", "_o")
    sizes = rows.agg(F.max(size).alias("_most"))  # one row
    asked = points.select(on, F.col("at").cast("long").alias("_at")).distinct().crossJoin(F.broadcast(sizes)).withColumn("_k", F.explode(F.expr("sequence(0, _most)"))).drop("_most")
    met = asked.withColumn("_p", F.expr("shiftright(_at, _k)")).join(firsts(blocks, on, "_k", "_p"), [on, "_k", "_p"])
    found = met.groupBy(on, "_at").agg(F.array_sort(F.collect_list(F.struct("_o", "_key"))).alias("_f"))  # two a size at most
    other = F.lit(True) if own is None else F.col("_1._key") != F.col(own)
    found = found.select(on, "_at", F.expr("_f[0]").alias("_1"), F.expr("get(filter(_f, x -> x._key <> _f[0]._key), 0)").alias("_2"))
    inside = points.withColumn("_at", F.col("at").cast("long")).join(found, [on, "_at"])
    best = F.when(other, F.col("_1._o")).when(F.lit(True) if own is None else F.col(own).isNotNull(), F.col("_2._o"))
    return inside.withColumn("_o", best).filter("_o is not null").groupBy("id").agg(F.min("_o").alias("_o")).select("id", F.col("_o.name").alias("owner"))


def merged(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Candidates of one chunk become one: first row's fields, source of most weight (an unknown one has none), greatest base, reasons
    in order."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0))
    by = candidates.withColumn("_w", weight).groupBy("chunk_id")
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "reason"))), lambda x: x.reason))
    return by.agg(F.min("ordinal").alias("ordinal"), F.min_by("source", F.struct(-F.col("_w"), "ordinal")).alias("source"), F.max("base").alias("base"), reasons.alias("reasons"))


def budget_packed(items: DataFrame, group: list[str], order: list[str], cost: str, budget: int, salts: int = 16) -> DataFrame:
    """Greedy packing with skips over each group's rows in order: the first always goes in, later ones if they fit.

    `order` is to be total within a group; costs are whole numbers, null and negative ones count as nothing.

    What is left of a budget only falls, so of the rows of one cost a packing takes the first ones, budget / cost at most, and of
    those over the budget the first at most. Rows are cut to that by cost before a group meets in one task, in `salts` parts of a
    cost first, so a task sees about budget * ln(budget) rows of a group however many it has. Rows that cost nothing fit unless the
    first row bursts the budget; they don't go through that task, but for the first.
    """
    free, over = F.lit(0), F.lit(budget + 1)
    kind = F.least(F.greatest(F.coalesce(F.col(cost).cast("long"), free), free), over)
    most = F.when((F.col("_kind") > 0) & (F.col("_kind") <= budget), F.floor(F.lit(budget) / F.col("_kind"))).otherwise(1)
    rows = items.withColumns({"_kind": kind, "_salt": F.pmod(F.xxhash64(*order), F.lit(salts))})

    def cut(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group, *by).orderBy(*order))).filter(F.col("_n") <= most)

    few = cut(cut(rows, "_kind", "_salt"), "_kind").drop("_salt", "_n")

    def run(batches):
        last, used = None, 0
        for batch in batches:
            keys = list(zip(*(batch.column(batch.schema.get_field_index(g)).to_pylist() for g in group), strict=True))
            took = []
            for key, n in zip(keys, batch.column(batch.schema.get_field_index("_kind")).to_pylist(), strict=True):
                fits = key != last or used + n <= budget
                used = (0 if key != last else used) + (n if fits else 0)
                last = key
                took.append(fits)
            yield batch.filter(pa.array(took, pa.bool_()))

    ranked = few.repartition(*group).sortWithinPartitions(*group, *order)
    packed = ranked.mapInArrow(run, ranked.schema)
    burst = packed.filter(F.col("_kind") > budget).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)])
    nothing = rows.filter("_kind = 0").join(burst, same, "left_anti")
    return packed.filter("_kind > 0").select(*items.columns).unionByName(nothing.select(*items.columns))


def k_hops(edges: DataFrame, seeds: DataFrame, k: int, stage=None) -> DataFrame:
    """(node, depth): nodes within k steps of the seeds and their least depth; each step is an equi join and an anti join.

    `stage` writes a table and reads it back (as Store.stage does with a name): the edges, so that a step doesn't make them again,
    and each step's front, so that the plan doesn't grow with k.
    """
    keep = stage or (lambda name, df: df)
    edges = keep("hop-edges", edges.select(F.col("src").alias("node"), "dst"))
    seen = front = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, k + 1):
        front = front.join(edges, "node").select(F.col("dst").alias("node")).distinct()
        front = keep(f"hop-{d}", front.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def lexical(chunks: DataFrame, keywords: list[str], match_exact, match_partial, match_content) -> DataFrame:
    """Exact name 2.0, part of a name 1.5, content 1.0: each chunk's first hit over keywords in order, from one scan."""
    tries = []
    for i, k in enumerate(keywords):
        for j, (match, base) in enumerate(((match_exact, 2.0), (match_partial, 1.5), (match_content, 1.0))):
            tries.append(F.when(match(k), F.struct(F.lit(3 * i + j).alias("rank"), F.lit(k).alias("keyword"), F.lit(base).alias("base"))))
    first = reduce(lambda a, b: F.coalesce(a, b), tries)
    return chunks.withColumn("_h", first).filter("_h is not null").select(*chunks.columns, F.col("_h.keyword").alias("keyword"), F.col("_h.base").alias("base"), F.col("_h.rank").alias("rank"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Debounce: bursts of events nearer to each other than the gap."""
    at = F.session_window(ts, gap)
    return events.groupBy(key, at.alias("s")).agg(F.count("*").alias("n"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at")).drop("s")


def next_start(df: DataFrame, part: str, start: str) -> DataFrame:
    """The next greater start of the same file, over distinct starts."""
    w = Window.partitionBy(part).orderBy(start)
    return df.select(part, start).distinct().withColumn("next_start", F.lead(start).over(w))


def running_depth(df: DataFrame, part: list[str], order: str, delta: Column) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("depth", F.sum(delta).over(w))


def first_of(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    """The first row of each key; null keys are a key too."""
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    best = named.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return best.select("r.*")


def kept_or_all(df: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """Rows whose key is kept; all rows where no kept key occurs."""
    marked = df.join(keep.select(on).distinct().withColumn("_m", F.lit(True)), on, "left")
    some = marked.agg(F.coalesce(F.max("_m"), F.lit(False)).alias("_some"))  # one row
    return marked.crossJoin(F.broadcast(some)).filter(F.coalesce("_m", ~F.col("_some"))).select(*df.columns)


def next_marked(lines: DataFrame, part: str, at: str, code: Column) -> DataFrame:
    """Forward as-of: for each line the first later line of its part for which `code` holds."""
    w = Window.partitionBy(part).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("next", F.min(F.when(code, F.col(at))).over(w))


def block_ends(lines: DataFrame, part: str, at: str, depth: Column, most: int = 80) -> DataFrame:
    """For each start (column `start` of lines, repeated on every line of its frame) the first line where a block has begun and its
    depth is back at nothing; else `most` lines on, or the last line. lines: part, start, at, and the change of depth on the line."""
    w = Window.partitionBy(part, "start").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    own = lines.filter(F.col(at).between(F.col("start"), F.col("start") + most))
    own = own.withColumns({"_d": F.sum(depth).over(w), "_b": F.max(depth > 0).over(w)})
    return own.groupBy(part, "start").agg(F.coalesce(F.min(F.when(F.col("_b") & (F.col("_d") <= 0), F.col(at))), F.max(at)).alias("end"))


def settled(queue: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue after a batch: done paths are processed, failed ones pending again."""
    marks = done.select("path", F.lit("done").alias("_s")).unionByName(failed.select("path", F.lit("pending").alias("_s")))
    return queue.join(marks, "path", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def framed(lines: DataFrame, part: str, at: str, value: str, before: int, after: int) -> DataFrame:
    """Each line with the values from `before` lines back to `after` lines on, in order."""
    w = Window.partitionBy(part).orderBy(at).rowsBetween(-before, after)
    return lines.withColumn("frame", F.collect_list(value).over(w))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, or that have a null: none where they are a key."""
    some = F.lit(False)
    for k in keys:
        some = some | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | some)

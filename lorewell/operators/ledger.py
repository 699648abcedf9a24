"""Run and candidate ledgers: metrics, panels, slices of attention, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

SEATS = ("seat_a", "seat_b", "seat_c", "seat_d")


def latest_runs(runs: DataFrame, n: int, kind: str | None = None) -> DataFrame:
    """The n runs that completed last, of one kind if given."""
    done = runs.where("completed_at IS NOT NULL")
    return (done.where(F.col("run_type") == kind) if kind else done).orderBy(F.desc("completed_at"), F.desc("run_id")).limit(n)


def of_latest(candidates: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    return candidates.join(latest_runs(runs, n).select("run_id", "started_at"), "run_id")


def accepts() -> Column:
    """How many of the four seats accept."""
    return sum((F.when(F.col(s) == "accept", 1).otherwise(0) for s in SEATS), F.lit(0))


def accepted() -> Column:
    """Consensus: three seats of four."""
    return accepts() >= 3


def user_rejections(candidates: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    return of_latest(candidates, runs, n).where("user_rejected_at IS NOT NULL").select("run_id", "position", "strategy", "reason", "user_rejected_at")


def accepted_dissents(candidates: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """Accepted candidates that some seat rejected, with the seats that did."""
    against = F.array_compact(F.array(*[F.when(F.col(s) == "reject", F.lit(s)) for s in SEATS]))
    return of_latest(candidates, runs, n).where(accepted()).withColumn("against", F.array_join(against, ",")).where("against <> ''").select("run_id", "position", "strategy", "against")


def process_metrics(candidates: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """One row over the n runs that completed last: acceptance, its trend oldest first, the share of accepted candidates
    that some seat rejected, different strategies, and what was accepted for each call.

    A run calls once to explore, once for each two candidates, at least once, and four times to judge each.
    """
    own = of_latest(candidates, runs, n)
    against = F.array_contains(F.array(*SEATS), "reject")
    each = own.groupBy("run_id", "started_at").agg(F.count("*").alias("n"), F.count_if(accepted()).alias("a"))
    trend = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("started_at", "run_id", F.round(F.col("a") / F.col("n"), 4).cast("string").alias("rate")))), lambda s: s["rate"]), " ")
    calls = F.sum(1 + F.greatest(F.lit(1), F.ceil(F.col("n") / 2)) + 4 * F.col("n"))
    one = own.agg(F.count("*").alias("generated"), F.count_if(accepted()).alias("accepted"), F.count_if(accepted() & against).alias("split"), F.countDistinct("strategy").alias("strategies"))
    runs_row = each.agg(F.count("*").alias("runs"), trend.alias("trend"), F.coalesce(calls, F.lit(0)).cast("long").alias("calls"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    ratios = {"acceptance": share("accepted", "generated"), "split_share": share("split", "accepted"), "cost_efficiency": share("accepted", "calls")}
    return one.join(runs_row).withColumns(ratios).drop("split")


def engagement(candidates: DataFrame, memories: DataFrame, children: DataFrame) -> DataFrame:
    """strategy, created, rejected, mean_access: use of created memories, their children's included."""
    below = children.groupBy("parent_id").agg(F.sum("access_count").alias("below"))
    used = memories.select("id", "access_count").join(below, memories.id == below.parent_id, "left").select("id", (F.col("access_count") + F.coalesce("below", F.lit(0))).alias("used"))
    made = candidates.where("memory_id IS NOT NULL").join(used, F.col("memory_id") == used.id)
    return made.groupBy("strategy").agg(F.count("*").alias("created"), F.count("user_rejected_at").alias("rejected"), F.round(F.avg("used"), 6).alias("mean_access"))


def strategy_bonus(candidates: DataFrame, strategies: DataFrame | None = None, weight: float = 1.5) -> DataFrame:
    """strategy, tried, accepted, bonus: the upper confidence bound's share of exploration, for all of `strategies` (those
    of the candidates, if not given); infinite for one that was never tried."""
    counts = candidates.groupBy("strategy").agg(F.count("*").alias("tried"), F.count_if(accepted()).alias("accepted"))
    if strategies is not None:
        counts = strategies.select("strategy").distinct().join(counts, "strategy", "left").select("strategy", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("tried", "accepted")])
    everything = F.sum("tried").over(Window.partitionBy())
    bonus = F.round(weight * F.sqrt(F.log(everything) / F.col("tried")), 6)
    return counts.withColumn("bonus", F.when(F.col("tried") == 0, float("inf")).otherwise(bonus))


def panel_matrix(candidates: DataFrame) -> DataFrame:
    """seat, accept, reject, revise, mean_score, blocking (rejections that alone kept a consensus away)."""
    lone = (accepts() == 2).cast("int")
    seats = candidates.select("score", lone.alias("lone"), F.explode(F.array(*[F.struct(F.lit(s).alias("seat"), F.col(s).alias("verdict")) for s in SEATS])).alias("v")).select("score", "lone", "v.*")
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    blocks = F.count_if((F.col("verdict") == "reject") & (F.col("lone") == 1)).alias("blocking")
    return seats.groupBy("seat").agg(count("accept"), count("reject"), count("revise"), F.round(F.avg("score"), 6).alias("mean_score"), blocks)


def verdicts_long(candidates: DataFrame) -> DataFrame:
    return candidates.unpivot(["run_id", "position"], list(SEATS), "seat", "verdict")


def previous_run(runs: DataFrame) -> DataFrame:
    """run_id, previous: the last run of the same kind that had completed before."""
    before = Window.partitionBy("run_type").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("run_id", "run_type", F.last(F.when(F.col("completed_at").isNotNull(), F.col("run_id")), ignorenulls=True).over(before).alias("previous"))


def anchored(arrival: str = "arrival_share", sources: str = "source_types") -> Column:
    """Most of a slice is new, and it has more than one source."""
    return (F.col(arrival) >= 0.6) & (F.col(sources) >= 2)


def slice_metrics(slices: DataFrame, memories: DataFrame, arrivals_since: str, previous: DataFrame | None = None, episodic: tuple[str, ...] = ("source",)) -> DataFrame:
    """Eleven measures of each slice (run_id, position, ids), and whether it is anchored.

    Ids count once; shares are of those that resolve, to three places, revisits of all that were asked for. previous: ids of
    slices of recent runs. memories: (id, parent_id, type, source_type, project, created_at). source_mix gives each
    channel's rows by name; of channels or projects with equal counts the first name is dominant.
    """
    seen = (previous if previous is not None else memories.limit(0)).select(F.col("id"), F.lit(1).alias("_seen")).distinct()
    ids = slices.select("run_id", "position", F.explode_outer(F.array_distinct("ids")).alias("id")).join(seen, "id", "left")
    asked = ids.groupBy("run_id", "position").agg(F.count("id").alias("requested"), F.count("_seen").alias("_again"))
    known = ids.join(memories.select("id", F.coalesce("parent_id", "id").alias("_parent"), "type", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "project", "created_at"), "id")
    new = F.count_if(F.col("created_at") >= F.lit(arrivals_since).cast("timestamp_ntz"))
    total = known.groupBy("run_id", "position").agg(F.count("*").alias("resolved"), new.alias("_new"), F.count_if(F.col("type").isin(*episodic)).alias("_episodic"), F.countDistinct("_parent").alias("distinct_parents"))
    key = ["run_id", "position"]
    per = known.groupBy(*key, "source_type").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_mix"), F.count("*").alias("source_types"), F.max("n").alias("_top"), F.min_by("source_type", F.struct(-F.col("n"), "source_type")).alias("dominant_source")
    )
    projects = known.where("project IS NOT NULL AND project <> ''").groupBy(*key, "project").agg(F.count("*").alias("n")).groupBy(*key).agg(F.min_by("project", F.struct(-F.col("n"), "project")).alias("top_project"))
    wide = asked.join(total, key, "left").join(per, key, "left").join(projects, key, "left")
    share = lambda x, of="resolved": F.when(F.coalesce(of, F.lit(0)) > 0, F.round(F.col(x) / F.col(of), 3)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = wide.select(
        *key, "requested", zero("resolved"), share("_new").alias("arrival_share"), "source_mix", zero("source_types"), share("_top").alias("concentration"), F.coalesce("dominant_source", F.lit("")).alias("dominant_source"),
        share("_episodic").alias("episodic_share"), zero("distinct_parents"), share("_again", "requested").alias("revisit_share"), "top_project",
    )
    return out.withColumn("anchored", anchored())


def run_metrics(slices: DataFrame) -> DataFrame:
    """Per run: slices, memories, anchored slices, the merged source mix, its channels and the largest one's share, and the
    slices' shares weighted by what each resolved to."""
    mix = slices.select("run_id", F.explode("source_mix").alias("source_type", "n")).groupBy("run_id", "source_type").agg(F.sum("n").alias("n"))
    merged = mix.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("source_mix"), F.count("*").alias("source_types"), F.max("n").alias("_top"))
    # in whole thousandths, so that the order of summing can't tip a half
    summed = lambda c: F.sum(F.round(F.col(c) * 1000).cast("long") * F.col("resolved"))
    weighted = lambda c: F.coalesce(F.floor((2 * summed(c) + F.sum("resolved")) / F.nullif(2 * F.sum("resolved"), F.lit(0))) / 1000, F.lit(0.0)).alias(c)
    total = slices.groupBy("run_id").agg(F.count("*").alias("slices"), F.sum("resolved").alias("memories"), F.count_if("anchored").alias("anchored"), weighted("arrival_share"), weighted("episodic_share"), weighted("revisit_share"))
    return total.join(merged, "run_id", "left").withColumn("concentration", F.coalesce(F.round(F.col("_top") / F.col("memories"), 3), F.lit(0.0))).drop("_top")


def budget(slices: DataFrame, concentrated: float = 0.8, keep: int = 2, crowd: int = 3) -> DataFrame:
    """Slices that stay: those that resolved; of `crowd` or more concentrated unanchored ones of one source, `keep`.

    needs_arrivals tells of each run whether fewer than half of its kept slices, rounded up, are anchored, so that one of
    arrivals has to be added; a run without kept slices isn't among the rows and needs one too.
    """
    tight = (F.col("concentration") >= concentrated) & ~F.col("anchored")
    group = Window.partitionBy("run_id", "dominant_source", "tight")
    ranked = slices.where("resolved > 0").withColumn("tight", tight)
    ranked = ranked.withColumn("crowd", F.count("*").over(group)).withColumn("nth", F.row_number().over(group.orderBy("position")))
    kept = ranked.where(~F.col("tight") | (F.col("crowd") < crowd) | (F.col("nth") <= keep)).drop("crowd", "nth")
    run = Window.partitionBy("run_id")
    return kept.withColumn("needs_arrivals", F.count_if("anchored").over(run) < F.ceil(F.count("*").over(run) / 2))


def interleave(rows: DataFrame, tier: str, channel: str, order: list[Column]) -> DataFrame:
    """Adds `turn`: within a tier, channels take turns, larger channels first in each turn."""
    own = Window.partitionBy(tier, channel)
    turns = rows.withColumns({"turn": F.row_number().over(own.orderBy(*order)), "channel_size": F.count("*").over(own)})
    return turns


def within_characters(rows: DataFrame, key: str, order: list[Column], length: Column, cap: int) -> DataFrame:
    """The rows of each key from the first on while their running length stays within the cap."""
    running = F.sum(length).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= cap)


def quotas(counts: DataFrame) -> DataFrame:
    """channel, quota of (channel, n, room, total), a row for each channel: `total` slots, the same in all rows, in
    proportion to the square root of n, at most n and the channel's room.

    Shares are rounded down; then, the largest channel first (ties by name), each without a slot gets one while slots
    are left, and what is left after that goes to each channel until it is full. Each step is a running remainder of
    the slots, so there is no loop; the quotas sum to the total unless all channels are full. Channels without rows or
    room have no row here, and those that get nothing neither.
    """
    everything, largest = Window.partitionBy(), Window.orderBy(F.desc("n"), "channel")
    before = largest.rowsBetween(Window.unboundedPreceding, -1)
    top = F.least("n", "room").cast("long")
    share = F.floor(F.col("total") * F.sqrt("n") / F.sum(F.sqrt("n")).over(everything))
    shared = counts.where("n > 0 AND room > 0 AND total > 0").withColumn("top", top).withColumn("base", F.least("top", share))
    empty = (F.col("base") == 0).cast("long")
    one = shared.withColumn("one", empty * (F.coalesce(F.sum(empty).over(before), F.lit(0)) < F.col("total") - F.sum("base").over(everything)).cast("long"))
    held = one.withColumn("held", F.col("base") + F.col("one"))
    open_ = F.col("top") - F.col("held")
    left = F.col("total") - F.sum("held").over(everything) - F.coalesce(F.sum(open_).over(before), F.lit(0))
    return held.select("channel", (F.col("held") + F.greatest(F.lit(0), F.least(open_, left))).cast("long").alias("quota")).where("quota > 0")


def stratified(counts: DataFrame, total: int, cap: int) -> DataFrame:
    """channel, quota of (channel, n): as `quotas` has it, with the same cap for every channel."""
    return quotas(counts.select("channel", "n", F.lit(cap).alias("room"), F.lit(total).alias("total")))


def arrival_window(runs: DataFrame) -> DataFrame:
    """run_id, since: from the previous completed run on, but between 1 and 14 days back; 7 where there is none."""
    before = Window.partitionBy("run_type").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("completed_at", ignorenulls=True).over(before)
    day = lambda n: F.col("started_at") - F.make_dt_interval(days=F.lit(n))
    return runs.select("run_id", "run_type", F.when(last.isNull(), day(7)).otherwise(F.least(day(1), F.greatest(day(14), last))).alias("since"))


def spend(usage: DataFrame, prices: DataFrame, cap: float) -> DataFrame:
    """Adds `cost` and `running` in order of `at`, and `allowed`: nothing after the running cost has reached the cap."""
    by_time = Window.partitionBy("budget").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price") + F.col("cached_tokens") * F.col("input_price") * 0.1) / 1e6
    priced = usage.join(prices, "model").withColumn("cost", cost).withColumn("running", F.sum(F.col("cost").cast("decimal(20,10)")).over(by_time).cast("double"))
    return priced.withColumn("allowed", F.round(F.col("running") - F.col("cost"), 9) < cap)


def select_arrivals(rows: DataFrame, size: int = 14, per_channel: int = 4, generated: int = 3) -> DataFrame:
    """channel, id, why: `size` rows of (channel, id, generated, salience, novelty, created_at), at most `per_channel` of
    a channel and `generated` generated ones, both halves together.

    The first half of the slots goes to the rows of greatest salience, then novelty; within one pair of these the
    channels take turns, the one with most rows of the pair first, each with its newest. Rows without a salience don't
    compete there. What is left goes to channels by `quotas` of the rows and room that are left, to each channel's
    newest rows; generated ones get slots only if the others leave some. A null channel is one of the name ''. Ties go to
    the greater id in the first half, to the smaller in the second. Only a channel's best rows leave its partitions.
    """
    rows = rows.withColumn("channel", F.coalesce("channel", F.lit("")))
    scored = rows.where("salience IS NOT NULL").withColumn("novelty", F.coalesce("novelty", F.lit(0)))
    tier = ["salience", "novelty"]
    newest = [F.desc("created_at"), F.desc("id")]
    own = Window.partitionBy("channel")
    best = scored.withColumn("_n", F.row_number().over(own.orderBy(*map(F.desc, tier), *newest))).where(F.col("_n") <= per_channel)
    sizes = scored.groupBy("channel", *tier).agg(F.count("*").alias("_size"))
    turns = best.withColumn("_turn", F.row_number().over(Window.partitionBy("channel", *tier).orderBy(*newest))).join(sizes, ["channel", *tier])
    order = [*map(F.desc, tier), F.col("_turn"), F.desc("_size"), F.col("channel")]
    few = turns.withColumn("_g", F.row_number().over(Window.partitionBy("generated").orderBy(*order))).where(~F.col("generated") | (F.col("_g") <= generated))
    first = cut(few.orderBy(*order).limit(size // 2).select("channel", "id", "generated"), "salient")

    left = rows.join(first.select("id"), "id", "left_anti")
    taken = first.groupBy("channel").agg(F.count("*").alias("_taken"))
    held = first.agg(F.count("*").alias("_all"), F.count_if("generated").alias("_generated"))
    counts = left.groupBy("channel", "generated").agg(F.count("*").alias("n")).join(taken, "channel", "left").join(F.broadcast(held))
    counts = cut(counts.withColumn("room", F.lit(per_channel) - F.coalesce("_taken", F.lit(0))), "room")
    plain = quotas(counts.where("NOT generated").withColumn("total", F.lit(size) - F.col("_all")))
    given = plain.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("_given"))
    open_ = F.least(F.lit(generated) - F.col("_generated"), F.lit(size) - F.col("_all") - F.col("_given"))
    every = plain.unionByName(quotas(counts.where("generated").join(F.broadcast(given)).withColumn("total", open_)))
    new = left.withColumn("_n", F.row_number().over(own.orderBy(F.desc("created_at"), "id"))).where(F.col("_n") <= per_channel)
    rest = new.join(every, "channel").where(F.col("_n") <= F.col("quota")).select("channel", "id", F.lit("share").alias("why"))
    return first.select("channel", "id", F.lit("salience").alias("why")).unionByName(rest)


def batches(turns: DataFrame, most_turns: int, most_characters: int) -> DataFrame:
    """key, turn, in_batch: a key's next batch is its first turns while neither their number nor their length is above
    its limit; the first turn is always in it."""
    order = Window.partitionBy("key").orderBy("turn")
    running = F.sum("characters").over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.row_number().over(order)
    return turns.select("key", "turn", ((n == 1) | ((n <= most_turns) & (running <= most_characters))).alias("in_batch"))


def manifest(rows: DataFrame, key: str, line: Column, order: list[str]) -> DataFrame:
    """key, text: a line for each row, in order."""
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("ls"))
    return lines.select(key, F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("text"))


def judging_order(items: DataFrame) -> DataFrame:
    """Adds `place`: guaranteed ones first, then by the share of new rows, then as they came."""
    order = Window.partitionBy("run_id").orderBy(F.desc("guaranteed"), F.desc("share"), "position")
    return items.withColumn("place", F.row_number().over(order))

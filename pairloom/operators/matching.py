"""1:1 matching of templates to their nearest free negatives, by rings of growing width."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, stage

# Weights of the matching distance.
MEAN_BALANCE_WEIGHT = 50.0
FRAME_PENALTY = 4.0
FLAT_SCALE = 1e-6

#: Template tables up to this many rows are sent to the negatives; larger ones are joined by shuffle.
SENT_TEMPLATES = 50_000
#: Offers kept per template by the first search of a batch, and how many of them must be
#: known to be the best ones before a ring may be the last. Both double with every search.
KEPT, ENOUGH = 16, 4
#: Width of a cell of the two grid controls, in standard deviations.
CELL = 0.5


def _neighbours(pairs: Sequence[tuple[str, Column]]) -> Column:
    """The nine cells around a cell of two whole coordinates."""
    (name_a, a), (name_b, b) = pairs
    return F.explode(F.array(*[F.struct((a + i).alias(name_a), (b + j).alias(name_b)) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width).cast("bigint")


class _Search:
    """The best offers of templates, exact whatever ring they come from.

    A ring is a join on cells: a template probes its own cell and the eight around it, so
    all negatives within one cell width are seen, and what is not seen costs at least
    ``bound``. Offers below the bound are the best there are, in their order. Templates with
    too few of them go on to the next ring; the last ring of each kind sees everything.
    """

    def __init__(self, lanes: Sequence[str], size: int, grid: Sequence[int], reach: int, sent):
        self.lanes, self.size, self.grid, self.sent = list(lanes), size, list(grid), sent
        self.widths = [1]
        while self.widths[-1] < reach:
            self.widths.append(4 * self.widths[-1])
        self.rings_run = self.searches = 0

    def _rings(self, need: DataFrame, free: DataFrame) -> Iterator[tuple[DataFrame, DataFrame, list[str], float | None, bool]]:
        """(probes, negatives, join columns, bound, same frames) of each ring. The caller
        sends what is still open into the generator."""
        frames = {"frame_a": F.col("_ta"), "frame_b": F.col("_tb")}
        cells = [f"_g{i}" for i in self.grid]
        near = _neighbours([(c, _cell(F.col(f"_t{i}"), CELL)) for c, i in zip(cells, self.grid)])
        placed = free.withColumns({c: _cell(F.col(f"_z{i}"), CELL) for c, i in zip(cells, self.grid)})
        probes = need.withColumns(frames).withColumn("_p", near).select("*", "_p.*").drop("_p", "gap_bin")
        need = yield probes, placed, [*self.lanes, "frame_a", "frame_b", *cells], CELL**2, True
        need = yield need.withColumns(frames).drop("gap_bin"), free, [*self.lanes, "frame_a", "frame_b"], None, True
        for width in self.widths:
            near = _neighbours([("_fa", _cell(F.col("_ta"), width)), ("_fb", _cell(F.col("_tb"), width))])
            placed = free.withColumns({"_fa": _cell(F.col("frame_a"), width), "_fb": _cell(F.col("frame_b"), width)})
            bound = None if width == self.widths[-1] else FRAME_PENALTY * (width + 1)
            need = yield need.withColumn("_p", near).select("*", "_p.*").drop("_p"), placed, [*self.lanes, "gap_bin", "_fa", "_fb"], bound, False

    def __call__(self, need: DataFrame, free: DataFrame, turn: int) -> DataFrame | None:
        """Rows (template_id, cost, negative_id, cluster_id, same_frames, direct, controls);
        templates without rows have no negative left."""
        self.searches += 1
        kept, enough = KEPT << turn, ENOUGH << turn
        direct = sum((F.pow(F.col(f"_z{i}") - F.col(f"_t{i}"), 2) for i in range(self.size)), F.lit(0.0))
        moved = FRAME_PENALTY * (F.abs(F.col("frame_a") - F.col("_ta")) + F.abs(F.col("frame_b") - F.col("_tb")))
        mine = Window.partitionBy("template_id")
        rings, found, probes = self._rings(need, free), [], None
        while True:
            try:
                probes, placed, on, bound, same = next(rings) if probes is None else rings.send(need)
            except StopIteration:
                break
            self.rings_run += 1
            cost = F.round(direct + F.col("_pull") + (F.lit(0.0) if same else moved), 9)
            met = placed.join(self.sent(probes), on).select(
                "template_id", cost.alias("cost"), "negative_id", "split", "cluster_id", F.lit(same).alias("same_frames"), direct.alias("direct"),
                *[f"_z{i}" for i in range(self.size)],
            )
            # The first ``kept`` of a template are also cut before the shuffle.
            first = met.withColumn("_rn", F.row_number().over(mine.orderBy("cost", "negative_id"))).where(F.col("_rn") <= kept)
            sure = first if bound is None else first.where(F.col("cost") < bound)
            least = 1 if bound is None else enough
            offers = materialize(sure.withColumn("_n", F.count(F.lit(1)).over(mine)).where(F.col("_n") >= least).drop("_n", "_rn"))
            found.append(offers)
            need = materialize(need.join(self.sent(offers.select("template_id").distinct()), "template_id", "left_anti"))
            if need.isEmpty():
                break
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def match_negatives(templates: DataFrame, negatives: DataFrame, controls: Sequence[str], cap: int, prior: DataFrame | None = None,
                    strict: bool = True, lanes: Sequence[str] = ("split",), grid: Sequence[str] | None = None, batches: int = 3,
                    goals: DataFrame | None = None) -> DataFrame:
    """Give each template its nearest free negative, none used twice.

    Both tables hold the ``lanes`` (``split`` among them), cluster_id, pair_id, frame_a, frame_b, gap_bin
    and the control columns; a template meets negatives of its lane only. It looks at those
    of its own frame pair, or, if none is free there, of its gap bin with a frame penalty.
    A cluster gives at most ``cap`` negatives over all lanes of its split, less what ``prior``
    (split, cluster_id, used) counts.

    Templates come in ``batches`` drawn by hash. From the second on, a negative's cost holds
    how far it would leave the mean of the lane's matches from the lane's mean in ``goals``
    (lanes and controls; the templates by default). Within a batch costs stand still, and rounds of mutual best choices end when nothing can be
    added. The rounds run on kept offers, a few per template. Only templates that have
    used up theirs are searched again, for twice as many, so a batch of T templates
    searches at most about log2(T) times; no candidate is ever dropped.

    ``grid`` names the two controls that the first ring is blocked on (default: the last two).
    Templates left without a negative are an error, unless ``strict`` is off.
    """
    lanes = list(lanes)
    size = len(controls)
    stats = templates.groupBy(*lanes).agg(
        *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd{i}") for i, c in enumerate(controls)],
        F.count(F.lit(1)).alias("n"),
    ).collect()  # a row per lane
    aims = (templates if goals is None else goals).groupBy(*lanes).agg(*[F.avg(c).alias(f"mean{i}") for i, c in enumerate(controls)]).collect()
    asked = sum(r["n"] for r in stats)
    if not asked:
        raise ValueError("no templates")
    lane = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in lanes])
    name_of = {"\x1f".join(str(r[c]) for c in lanes): r for r in stats}
    aim_of = {"\x1f".join(str(r[c]) for c in lanes): r for r in aims}

    def per_lane(value) -> Column:
        return F.create_map(*[F.lit(x) for name, r in name_of.items() for x in (name, float(value(name, r)))])[lane]

    spread = [lambda r, i=i: r[f"sd{i}"] if r[f"sd{i}"] >= FLAT_SCALE else 1.0 for i in range(size)]
    scaled = [F.col(c) / per_lane(lambda _, r, i=i: spread[i](r)) for i, c in enumerate(controls)]
    wanted = materialize(templates.select(
        *lanes, "gap_bin", F.col("pair_id").alias("template_id"), F.col("frame_a").alias("_ta"), F.col("frame_b").alias("_tb"),
        *[v.alias(f"_t{i}") for i, v in enumerate(scaled)], F.pmod(F.xxhash64("pair_id"), F.lit(batches)).alias("_batch"),
    ))
    pool = stage(negatives.where(lane.isin(list(name_of))).select(
        *lanes, "gap_bin", F.col("pair_id").alias("negative_id"), "cluster_id", "frame_a", "frame_b", *[v.alias(f"_z{i}") for i, v in enumerate(scaled)]
    ), "negatives")
    ends = pool.select("frame_a", "frame_b").unionByName(wanted.select(F.col("_ta").alias("frame_a"), F.col("_tb").alias("frame_b")))
    reach = ends.agg(F.greatest(F.max("frame_a") - F.min("frame_a"), F.max("frame_b") - F.min("frame_b"))).first()[0]
    sent = F.broadcast if asked <= SENT_TEMPLATES else (lambda df: df)
    search = _Search(lanes, size, [controls.index(c) for c in (grid or controls[-2:])], int(reach), sent)
    parts = pool.sparkSession.sparkContext.defaultParallelism
    matched: DataFrame | None = None

    def used_now() -> DataFrame | None:
        mine = None if matched is None else matched.groupBy("split", "cluster_id").agg(F.count(F.lit(1)).alias("used"))
        if mine is None or prior is None:
            return mine if prior is None else prior
        return prior.unionByName(mine).groupBy("split", "cluster_id").agg(F.sum("used").alias("used"))

    def still_free(rows: DataFrame) -> DataFrame:
        """``rows`` whose negative is free, with what their cluster has given so far."""
        used = used_now()
        if matched is not None:
            rows = rows.join(sent(matched.select("negative_id")), "negative_id", "left_anti")
        if used is None:
            return rows.withColumn("used", F.lit(0).cast("bigint"))
        return rows.join(used, ["split", "cluster_id"], "left").withColumn("used", F.coalesce("used", F.lit(0))).where(F.col("used") < cap)

    for batch in range(batches):
        pull = F.lit(0.0)
        if matched is not None:
            sums = {"\x1f".join(str(r[c]) for c in lanes): r for r in matched.groupBy(*lanes).agg(
                F.count(F.lit(1)).alias("m"), *[F.sum(f"_z{i}").alias(f"s{i}") for i in range(size)]).collect()}
            count = per_lane(lambda name, _: sums[name]["m"] if name in sums else 0)
            offs = [
                (per_lane(lambda name, _, i=i: sums[name][f"s{i}"] if name in sums else 0.0) + F.col(f"_z{i}")) / (count + 1) - per_lane(lambda name, r, i=i: aim_of[name][f"mean{i}"] / spread[i](r))
                for i in range(size)
            ]
            pull = F.when(count > 0, MEAN_BALANCE_WEIGHT * sum((F.pow(o, 2) for o in offs), F.lit(0.0))).otherwise(0.0)
        priced = pool.withColumn("_pull", pull)
        todo, lists, turn = materialize(wanted.where(F.col("_batch") == batch).drop("_batch")), None, 0
        while True:
            # Only what was accepted is written in a round; who waits and what is free follow from it.
            waiting = todo if matched is None else todo.join(sent(matched.select("template_id")), "template_id", "left_anti")
            if waiting.isEmpty():
                break
            live = None if lists is None else still_free(lists).join(sent(waiting.select("template_id")), "template_id", "left_semi")
            need = waiting if live is None else waiting.join(sent(live.select("template_id").distinct()), "template_id", "left_anti")
            if live is None or not need.isEmpty():
                offers = search(materialize(need), still_free(priced).drop("used"), turn)
                lists, turn = materialize((offers if live is None else offers.unionByName(live.drop("used"))).coalesce(parts)), turn + 1
                # Those that found nothing have nothing left: what is free only ever shrinks.
                todo = materialize(waiting.join(sent(lists.select("template_id").distinct()), "template_id", "left_semi").coalesce(parts))
                live = still_free(lists)
            names = [c for c in live.columns if c not in ("template_id", "cost", "negative_id")]
            best = live.groupBy("template_id").agg(F.min(F.struct("cost", "negative_id", *names)).alias("_o")).select("template_id", "_o.*")
            order = Window.partitionBy("negative_id").orderBy("cost", "template_id")
            mutual = best.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
            place = F.row_number().over(Window.partitionBy("split", "cluster_id").orderBy("cost", "template_id"))
            taken = mutual.withColumn("_rn", place).where(F.col("used") + F.col("_rn") <= cap).drop("_rn", "used", "split")
            step = todo.select(*lanes, "gap_bin", "template_id").join(taken, "template_id")
            matched = materialize((step if matched is None else matched.unionByName(step)).coalesce(parts))
    done = matched.count()
    if strict and done < asked:
        raise ValueError(f"{asked - done} of {asked} templates have no negative left")
    if not done:
        raise ValueError("no negative fits any template")
    return matched.select(
        *lanes, "gap_bin", "template_id", "negative_id", "cluster_id", F.round("direct", 9).alias("distance"), F.col("same_frames").alias("exact_frames")
    )

"""Detection of ranges in series, and operations on intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.definitions import THRESHOLDS, parents_first, parse_config
from ..schema import KEY
from ..session import durable
from .slices import cut, earlier

RANGES_OF_DEFINITIONS = "test_run_id long, definition string, node string, parent_node string, name string, label string, color string, start_ms double, end_ms double"

#: Conditions on a value; the last two compare with a pair.
CONDITIONS = {
    ">": lambda y, a: y > a, ">=": lambda y, a: y >= a, "<": lambda y, a: y < a, "<=": lambda y, a: y <= a,
    "=": lambda y, a: y == a, "!=": lambda y, a: y != a,
    "between": lambda y, a: (y >= a[0]) & (y <= a[1]), "outside": lambda y, a: (y < a[0]) | (y > a[1]),
}


def condition(y: Column, op: str, level) -> Column:
    if op not in CONDITIONS:
        raise ValueError(f"unknown condition {op!r}")
    return CONDITIONS[op](y, level)


def threshold_ranges(series: DataFrame, op: str, level, sustain_ms: float = 0.0) -> DataFrame:
    """(run, channel, start_ms, end_ms) of unbroken stretches on which the condition holds, at least sustain_ms from first to last sample."""
    rows = series.where(F.col("y").isNotNull()).withColumn("_on", condition(F.col("y"), op, level))
    return stretches(rows, KEY).where(F.col("end_ms") - F.col("start_ms") >= sustain_ms)


def stretches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start_ms, end_ms) of the unbroken stretches of rows that are _on, by x_ms and y.

    Long runs are cut into slices. Stretches that reach the edges of their slices are then put together: a row for each stretch.
    """
    c = cut(rows.select(*keys, "x_ms", "y", "_on"), keys)
    order = c.ordered("x_ms", "y")
    c = c.with_columns({"_before": F.lag("_on").over(order)} | ({"_ends": F.lead("_on").over(order).isNull()} if c.sliced else {}))
    c = c.with_columns({"_new": (F.col("_on") & ~F.coalesce(F.col("_before"), F.lit(False))).cast("int")})
    marked = c.with_columns({"_run": F.sum("_new").over(c.upto("x_ms", "y"))}).df
    on = F.when(F.col("_on"), F.col("x_ms"))
    if not c.sliced:
        return marked.where("_on").groupBy(*keys, "_run").agg(F.min("x_ms").alias("start_ms"), F.max("x_ms").alias("end_ms")).drop("_run")
    opens, closes = F.max(F.col("_on") & F.col("_before").isNull()).alias("_opens"), F.max(F.col("_on") & F.col("_ends")).alias("_closes")
    parts = marked.groupBy("_key", "_slice", "_run").agg(F.min(on).alias("start_ms"), F.max(on).alias("end_ms"), opens, closes)
    # slices are numbered before those without a stretch go; slices without samples are no gap
    met = parts.withColumn("_seq", F.dense_rank().over(Window.partitionBy("_key").orderBy("_slice"))).where("start_ms is not null")
    by = Window.partitionBy("_key").orderBy("_seq", "_run")
    goes_on = F.col("_opens") & F.lag("_closes", 1, False).over(by) & (F.lag("_seq").over(by) == F.col("_seq") - 1)
    met = met.withColumn("_first", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    met = met.withColumn("_group", F.sum("_first").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = met.groupBy("_key", "_group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return found.select("_key.*", "start_ms", "end_ms")


def edge_ranges(series: DataFrame, level: float, rising: bool = True, window_ms: float = 0.0) -> DataFrame:
    """Ranges of window_ms (or 1 ms) from each sample at which the value crosses the level. The sample before may be of an earlier slice."""
    c = cut(series.where(F.col("y").isNotNull()).select(*KEY, "x_ms", "y"), KEY)
    c = c.carried(
        {"_last": F.max_by("y", F.struct("x_ms", "y"))}, lambda s: {"_last": F.last("_last").over(earlier())}, {"_last": F.lit(None).cast("double")},
    )
    before = F.coalesce(F.lag("y").over(c.ordered("x_ms", "y")), F.col("_last"))
    rows = c.with_columns({"_before": before}).df
    crossed = (F.col("_before") < level) & (F.col("y") >= level) if rising else (F.col("_before") > level) & (F.col("y") <= level)
    width = window_ms if window_ms > 0 else 1.0
    return rows.where(crossed).select(*KEY, F.col("x_ms").alias("start_ms"), (F.col("x_ms") + width).alias("end_ms"))


def extremum_ranges(series: DataFrame, greatest: bool = True, window_ms: float = 0.0) -> DataFrame:
    """A range of window_ms around the first greatest (or least) sample of each series; without a window, 1 ms from it."""
    rows = series.where(F.col("y").isNotNull())
    best = F.min(F.struct((-F.col("y") if greatest else F.col("y")).alias("o"), F.col("x_ms").alias("x_ms")))
    centre = F.col("best.x_ms")
    start, end = (centre - window_ms / 2, centre + window_ms / 2) if window_ms > 0 else (centre, centre + 1.0)
    return rows.groupBy(*KEY).agg(best.alias("best")).select(*KEY, start.alias("start_ms"), end.alias("end_ms"))


def detect(series: DataFrame, rule: dict) -> DataFrame:
    """Ranges by a rule of kind threshold (op, value, sustain_ms), edge (direction, threshold, window_ms) or formula (expr, window_ms).

    The config may be JSON. What it does not say has a default; unknown kinds, ops, directions and expressions are errors.
    """
    kind, config = str(rule["kind"]).strip().lower(), parse_config(rule.get("config") or {})
    own = series.where(F.col("channel_name") == rule["channel_name"]) if rule.get("channel_name") else series
    window_ms = max(0.0, float(config.get("window_ms") or 0))

    def choice(key: str, default: str, known: tuple[str, ...]) -> str:
        value = str(config.get(key) or default).strip().lower()
        if value not in known:
            raise ValueError(f"{key} of a {kind} rule must be one of {', '.join(known)}")
        return value

    if kind == "threshold":
        return threshold_ranges(own, choice("op", ">", THRESHOLDS), float(config["value"]), float(config.get("sustain_ms") or 0))
    if kind == "edge":
        return edge_ranges(own, float(config["threshold"]), choice("direction", "rising", ("rising", "falling")) == "rising", window_ms)
    if kind == "formula":
        return extremum_ranges(own, choice("expr", "max", ("max", "min")) == "max", window_ms)
    raise ValueError(f"unknown rule kind {kind!r}")


def named(ranges: DataFrame, label: str) -> DataFrame:
    """Ranges with names: the label, numbered in time order where a run has several."""
    by = Window.partitionBy("test_run_id")
    n, i = F.count("*").over(by), F.row_number().over(by.orderBy("start_ms", "end_ms"))
    return ranges.withColumn("name", F.when(n > 1, F.concat(F.lit(f"{label} "), i.cast("string"))).otherwise(F.lit(label)))


def pair(starts: DataFrame, ends: DataFrame, last: bool = False) -> DataFrame:
    """For each start region the range to the first (or last) end of an end region behind it, by run; regions without one go.

    The ends are sorted among the starts and looked up by a window, so the work grows with their number, not with their product.
    """
    marks = starts.select("test_run_id", F.col("start_ms").alias("at"), F.lit(1).alias("side"))
    marks = marks.unionByName(ends.select("test_run_id", F.col("end_ms").alias("at"), F.lit(0).alias("side")))
    # ends at the very start sort before it and are not behind it
    behind = Window.partitionBy("test_run_id").orderBy("at", "side").rowsBetween(1, Window.unboundedFollowing)
    end = F.when(F.col("side") == 0, F.col("at"))
    found = marks.withColumn("end_ms", (F.max(end) if last else F.min(end)).over(behind))
    return found.where((F.col("side") == 1) & F.col("end_ms").isNotNull()).select("test_run_id", F.col("at").alias("start_ms"), "end_ms")


def _threshold_of(part: dict) -> tuple[str, str, float] | None:
    """(channel, op, value) of a start or end condition that detection knows."""
    names, op = part.get("channels") or [], part.get("op", ">")
    return (names[0], op, float(part["value"])) if names and part.get("value") is not None and op in THRESHOLDS else None


def _regions(series: DataFrame, wanted: list[tuple[str, str, float]]) -> DataFrame:
    """(test_run_id, condition, start_ms, end_ms): the stretches of all conditions by their place in wanted, in one pass over the series."""
    which = F.lit(None).cast("array<int>")
    for channel in dict.fromkeys(c for c, _, _ in wanted):
        which = F.when(F.col("channel_name") == channel, F.array(*[F.lit(k) for k, w in enumerate(wanted) if w[0] == channel])).otherwise(which)
    rows = series.where(F.col("channel_name").isin(sorted({c for c, _, _ in wanted})) & F.col("y").isNotNull()).select("test_run_id", "x_ms", "y", F.explode(which).alias("condition"))
    on = F.lit(False)
    for k, (_, op, level) in enumerate(wanted):
        on = F.when(F.col("condition") == k, condition(F.col("y"), op, level)).otherwise(on)
    return stretches(rows.withColumn("_on", on), ["test_run_id", "condition"])


def _node_ranges(regions: DataFrame, wanted: list[tuple[str, str, float]], node: dict) -> DataFrame:
    pick = lambda part: F.max if part.get("occurrence") == "last" else F.min
    of = lambda part: regions.where(F.col("condition") == wanted.index(_threshold_of(part)))
    first = of(node["start"]).groupBy("test_run_id").agg(pick(node["start"])("start_ms").alias("start_ms"))
    behind = of(node["end"]).select("test_run_id", "end_ms").join(first, "test_run_id").where(F.col("end_ms") > F.col("start_ms"))
    return behind.groupBy("test_run_id", "start_ms").agg(pick(node["end"])("end_ms").alias("end_ms")).withColumn("name", F.lit(node["name"]))


def apply_definition(series: DataFrame, node: dict) -> DataFrame | None:
    """(test_run_id, start_ms, end_ms, name): the range of a definition node in each run, None where the node has no threshold conditions.

    It goes from the start of the first (or last) region of the start condition to the first (or last) end of a region of the end
    condition behind that; runs without either have none. Both are aggregates by run, so nothing is paired.
    """
    wanted = list(dict.fromkeys(_threshold_of(node[end]) for end in ("start", "end")))
    return None if None in wanted else _node_ranges(_regions(series, wanted), wanted, node)


def apply_definitions(series: DataFrame, definitions: list[dict]) -> DataFrame:
    """(test_run_id, definition, node, parent_node, name, label, color, start_ms, end_ms) of the nodes of all definitions, parents included.

    parent_node is null where the parent has no range in the run. The samples are read once, for the stretches of all distinct conditions; these are
    stored, and nodes are made of the few that they are.
    """
    columns = ["test_run_id", "definition", "node", "parent_node", "name", "label", "color", "start_ms", "end_ms"]
    nodes = [(d["name"], n) for d in definitions for n in parents_first(d["nodes"]) if _threshold_of(n["start"]) and _threshold_of(n["end"])]
    wanted = list(dict.fromkeys(_threshold_of(n[end]) for _, n in nodes for end in ("start", "end")))
    out = series.sparkSession.createDataFrame([], RANGES_OF_DEFINITIONS)
    if not wanted:
        return out
    regions = durable(_regions(series, wanted))
    made: dict[tuple[str, str], DataFrame] = {}
    for definition, node in nodes:
        found = _node_ranges(regions, wanted, node)
        made[definition, node["id"]] = found.select("test_run_id")
        given = made.get((definition, node.get("parent_id")))
        runs = given.withColumn("parent_node", F.lit(node["parent_id"])) if given is not None else None
        found = found.join(runs, "test_run_id", "left") if runs is not None else found.withColumn("parent_node", F.lit(None).cast("string"))
        values = {"definition": definition, "node": node["id"], "label": node.get("label"), "color": node.get("color")}
        out = out.unionByName(found.withColumns({k: F.lit(v).cast("string") for k, v in values.items()}).select(*columns))
    return out


def source_ranges(series: DataFrame) -> DataFrame:
    """The full span of each run."""
    return series.groupBy("test_run_id").agg(F.min("x_ms").alias("start_ms"), F.max("x_ms").alias("end_ms"))


def adopt(ranges: DataFrame, sources: DataFrame) -> DataFrame:
    """Gives root ranges that lie inside their run's source range that range as parent; others stay as they are.

    ranges(range_id, test_run_id, parent_range_id, start_ms, end_ms), sources(range_id, test_run_id, start_ms, end_ms), one for a run.
    """
    s = sources.select("test_run_id", F.col("range_id").alias("_source"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    inside = F.col("parent_range_id").isNull() & (F.col("range_id") != F.col("_source")) & (F.col("start_ms") >= F.col("_from")) & (F.col("end_ms") <= F.col("_to"))
    joined = ranges.join(s, "test_run_id", "left")
    return joined.withColumn("parent_range_id", F.when(F.coalesce(inside, F.lit(False)), F.col("_source")).otherwise(F.col("parent_range_id"))).select(*ranges.columns)


def with_parents_checked(ranges: DataFrame, parents: DataFrame) -> DataFrame:
    """ranges with a column fault: why a range can't have its parent_range_id, null where it can or has none.

    parents(range_id, test_run_id, start_ms, end_ms). A parent must exist, be another range, be of the same run, and contain its child.
    """
    p = parents.select(F.col("range_id").alias("_id"), F.col("test_run_id").alias("_run"), F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    joined = ranges.join(p, F.col("parent_range_id") == F.col("_id"), "left")
    fault = (
        F.when(F.col("parent_range_id").isNull(), None)
        .when(F.col("parent_range_id").eqNullSafe(F.col("range_id")), "own parent")
        .when(F.col("_id").isNull(), "no such parent")
        .when(~F.col("_run").eqNullSafe(F.col("test_run_id")), "parent of another run")
        .when((F.col("start_ms") < F.col("_from")) | (F.col("end_ms") > F.col("_to")), "not inside its parent")
    )
    return joined.withColumn("fault", fault).select(*ranges.columns, "fault")


def unified(sources: list[DataFrame]) -> DataFrame:
    """Ranges of several sources in time order; of those with one range_id, artifact_id and test_id the first source's stays."""
    rows = None
    for k, df in enumerate(sources):
        own = df.withColumn("_source", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    rows = rows if "artifact_id" in rows.columns else rows.withColumn("artifact_id", F.lit(None).cast("string"))
    by = Window.partitionBy("range_id", "artifact_id", "test_id").orderBy("_source", "start_ms")
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "_source").orderBy("start_ms", "range_id")


def delete_range(ranges: DataFrame, range_id: int) -> DataFrame:
    """Without the range, unless it is a source range; its children go to their run's source range."""
    sources = ranges.where(F.col("source") == "source").groupBy("test_run_id").agg(F.min("range_id").alias("_source"))
    gone = (F.col("range_id") == range_id) & (F.col("source") != "source")
    orphan = F.col("parent_range_id") == range_id
    left = ranges.where(~gone).join(sources, "test_run_id", "left")
    return left.withColumn("parent_range_id", F.when(orphan, F.col("_source")).otherwise(F.col("parent_range_id"))).select(*ranges.columns)


def merged(ranges: DataFrame) -> DataFrame:
    """Disjoint ranges of each run that cover the same times."""
    order = Window.partitionBy("test_run_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("_new", (reach.isNull() | (F.col("start_ms") > reach)).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("test_run_id", "_group").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_group")


def mask(series: DataFrame, ranges: DataFrame, inside: bool = True) -> DataFrame:
    """Samples inside (or outside) any of their run's ranges.

    Ranges are merged first; a sample then lies in one at most, and the last start before it decides: one sort by run and time.
    """
    marks = merged(ranges).select("test_run_id", F.col("start_ms").alias("x_ms"), F.col("end_ms").alias("_upto"), F.lit(0).alias("_side"))
    rows = series.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    last = F.last("_upto", ignorenulls=True).over(Window.partitionBy("test_run_id").orderBy("x_ms", "_side").rowsBetween(Window.unboundedPreceding, 0))
    within = F.coalesce(F.col("x_ms") <= last, F.lit(False))
    return rows.withColumn("_within", within).where((F.col("_side") == 1) & (F.col("_within") == inside)).select(*series.columns)


def summary(series: DataFrame, ranges: DataFrame, low: float | None = None, high: float | None = None, warn: float = 0.0) -> DataFrame:
    """Statistics of each channel in each range(range_id, test_run_id, start_ms, end_ms), with a limit status.

    fail: the extrema leave [low, high]; warn: they come within `warn` of a limit; else ok. Ranges meet samples by slots of time. A range has
    the slots of the next power of two to its own length, of which it touches two, so it is two rows however long it is; a sample is looked up once for
    each such length that its run has.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1.0))
    own = ranges.where(F.col("start_ms") <= F.col("end_ms")).select("range_id", "test_run_id", "start_ms", "end_ms", F.pow(F.lit(2.0), F.ceil(F.log2(length))).alias("_width"))
    slot = lambda c: F.floor(F.col(c) / F.col("_width"))
    placed = own.withColumn("_slot", F.explode(F.sequence(slot("start_ms"), slot("end_ms"))))
    widths = own.select("test_run_id", "_width").distinct()
    rows = series.join(widths, "test_run_id").withColumn("_slot", slot("x_ms")).join(placed, ["test_run_id", "_width", "_slot"])
    rows = rows.where((F.col("x_ms") >= F.col("start_ms")) & (F.col("x_ms") <= F.col("end_ms")))
    out = rows.groupBy("range_id", *KEY).agg(F.count("y").alias("n"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("y").alias("mean_y"))
    below = lambda margin: F.lit(False) if low is None else F.col("min_y") < low + margin
    above = lambda margin: F.lit(False) if high is None else F.col("max_y") > high - margin
    return out.withColumn("status", F.when(below(0) | above(0), "fail").when(below(warn) | above(warn), "warn").otherwise("ok"))

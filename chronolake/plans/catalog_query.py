"""Series requests that go through the catalog: by test, by artifact, or for the planner's request."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.store import Catalog
from ..operators import series as ops
from ..schema import SERIES
from ..sinks.lake import read_series
from ..sources.star import overlay
from .query import SeriesRequest, run

READY = "ready"


def ready_test(catalog: Catalog, test_id: int | None = None, artifact_id: str | None = None) -> dict:
    what = f"test {test_id}" if test_id is not None else f"artifact {artifact_id!r}"
    test = catalog.get_test(test_id, artifact_id)
    if test is None:
        raise ValueError(f"there is no {what}")
    if test["status"] != READY:
        raise ValueError(f"{what} is not ready but {test['status']!r}")
    return test


def catalog_series(catalog: Catalog, lake: str, test_id: int, channels: list[str] | None = None, start_ms: float | None = None, end_ms: float | None = None) -> DataFrame:
    """Series of a test that is ready. Only channels that the catalog lists are read, and it is an error if it lists none of them."""
    ready_test(catalog, test_id)
    names = [r.channel_name for r in catalog.channel_entries(test_id, channels).select("channel_name").collect()]  # those of one test
    if not names:
        raise ValueError(f"test {test_id} has none of the channels")
    return read_series(catalog.spark, lake, [test_id], names, start_ms, end_ms)


def artifact_series(catalog: Catalog, lake: str, artifact_id: str, channels: list[str] | None = None, start_ms: float | None = None, end_ms: float | None = None) -> DataFrame:
    """Series of the test that was made of a file. Channels that it lacks are passed over; without any left there are no rows."""
    test = ready_test(catalog, artifact_id=artifact_id)
    names = [r.channel_name for r in catalog.channel_entries(test["test_id"], channels).select("channel_name").collect()]
    if not names:
        return catalog.spark.createDataFrame([], SERIES)
    return read_series(catalog.spark, lake, [test["test_id"]], names, start_ms, end_ms)


def strategy_summary(plans: list[str]) -> str:
    """The strategy of all, or `mixed`; raw if there is none."""
    return plans[0] if len(set(plans)) == 1 else "mixed" if plans else "raw"


def execute(sources: dict[str, DataFrame], request: SeriesRequest) -> tuple[DataFrame, dict]:
    """(series with their source, answer) over several sources: each is planned and reduced by itself.

    The answer has the strategy of all, and as small frames the meta of each series and whether a detail request would show more.
    """
    frames, plans = {}, []
    for label, series in sources.items():
        frames[label], plan = run(series, request)
        plans.append(plan)
    rows = overlay(frames)
    answer = {"strategy": strategy_summary([p["strategy"] for p in plans]), "cap": plans[0]["cap"], "meta": ops.meta(rows)}
    if answer["cap"]:
        answer["hint"] = ops.detail_hint(rows, answer["cap"])
    return rows, answer


def overview_envelope(sources: dict[str, DataFrame], request: SeriesRequest) -> tuple[DataFrame, dict]:
    """execute() as an overview of all sources, in the order of time."""
    rows, answer = execute(sources, replace(request, mode="overview"))
    return rows.orderBy("x_ms", "source", "test_run_id", "channel_name"), answer


def first_rows(series: DataFrame, limit: int, points: int | None = None) -> DataFrame:
    """The first rows of all series together in time order, reduced to points of each; rows of one time come by run and channel.

    A limit on all series together leaves late channels out, so requests use a limit for each; this is the older form.
    """
    rows = series.orderBy("x_ms", "test_run_id", "channel_name", "y").limit(max(1, min(limit, 5_000_000)))
    return ops.lttb(rows, points) if points else rows


def in_output_order(series: DataFrame) -> DataFrame:
    return series.orderBy("test_run_id", "channel_name", "x_ms", F.col("y"))

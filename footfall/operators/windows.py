"""Behaviour measures that look at neighbouring rows or at one page view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.measures import ratio
from footfall.functions.times import epoch_millis

CLICK_SLICE_MS = 60_000


def rage_clicks(clicks: DataFrame, ms: int = 800, px: int = 30, n: int = 3) -> DataFrame:
    """Clicks that are the n-th on one element within ``ms`` and ``px`` of themselves.

    Needs session_id, pv, element, ts, x, y, click_id. Rows sharing a time are taken in click_id order. The page is cut into
    cells of ``px``: clicks of one cell are all near each other, so one that has n or more behind it in its cell
    within ``ms`` is no n-th. Few are left of a burst (n a cell and ``ms``); they alone look into their nine cells and the
    last two stretches of ``ms`` and count. Windows go by element, cell and minute, with those of the last ``ms`` of a minute shown
    to the next minute as well.
    """
    spot, names = ["session_id", "pv", "element"], clicks.columns
    rows = clicks.withColumns({
        "_t": epoch_millis("ts"), "_cx": F.floor(F.col("x") / px), "_cy": F.floor(F.col("y") / px),
        "_spot": F.struct(*[F.col(c) for c in spot]),
    }).withColumns({"_m": F.floor(F.col("_t") / CLICK_SLICE_MS), "_b": F.floor(F.col("_t") / ms)})
    late = F.col("_t") >= (F.col("_m") + 1) * CLICK_SLICE_MS - ms
    shown = rows.withColumn("_s", F.explode(F.when(late, F.array(F.col("_m"), F.col("_m") + 1)).otherwise(F.array(F.col("_m")))))
    w = Window.partitionBy("_spot", "_cx", "_cy", "_s").orderBy("_t", "click_id")
    behind = F.lag("_t", n).over(w)
    few = shown.withColumn("_far", behind.isNull() | (F.col("_t") - behind >= ms)).where((F.col("_s") == F.col("_m")) & F.col("_far"))
    around = F.array(*[F.struct((F.col("_cx") + i).alias("cx"), (F.col("_cy") + j).alias("cy"), (F.col("_b") - k).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (0, 1)])
    probes = few.select(F.struct(*names).alias("_row"), "_spot", "_t", "x", "y", "click_id", F.explode(around).alias("_a"))
    probes = probes.select("*", F.col("_a.cx").alias("_cx"), F.col("_a.cy").alias("_cy"), F.col("_a.b").alias("_b")).drop("_a")
    near = rows.select("_spot", "_cx", "_cy", "_b", F.col("_t").alias("_u"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("click_id").alias("_id"))
    null_safe = [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_spot", "_cx", "_cy", "_b")]
    before = (F.col("_u") < F.col("_t")) | ((F.col("_u") == F.col("_t")) & (F.col("_id") <= F.col("p.click_id")))
    close = (F.abs(F.col("_x") - F.col("p.x")) < px) & (F.abs(F.col("_y") - F.col("p.y")) < px) & (F.col("_t") - F.col("_u") < ms) & before
    pairs = probes.alias("p").join(near.alias("r"), [*null_safe, close])
    counted = pairs.groupBy("p._spot", "p.click_id").agg(F.count("*").alias("_n"), F.first("p._row").alias("_row"))
    return counted.where(F.col("_n") == n).select("_row.*")


def run_deltas(runs: DataFrame, keep: int = 10) -> DataFrame:
    """Last complete audit runs, oldest first, with the change against the run before."""
    metrics = ["health", "errors", "warnings", "notices"]
    # The oldest kept row also needs no predecessor: the history itself is what is compared.
    last = runs.where(F.col("status") == "complete").orderBy(F.desc("run_id")).limit(keep)
    w = Window.partitionBy(F.lit(1)).orderBy("run_id")
    return last.select(
        "run_id", "finished_at", *metrics, "pages",
        *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_delta") for m in metrics],
    ).orderBy("run_id")


def pageview_depth(events: DataFrame) -> DataFrame:
    """Deepest scroll milestone and longest engaged time per page view."""
    a = F.get_json_object("attributes", "$.pv")
    return (
        events.where(F.col("event_name") == "page_engagement")
        .select(
            "session_id", a.alias("pv"),
            F.get_json_object("attributes", "$.scroll_depth").try_cast("int").alias("s"),
            F.get_json_object("attributes", "$.engaged_seconds").try_cast("bigint").alias("e"),
        )
        .groupBy("session_id", "pv")
        .agg(F.coalesce(F.max("s"), F.lit(0)).alias("scroll_depth"), F.coalesce(F.max("e"), F.lit(0)).alias("engaged_seconds"))
    )


def scroll_milestone(percent):
    """25, 50, 75 or 100 reached, 0 for none; 99 percent counts as the end."""
    c = F.col(percent) if isinstance(percent, str) else percent
    return F.when(c >= 99, 100).when(c >= 75, 75).when(c >= 50, 50).when(c >= 25, 25).otherwise(0)


def form_visits(events: DataFrame) -> DataFrame:
    """One row per page view and form from field focus and submit rows.

    Needs session_id, pv, form_id, kind ('focus' or 'submit'), field, occurred_at, event_id.
    """
    focus = F.col("kind") == "focus"
    order = F.when(focus, F.struct("occurred_at", "event_id"))
    per_field = events.groupBy("session_id", "pv", "form_id", F.when(focus, F.col("field")).alias("field")).agg(
        F.max(focus.cast("int")).alias("started"),
        F.max((F.col("kind") == "submit").cast("int")).alias("submitted"),
        F.max(order).alias("at"),
    )
    return per_field.groupBy("session_id", "pv", "form_id").agg(
        F.max("started").alias("started"),
        F.max("submitted").alias("submitted"),
        F.count("field").alias("fields_touched"),
        F.max_by("field", "at").alias("last_field"),
    ).withColumn("abandoned", ((F.col("started") == 1) & (F.col("submitted") == 0)).cast("int"))


def form_funnel(events: DataFrame) -> DataFrame:
    """Per form: page views that started, submitted or abandoned it, and completion."""
    return (
        form_visits(events)
        .groupBy("form_id")
        .agg(
            F.sum("started").alias("started"),
            F.sum("submitted").alias("submitted"),
            F.sum("abandoned").alias("abandoned"),
            F.sum("fields_touched").alias("fields_touched"),
        )
        .withColumn("completion_rate", ratio("submitted", "started", 4))
    )


def video_funnel(events: DataFrame) -> DataFrame:
    """Per video: page views that started it, passed each quarter and finished. Needs pv, video_id, event_name, percent."""
    passed = {
        "started": F.col("event_name") == "video_start",
        "p25": (F.col("event_name") == "video_progress") & (F.col("percent") == 25),
        "p50": (F.col("event_name") == "video_progress") & (F.col("percent") == 50),
        "p75": (F.col("event_name") == "video_progress") & (F.col("percent") == 75),
        "completed": F.col("event_name") == "video_complete",
    }
    per_view = events.groupBy("session_id", "pv", "video_id").agg(
        *[F.max(c.cast("int")).alias(n) for n, c in passed.items()]
    )
    return (
        per_view.groupBy("video_id")
        .agg(*[F.sum(n).alias(n) for n in passed])
        .withColumn("completion_rate", ratio("completed", "started", 4))
    )


def web_vitals(events: DataFrame, accuracy: int = 10000) -> DataFrame:
    """75th percentile of each vital per path, one reading per page view, from a mergeable sketch."""
    names = ["lcp_ms", "cls", "inp_ms"]
    rows = events.where(F.col("event_name") == "web_vitals").select(
        "page_path", *[F.get_json_object("attributes", f"$.{n}").try_cast("double").alias(n) for n in names]
    )
    return rows.groupBy("page_path").agg(
        F.count("*").alias("readings"),
        *[F.percentile_approx(n, 0.75, accuracy).alias(f"{n}_p75") for n in names],
    )

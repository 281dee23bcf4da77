"""State machines over ticks: one step function each, run over a batch or as a stream with the same results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Each machine is (start, step): step(state, tick) -> (state, output), states and outputs being tuples.


def ride_step(state: tuple, tick: dict, top: float = 12.0, ramp: float = 0.004, half: float = 3.0, hop_ms: float = 700.0) -> tuple[tuple, tuple]:
    """A ride: speed ramps up to a top, sideways moves are clamped, a hop lasts a while, hits slow down and cost time.

    state: metres, speed, lateral, hop left, penalty, coins.
    """
    s, v, x, hop, penalty, coins = state
    dt = min(max(tick["dt"] or 0, 0), 60_000)
    v = min(top, v + ramp * dt)
    kind = tick["event_type"]
    hop = max(0.0, hop - dt)
    if kind == "click":
        x = min(half, x + 1.0)
    elif kind == "view":
        x = max(-half, x - 1.0)
    elif kind == "purchase":
        coins += 1
    elif kind == "signup" and hop == 0:
        hop = hop_ms
    elif kind == "error" and hop == 0:
        v, penalty = v / 2, penalty + 2.0
    s += v * dt / 1000
    state = (s, v, x, hop, penalty, coins)
    return state, (round(s, 3), round(v, 3), x, coins, penalty)


RIDE = ((0.0, 0.0, 0.0, 0.0, 0.0, 0), ride_step, "metres double, speed double, lateral double, coins long, penalty double")


def quality_step(state: tuple, tick: dict, window: float = 2000.0, low: float = 55.0, high: float = 58.0, far: float = 12.0, cooldown: float = 3000.0, levels: int = 6, longest: float = 120_000.0) -> tuple[tuple, tuple]:
    """A quality level from frame times: windows close once they hold `window` ms of frames.

    Too slow: a level down, two if far below. Fast enough, and the wait over: a level up as a probe;
    a probe that fails doubles the wait. state: level, ms and frames of the window, cooldown left, wait left, wait, probing.
    """
    level, ms, frames, cool, left, wait, probing = state
    dt = float(tick["dt"] or 0)
    ms, frames, cool, left = ms + dt, frames + 1, max(0.0, cool - dt), max(0.0, left - dt)
    if ms >= window:
        fps = frames * 1000.0 / ms * tick.get("rate", 1.0)
        ms, frames = 0.0, 0
        if fps < low and cool == 0:
            level = min(levels, level + (2 if fps < low - far else 1))
            if probing:
                wait = min(longest, wait * 2)
            left, cool, probing = wait, cooldown, 0
        elif fps >= high and left == 0 and cool == 0 and level > 0:
            level, probing, cool = level - 1, 1, cooldown
    return (level, ms, frames, cool, left, wait, probing), (level,)


QUALITY = ((0, 0.0, 0, 0.0, 0.0, 3000.0, 0), quality_step, "level long")


def visibility_step(state: tuple, tick: dict, near: float = 40.0, band: float = 20.0, every: int = 6) -> tuple[tuple, tuple]:
    """Shown from near on, hidden beyond near + band, looked at every so many frames; no value changes nothing. state: frame, shown."""
    frame, shown = state
    if frame % every == 0 and tick["value"] is not None:
        shown = int(tick["value"] < near + (band if shown else 0))
    return (frame + 1, shown), (bool(shown),)


VISIBILITY = ((0, 0), visibility_step, "shown boolean")


def shown(value: Column, frame: Column, key: str, order: str, near: float = 40.0, band: float = 20.0, every: int = 6) -> Column:
    """visibility_step for a batch, as a window: the last decision counts, and a value between the bounds decides nothing."""
    decided = F.when(frame % every == 0, F.when(value < near, F.lit(True)).when(value >= near + band, F.lit(False)))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(decided, ignorenulls=True).over(so_far), F.lit(False))


def explore_step(state: tuple, tick: dict, bound: float = 500.0, floor: float = 2.0) -> tuple[tuple, tuple]:
    """A flight: moves are clamped to the world, climbing is in proportion to the height. state: x, z, y."""
    x, z, y = state
    dt = min(max(tick["dt"] or 0, 0), 1000) / 1000
    kind, step = tick["event_type"], (tick["value"] or 0.0) * dt
    x = min(bound, max(-bound, x + (step if kind == "click" else -step if kind == "view" else 0)))
    z = min(bound, max(-bound, z + (step if kind == "purchase" else -step if kind == "signup" else 0)))
    y = max(floor, y * (1 + (0.5 if kind == "error" else -0.1) * dt))
    return (x, z, y), (round(x, 3), round(z, 3), round(y, 3))


EXPLORE = ((0.0, 0.0, 20.0), explore_step, "x double, z double, y double")


def run_batch(ticks: DataFrame, machine: tuple, key: str = "user_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The machine's output at every tick; a key's ticks run in order in one task, as each needs the state before it."""
    start, step, schema = machine
    names = [c.split()[0] for c in schema.split(", ")]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order))
        state, out = start, []
        for tick in part.to_dict("records"):
            state, result = step(state, {k: (None if v != v else v) for k, v in tick.items()})
            out.append((tick[key], *[tick[o] for o in order], *result))
        return pd.DataFrame(out, columns=[key, *order, *names])

    kinds = dict(ticks.dtypes)
    return ticks.groupBy(key).applyInPandas(one, ", ".join([f"{c} {kinds[c]}" for c in (key, *order)]) + ", " + schema)


def run_stream(ticks: DataFrame, machine: tuple, key: str = "user_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The same over a stream: the state is kept between micro-batches, ticks of a batch are sorted."""
    start, step, schema = machine
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = dict(ticks.dtypes)
    kept = ", ".join(f"s{k} {'double' if isinstance(v, float) else 'long'}" for k, v in enumerate(start))

    def one(group: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, out = (held.get if held.exists else start), []
        part = pd.concat(list(parts)).sort_values(list(order))
        for tick in part.to_dict("records"):
            state, result = step(tuple(state), {k: (None if v != v else v) for k, v in tick.items()})
            out.append((tick[key], *[tick[o] for o in order], *result))
        held.update(tuple(float(v) if isinstance(s, float) else int(v) for v, s in zip(state, start)))
        yield pd.DataFrame(out, columns=[key, *order, *names])

    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *order)]) + ", " + schema
    return ticks.groupBy(key).applyInPandasWithState(one, schema, kept, "append", "NoTimeout")


def progress(events: DataFrame, weights: dict[str, float], key: str = "user_id") -> DataFrame:
    """Monotone percent from weighted phases: the running sum of first sightings, never falling."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    first = F.row_number().over(Window.partitionBy(key, "event_type").orderBy("seq")) == 1
    done = F.sum(F.when(first, F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(0.0))).otherwise(0.0))
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.select(key, "seq", (done.over(w) / sum(weights.values()) * 100).alias("percent"))


def eta(done: DataFrame, floor: float = 8.0) -> DataFrame:
    """Predicted minutes for the next item from (size, minutes) of those done: a line, not below the floor."""
    from geoloom.operators.aggregates import line_fit

    a, b, sigma = line_fit(F.col("size"), F.col("minutes"))
    return done.agg(F.greatest(a + b * F.avg("size"), F.lit(floor)).alias("minutes"), sigma.alias("sigma"))


Machine = tuple[tuple, Callable, str]

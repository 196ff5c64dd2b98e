"""Stateful processors: calls, heating cycles, timer alarms, day figures and gauges."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from emberline.schema import (
    CALL,
    CLIMATE,
    FLOORS,
    FURNACE,
    LONG_CALL_S,
    MODE_CHANGED,
    NO_RESPONSE_DEFAULT_S,
    NO_RESPONSE_S,
    OUTDOOR,
    OVERSHOOT,
    SETPOINT_CHANGED,
    SETPOINT_MISS,
    SETPOINT_REACHED,
    SILENCE_S,
    SLOW_TO_HEAT,
    SLOW_TO_HEAT_S,
    TEMP_UPDATED,
    TIME_TO_TEMP,
)
from emberline.streaming.ordered import MINUTE_US, OrderedProcessor, _plain

SECOND = 1_000_000
DAY = 86_400 * SECOND


class OrderProcessor(OrderedProcessor):
    """The rows themselves, in event order."""

    output = (("us", "bigint"), ("seq", "bigint"))

    def step(self, key, rows):
        return rows


class CallProcessor(OrderedProcessor):
    """Ended sessions of an on/off entity, keyed by ``(site_id, entity_id)``; equals ``edges.sessions``.

    A missing ``old_state`` is taken from the entity's last state.
    """

    fields = (("floor", "string"), ("old_state", "string"), ("new_state", "string"))
    output = (("floor", "string"), ("us", "bigint"), ("seq", "bigint"), ("started_at", "bigint"), ("duration_s", "bigint"))

    def seed(self, key, rows):
        """``state, since``: the entity's last state, and when its call in progress began."""
        for state, since in zip(*[_plain(rows[c]) for c in ("state", "since")]):
            self.state.update((state, None if since is None else int(since)))

    def step(self, key, rows):
        state, since = self.state.get() or (None, None)
        out = []
        for us, seq, floor, old, new in rows:
            change = (state if old is None else old, new)
            if change == ("off", "on"):
                since = us
            elif change == ("on", "off"):
                out.append((floor, us, seq, since, None if since is None else (us - since) // SECOND))
                since = None
            state = new
        self.state.update((state, since))
        return out


class SiteProcessor(OrderedProcessor):
    """Base of the processors keyed by site: one document of state, a few numbers per zone."""

    fields = (
        ("kind", "string"),
        ("floor", "string"),
        ("old_state", "string"),
        ("new_state", "string"),
        ("setpoint", "double"),
        ("current_temp", "double"),
        ("hvac_action", "string"),
    )

    def seed(self, key, rows):
        """``doc``: the site's document of state as JSON."""
        for doc in rows["doc"].tolist():
            self.save(json.loads(doc))

    def load(self) -> dict:
        return self.state.get() or {"zones": {}, "calls": {}, "outdoor": None, "last": None}

    def save(self, doc: dict) -> None:
        self.state.update(doc)

    @staticmethod
    def edge(call: dict, old: str | None, new: str | None) -> tuple[str | None, str | None]:
        before = call.get("state") if old is None else old
        call["state"] = new
        return before, new


class CycleProcessor(SiteProcessor):
    """Thermostat changes and heating-cycle outcomes, keyed by site so that other zones and outdoor state are local."""

    output = (
        ("event_type", "string"),
        ("floor", "string"),
        ("us", "bigint"),
        ("seq", "bigint"),
        ("duration_s", "bigint"),
        ("start_temp", "double"),
        ("setpoint", "double"),
        ("current_temp", "double"),
        ("peak_temp", "double"),
        ("likely_cause", "string"),
        ("outdoor_temp_f", "double"),
        ("other_zones", "string"),
    )

    def __init__(self, slow_s: Mapping[str, float] = SLOW_TO_HEAT_S, buffered: bool = False, chunk_us: int = MINUTE_US):
        super().__init__(buffered, chunk_us)
        self.slow_s = dict(slow_s)

    def step(self, key, rows):
        doc = self.load()
        out: list[tuple] = []
        for us, seq, kind, floor, old, new, setpoint, temp, action in rows:
            if kind == CALL:
                call = doc["calls"].setdefault(floor, {})
                change = self.edge(call, old, new)
                if change in (("off", "on"), ("on", "off")):
                    call["on"] = new == "on"
            elif kind == OUTDOOR and setpoint is not None:
                doc["outdoor"] = [us // DAY, setpoint]
            elif kind == CLIMATE and not (setpoint is None and temp is None and action is None):
                self._reading(doc, out, us, seq, floor, new, setpoint, temp, action)
        self.save(doc)
        return out

    def _reading(self, doc, out, us, seq, floor, mode, setpoint, temp, action):
        zone = doc["zones"].get(floor, {})
        now = {"setpoint": setpoint, "temp": temp, "mode": mode, "action": action}
        was, heating = zone.get("action") == "heating", action == "heating"
        changed = {f for f, v in now.items() if v is not None and v != zone.get(f)}
        calling = sorted(f for f, c in doc["calls"].items() if c.get("on") and f != floor)
        outdoor = doc["outdoor"][1] if doc["outdoor"] and doc["outdoor"][0] == us // DAY else None
        cycle = zone.get("cycle")
        if heating and not was:
            cycle = {"us": us, "temp": temp, "zones": calling, "reached": None, "post": [], "best": None}

        def emit(event, duration=None, peak=None, cause=None, zones=calling):
            start = cycle["temp"] if cycle else None
            out.append((event, floor, us, seq, duration, start, setpoint, temp, peak, cause, outdoor, ",".join(zones)))

        if "setpoint" in changed:
            emit(SETPOINT_CHANGED)
        if "temp" in changed:
            emit(TEMP_UPDATED)
        if changed & {"mode", "action"}:
            emit(MODE_CHANGED)
        if cycle:
            if was and heating and changed & {"setpoint", "mode"}:
                cycle["adjusted"] = True
            if heating and "temp" in changed:
                cycle["best"] = temp if cycle["best"] is None else max(cycle["best"], temp)
        before = zone.get("temp")
        if was and None not in (temp, setpoint) and temp >= setpoint and (before is None or before < setpoint):
            emit(SETPOINT_REACHED)
            if cycle and cycle["temp"] is not None:
                emit(TIME_TO_TEMP, (us - cycle["us"]) // SECOND)
            if cycle:
                cycle["reached"] = us
                cycle["post"] = self._peak(cycle["post"], temp)
        elif cycle and cycle["reached"] and heating and "temp" in changed:
            cycle["post"] = self._peak(cycle["post"], temp)
        if was and not heating and cycle:
            self._close(emit, cycle, us, setpoint)
            cycle = None
        elif heating and cycle and not cycle["reached"] and not cycle.get("slow") and floor in self.slow_s:
            elapsed = (us - cycle["us"]) // SECOND
            if elapsed >= self.slow_s[floor]:
                emit(SLOW_TO_HEAT, elapsed)
                cycle["slow"] = True
        doc["zones"][floor] = {**now, "cycle": cycle}

    @staticmethod
    def _peak(post: list, temp: float) -> list:
        """Number of readings from the reach on, and the highest of them."""
        return [post[0] + 1, max(post[1], temp)] if post else [1, temp]

    @staticmethod
    def _close(emit, cycle, us, setpoint):
        if cycle["reached"]:
            peak = cycle["post"][1] if cycle["post"][0] > 1 else None
            emit(OVERSHOOT, (us - cycle["reached"]) // SECOND, peak, zones=cycle["zones"])
        elif None not in (setpoint, cycle["temp"]):
            closest = cycle["temp"] if cycle["best"] is None else cycle["best"]
            if setpoint > cycle["temp"] and closest < setpoint:
                cause = "thermostat_adjustment" if cycle.get("adjusted") else "unknown"
                emit(SETPOINT_MISS, (us - cycle["us"]) // SECOND, closest, cause, zones=cycle["zones"])


class AlarmProcessor(SiteProcessor):
    """Long calls, silence and unresponsive floors, keyed by site.

    An alarm has a due time. It fires when a later row is processed or, with no row at all, when the watermark (or the clock, in a live
    run) passes the due time and its timer expires; replay and live runs therefore agree.
    """

    timers = True
    output = (("kind", "string"), ("floor", "string"), ("us", "bigint"), ("since", "bigint"))

    def __init__(
        self,
        long_call_s: float = LONG_CALL_S,
        silence_s: float = SILENCE_S,
        no_response_s: Mapping[str, float] = NO_RESPONSE_S,
        no_response_default_s: float = NO_RESPONSE_DEFAULT_S,
        floors: tuple[str, ...] | None = ("floor_2",),
        buffered: bool = False,
        chunk_us: int = MINUTE_US,
    ):
        super().__init__(buffered, chunk_us)
        self.long_call_s, self.silence_s, self.floors = long_call_s, silence_s, floors
        self.no_response_s, self.no_response_default_s = dict(no_response_s), no_response_default_s

    def step(self, key, rows):
        doc = self.load()
        out: list[tuple] = []
        for us, _, kind, floor, old, new, setpoint, temp, action in rows:
            out += self._due(doc, us)
            doc["last"], doc["quiet"] = us, False
            if kind == CALL:
                call = doc["calls"].setdefault(floor, {})
                change = self.edge(call, old, new)
                if change == ("off", "on"):
                    known = doc["zones"].get(floor)
                    call.update(since=us, start=known, best=known, long=False, cold=False)
                elif change == ("on", "off"):
                    call["since"] = None
            elif kind == CLIMATE and not (setpoint is None and temp is None and action is None):
                doc["zones"][floor] = temp
                call = doc["calls"].get(floor, {})
                if call.get("since") is not None and temp is not None:
                    call["best"] = temp if call["best"] is None else max(call["best"], temp)
        self.save(doc)
        return out

    def due(self):
        return min((due for due, *_ in self._pending(self.load())), default=None)

    def advance(self, key, now_us):
        doc = self.load()
        out = self._due(doc, now_us)
        if out:
            self.save(doc)
        return out

    def _pending(self, doc: dict) -> Iterable[tuple]:
        """Alarms not fired yet as (due time, kind, floor, call)."""
        if doc["last"] is not None and not doc.get("quiet"):
            yield doc["last"] + int(self.silence_s * SECOND), "observer_silence", None, None
        for floor, call in doc["calls"].items():
            since = call.get("since")
            if since is None:
                continue
            if not call["long"] and (self.floors is None or floor in self.floors):
                yield since + int(self.long_call_s * SECOND), "floor_2_long_call", floor, call
            if not call["cold"]:
                limit = self.no_response_s.get(floor, self.no_response_default_s)
                yield since + int(limit * SECOND), "floor_no_response", floor, call

    def _due(self, doc: dict, now_us: int) -> list[tuple]:
        """Fire what is due strictly by ``now_us``; a due alarm is settled whether or not it fires."""
        out = []
        for due, kind, floor, call in list(self._pending(doc)):
            # silence and long calls need the limit in full, also when a row arrives in the very second it is reached
            if due > now_us:
                continue
            if kind == "observer_silence":
                doc["quiet"] = True
                out.append((kind, floor, due, doc["last"]))
            elif kind == "floor_2_long_call":
                call["long"] = True
                out.append((kind, floor, due, call["since"]))
            else:
                call["cold"] = True
                if call["start"] is not None and call["best"] <= call["start"]:
                    out.append((kind, floor, due, call["since"]))
        return out


class DayProcessor(SiteProcessor):
    """Day figures of a site, emitted once the horizon has passed the day, idle floors and days without a call included.

    Readings are summed in millionths, so that means come out as they do in batch. A day is open as long as rows of it may come.
    """

    timers = True
    output = (
        ("us", "bigint"),
        ("furnace_s", "bigint"),
        ("furnace_n", "bigint"),
        ("outdoor_min", "double"),
        ("outdoor_max", "double"),
        ("outdoor_sum", "bigint"),
        ("outdoor_n", "bigint"),
        *((f"{what}_{floor}", "bigint") for floor in FLOORS for what in ("calls", "runtime", "longest", "setpoint_sum", "setpoint_n")),
    )

    def load(self):
        return {"days": {}, **super().load()}

    def step(self, key, rows):
        doc = self.load()
        for us, _, kind, floor, old, new, setpoint, temp, action in rows:
            day = doc["days"].setdefault(str(us // DAY), {"furnace": [0, 0], "outdoor": None, "calls": {}, "setpoints": {}})
            if kind in (CALL, FURNACE):
                call = doc["calls"].setdefault(floor or FURNACE, {})
                change = self.edge(call, old, new)
                if change == ("off", "on"):
                    call["since"] = us
                elif change == ("on", "off"):
                    since, call["since"] = call.get("since"), None
                    self._ended(day, floor, None if since is None else (us - since) // SECOND)
            elif kind == OUTDOOR and setpoint is not None:
                low, high, total, n = day["outdoor"] or [setpoint, setpoint, 0, 0]
                day["outdoor"] = [min(low, setpoint), max(high, setpoint), total + _millionths(setpoint), n + 1]
            elif kind == CLIMATE:
                if not (setpoint is None and temp is None and action is None):
                    doc["zones"][floor] = setpoint
                known = doc["zones"].get(floor)
                if known is not None:
                    total, n = day["setpoints"].get(floor, [0, 0])
                    day["setpoints"][floor] = [total + _millionths(known), n + 1]
        self.save(doc)
        return []

    def due(self):
        return min(((int(day) + 1) * DAY - 1 for day in self.load()["days"]), default=None)

    @staticmethod
    def _ended(day: dict, floor: str | None, duration: int | None) -> None:
        if floor is None:
            total, n = day["furnace"]
            day["furnace"] = [total + (duration or 0), n + 1]
        else:
            n, total, longest = day["calls"].get(floor, [0, 0, None])
            if duration is not None:
                longest = duration if longest is None else max(longest, duration)
            day["calls"][floor] = [n + 1, total + (duration or 0), longest]

    def advance(self, key, now_us):
        doc, out = self.load(), []
        for day in sorted((d for d in doc["days"] if (int(d) + 1) * DAY <= now_us), key=int):
            figures = doc["days"].pop(day)
            low, high, total, n = figures["outdoor"] or [None, None, None, 0]
            row = [int(day) * DAY, *figures["furnace"], low, high, total, n]
            for floor in FLOORS:
                row += [*figures["calls"].get(floor, [0, 0, None]), *figures["setpoints"].get(floor, [None, 0])]
            out.append(tuple(row))
        if out:
            self.save(doc)
        return out


def _millionths(value: float) -> int:
    """As a column rounds it: half away from zero."""
    scaled = abs(value) * 1_000_000
    return int(scaled + 0.5) if value >= 0 else -int(scaled + 0.5)


class GaugeProcessor(SiteProcessor):
    """Every gauge change of a site: activity flags, session durations, temperatures and setpoints."""

    output = (("metric", "string"), ("floor", "string"), ("us", "bigint"), ("seq", "bigint"), ("value", "double"))

    def step(self, key, rows):
        doc, out = self.load(), []
        for us, seq, kind, floor, old, new, setpoint, temp, action in rows:
            if kind in (CALL, FURNACE):
                call = doc["calls"].setdefault(floor or FURNACE, {})
                change = self.edge(call, old, new)
                if change in (("off", "on"), ("on", "off")):
                    name = "floor_call_active" if kind == CALL else "furnace_active"
                    out.append((name, floor, us, seq, 1.0 if new == "on" else 0.0))
                    since, call["since"] = call.get("since"), us if new == "on" else None
                    if kind == FURNACE and new == "off" and since is not None:
                        out.append(("heating_session_duration_s", None, us, seq, float((us - since) // SECOND)))
            elif kind == OUTDOOR and setpoint is not None:
                out.append(("outdoor_temperature_f", None, us, seq, setpoint))
            elif kind == CLIMATE and not (setpoint is None and temp is None and action is None):
                before = doc["zones"].get(floor, [None, None])
                warmer, moved = temp is not None and temp != before[1], setpoint is not None and setpoint != before[0]
                if warmer:
                    out.append(("floor_temperature_f", floor, us, seq, temp))
                if (warmer or moved) and setpoint is not None:
                    out.append(("floor_setpoint_f", floor, us, seq, setpoint))
                doc["zones"][floor] = [setpoint, temp]
        self.save(doc)
        return out

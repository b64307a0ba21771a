"""A plain loop over one fund's day: what the validator's windows have to agree with."""

from __future__ import annotations

import datetime as dt

from navpulse.functions import flags as fl
from navpulse.plans.validate import COUNTERS

STALE, JUMP, MISMATCH, MAX_GAP = 20, 0.10, 0.02, 30
MINUTE = dt.timedelta(minutes=1)


def is_open(ts: dt.datetime, opens: dt.time, closes: dt.time, trading: bool) -> bool:
    return trading and opens <= ts.time() <= closes


def fold_day(cycles, rows, stale_at, opens, closes, trading):
    """``cycles``: ordered times; ``rows``: time -> tick dict (absent = missing).

    Returns ({time: tick}, [(time, check, action)]).
    """
    stored, issues, active = {}, [], set()
    prev, prev_ts = None, None

    def log(ts, check, action, edge=False):
        if edge and check in active:
            return
        if edge:
            active.add(check)
        issues.append((ts, check, action))

    for ts in cycles:
        raw = rows.get(ts)
        if raw is None:
            if prev is not None and ts - prev_ts <= MAX_GAP * MINUTE:
                prev = {**prev, "quality_flags": prev["quality_flags"] | fl.FORWARD_FILLED}
                prev_ts = ts
                stored[ts] = prev
                log(ts, "missing_fund", "forward_filled", edge=True)
            else:
                log(ts, "missing_fund", "dropped", edge=True)
            continue
        if prev is not None:
            between, at = [], prev_ts + MINUTE
            while at < ts:
                if is_open(at, opens, closes, trading):
                    between.append(at)
                at += MINUTE
            if len(between) > MAX_GAP:
                log(ts, "gap", "left_open")
            elif between:
                for at in between:
                    stored[at] = {**prev, "quality_flags": prev["quality_flags"] | fl.FORWARD_FILLED}
                log(ts, "gap", "forward_filled")
        now = dict(raw)
        mask = raw["quality_flags"]
        low, high = raw["band"] or (None, None)
        if low is not None and raw["trade_count"] > 0:
            for name in ("last_price", "close_price"):
                if low <= raw[name] <= high:
                    continue
                mask |= fl.PRICE_OUT_OF_RANGE
                if prev is not None and low <= prev[name] <= high:
                    now[name] = prev[name]
                    log(ts, "price_out_of_band", "replaced_with_previous")
                else:
                    log(ts, "price_out_of_band", "kept")
        if raw["trade_count"] > 0:
            seen = [x for x in (raw["open_price"], now["last_price"], raw["high_price"], raw["low_price"]) if x > 0]
            if seen and (max(seen), min(seen)) != (raw["high_price"], raw["low_price"]):
                now["high_price"], now["low_price"] = max(seen), min(seen)
                mask |= fl.RANGE_REPAIRED
                log(ts, "ohlc_inconsistent", "recomputed")
        if prev is not None:
            fell = [c for c in COUNTERS if raw[c] < prev[c]]
            for c in fell:
                now[c] = prev[c]
            if fell:
                mask |= fl.CUMULATIVE_DECREASE
                log(ts, "cumulative_decrease", "kept_previous")
        if not raw["quality_flags"] & fl.CLIENT_TYPE_MISSING and raw["volume"] > 0:
            sides = [raw[f"ind_{s}_volume"] + raw[f"inst_{s}_volume"] for s in ("buy", "sell")]
            if max(abs(x - raw["volume"]) for x in sides) / raw["volume"] > MISMATCH:
                mask |= fl.CLIENT_VOLUME_MISMATCH
                log(ts, "client_volume_mismatch", "flagged", edge=True)
            else:
                active.discard("client_volume_mismatch")
        if raw["nav_redemption"] is None:
            carried = prev is not None and prev["nav_redemption"] is not None
            if carried:
                now |= {c: prev[c] for c in ("nav_redemption", "nav_subscription", "nav_at")}
                mask |= fl.NAV_CARRIED
            log(ts, "nav_missing", "carried_forward" if carried else "none", edge=True)
        else:
            active.discard("nav_missing")
            if prev is not None and prev["nav_redemption"]:
                if abs(raw["nav_redemption"] / prev["nav_redemption"] - 1) > JUMP:
                    mask |= fl.NAV_JUMP
                    log(ts, "nav_jump", "flagged")
        if now["nav_at"] is not None:
            if ts - now["nav_at"] > STALE * MINUTE:
                mask |= fl.NAV_STALE
                log(ts, "nav_stale", "flagged", edge=True)
            else:
                active.discard("nav_stale")
        if stale_at.get(ts):
            mask |= fl.STALE_QUOTE
        now["quality_flags"] = mask
        stored[ts] = now
        prev, prev_ts = now, ts
        active.discard("missing_fund")
    return stored, issues


def stale_cycles(feed):
    """``feed``: ordered (time, feed time). Returns {time: frozen?} and the logged times."""
    out, logged, last, same, on = {}, [], None, 0, False
    for ts, heven in feed:
        same = same + 1 if heven == last else 0
        last = heven
        out[ts] = same >= 3
        if out[ts] and not on:
            logged.append(ts)
        on = out[ts]
    return out, logged

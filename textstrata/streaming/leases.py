"""Rules of job leases, of signed-in sessions and of the feed of a run, for batches and streams."""

from __future__ import annotations

import pandas as pd

CLAIMABLE = ("pending", "retry_wait")


class Leases:
    """A job's life: claims with a lease, heartbeats, results, retries with backoff, expiry.

    Events have ``worker`` and ``event``: claim, heartbeat, complete, fail, fail_final, cancel. A claim applies to a job that is pending, or waits
    for a retry that is due, and has attempts left; heartbeats and results apply while the worker holds the lease; a running job is not
    cancelled. All else is refused and changes nothing. A lease that ends before the next event, or before the time a run is brought up to,
    expires by itself: the job waits again, available at once, or fails after ``most`` attempts. Unknown events are refused.
    """

    schema = "at timestamp, seq long, worker string, event string, outcome string, status string, attempts int"

    def __init__(self, lease: int = 600, most: int = 3, base: int = 60, longest: int = 600) -> None:
        self.lease, self.most, self.base, self.longest = lease * 1000, most, base, longest

    def start(self) -> dict:
        return {"status": "pending", "owner": None, "attempts": 0, "lease": None, "available": None}

    def due(self, state: dict) -> int | None:
        return state["lease"] if state["status"] == "running" else None

    def _row(self, at: int, seq: int | None, worker: str | None, event: str, outcome: str, state: dict) -> dict:
        return {"at": pd.Timestamp(at, unit="ms"), "seq": seq, "worker": worker, "event": event, "outcome": outcome, "status": state["status"], "attempts": state["attempts"]}

    def expire(self, state: dict) -> dict:
        at, owner = state["lease"], state["owner"]
        state.update(status="failed" if state["attempts"] >= self.most else "retry_wait", owner=None, lease=None, available=at)
        return self._row(at, None, owner, "expire", "lease_expired", state)

    def step(self, state: dict, at: int, seq: int, event: dict) -> list[dict]:
        worker, what = event.get("worker"), event.get("event")
        free = state["status"] in CLAIMABLE
        ready = free and (state["available"] is None or state["available"] <= at) and state["attempts"] < self.most
        holds = state["status"] == "running" and state["owner"] == worker
        applies = {"claim": ready, "cancel": free}.get(what, holds and what in ("heartbeat", "complete", "fail", "fail_final"))
        if applies:
            if what == "claim":
                state.update(status="running", owner=worker, attempts=state["attempts"] + 1, lease=at + self.lease)
            elif what == "heartbeat":
                state.update(lease=at + self.lease)
            elif what == "fail" and state["attempts"] < self.most:
                wait = min(self.longest, self.base * 2 ** (state["attempts"] - 1))
                state.update(status="retry_wait", owner=None, lease=None, available=at + wait * 1000)
            else:
                state.update(status={"complete": "succeeded", "cancel": "cancelled"}.get(what, "failed"), owner=None, lease=None)
        return [self._row(at, seq, worker, what, "applied" if applies else "refused", state)]


class Sessions:
    """Sessions that end ``idle`` seconds after their last request, or ``longest`` seconds after their first, whichever comes first.

    A request at the very end of either is too late and opens the next session. The row of a session is put out when it ends.
    """

    schema = "start timestamp, stop timestamp, n long, ended string"

    def __init__(self, idle: int = 1800, longest: int = 43_200) -> None:
        self.idle, self.longest = idle * 1000, longest * 1000

    def start(self) -> dict:
        return {"start": None}

    def due(self, state: dict) -> int | None:
        # it ends at its limit, and nothing at that time belongs to it: due a millisecond before
        return None if state["start"] is None else min(state["last"] + self.idle, state["start"] + self.longest) - 1

    def expire(self, state: dict) -> dict:
        start, idle, age = state["start"], state["last"] + self.idle, state["start"] + self.longest
        n = state["n"]
        state.clear()
        state["start"] = None
        return {"start": pd.Timestamp(start, unit="ms"), "stop": pd.Timestamp(min(idle, age), unit="ms"), "n": n, "ended": "idle" if idle <= age else "age"}

    def step(self, state: dict, at: int, seq: int, event: dict) -> list[dict]:
        if state["start"] is None:
            state.update(start=at, n=0)
        state.update(last=at, n=state["n"] + 1)
        return []


class Feed:
    """What a client that follows a run is told: ``state`` when it changes, and how it ends.

    A terminal state is followed by ``answer`` and ``done``, a suspended one, in which the run waits for its user, by ``clarify`` and ``done``.
    A run that has reached neither ``wait`` seconds after its first event ends with ``timeout``, put out by the clock; it may go on, untold.
    Whatever comes after the end is not told. Events have ``state`` and ``detail``, which the answer or the clarifying question carries.
    """

    schema = "at timestamp, n int, event string, state string, detail string"

    def __init__(self, terminal: tuple[str, ...], suspended: tuple[str, ...], wait: int = 600) -> None:
        self.terminal, self.suspended, self.wait = terminal, suspended, wait * 1000

    def start(self) -> dict:
        return {"begun": None, "state": None, "n": 0, "over": False}

    def due(self, state: dict) -> int | None:
        return None if state["over"] or state["begun"] is None else state["begun"] + self.wait

    def _told(self, state: dict, at: int, event: str, detail: str | None = None) -> dict:
        state["n"] += 1
        return {"at": pd.Timestamp(at, unit="ms"), "n": state["n"], "event": event, "state": state["state"], "detail": detail}

    def expire(self, state: dict) -> dict:
        state["over"] = True
        return self._told(state, self.due(state | {"over": False}), "timeout")

    def step(self, state: dict, at: int, seq: int, event: dict) -> list[dict]:
        if state["over"]:
            return []
        if state["begun"] is None:
            state["begun"] = at
        now, out = event.get("state"), []
        if now != state["state"]:
            state["state"] = now
            out.append(self._told(state, at, "state"))
        if now in self.terminal or now in self.suspended:
            state["over"] = True
            out += [self._told(state, at, "answer" if now in self.terminal else "clarify", event.get("detail")), self._told(state, at, "done")]
        return out

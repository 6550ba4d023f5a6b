"""Word trigrams in order, and the stretch of a text that is most like a needle.

The trigrams of a text are those of its words, each with two blanks before and one after, in order and with repeats. The likeness of a needle
with m distinct trigrams to a stretch is shared / (m + distinct - shared); the text's likeness is that of its best stretch.

The scan: a best stretch begins with a wanted trigram that does not come again in it (else it could begin later), ends at the first place of
another, and has at most m / likeness distinct trigrams, m / likeness - m of them unwanted. So from each wanted place it reads on to that trigram's
next place at most, and no further than the bound of the best likeness so far allows; stretches from places of one trigram never overlap, and a text is read m times at most.
"""

from __future__ import annotations

import re

import numpy as np

SEPARATORS = re.compile(r"[\W_]+")
BLANK = 32


def ordered_grams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a text's lower-cased words, in order."""
    words = SEPARATORS.sub("  ", (text or "").lower()).strip()
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f"  {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    first, middle, last = points[:-2], points[1:-1], points[2:]
    # a blank in the middle after a letter stands between two words, not in one
    return (first << 42 | middle << 21 | last)[(middle != BLANK) | (first == BLANK)]


def best_stretch(seen: np.ndarray, wanted: np.ndarray, least: float = 0.0) -> float:
    """The greatest likeness of the sorted distinct codes ``wanted`` to a stretch of ``seen``; 0 if it is under ``least``."""
    m = len(wanted)
    if not m or not len(seen):
        return 0.0
    at = np.searchsorted(wanted, seen).clip(max=m - 1)
    places = np.flatnonzero(wanted[at] == seen)
    kinds = at[places]
    if len(np.unique(kinds)) < max(least * m, 1):
        return 0.0
    order = np.lexsort((places, kinds))
    follows = np.full(len(places), len(seen), np.int64)
    same = kinds[order[1:]] == kinds[order[:-1]]
    follows[order[:-1][same]] = places[order[1:]][same]
    if least > 0:
        # a stretch has at most ``most`` distinct trigrams; within half as many places more it meets more, unless that many of them repeat one of
        # the places before them. Where they don't, and too few wanted trigrams come that near, no stretch can be good enough
        most, order = int(m / least), np.argsort(seen, kind="stable")
        span = most + most // 2 + 1
        gap = order[1:] - order[:-1]
        again = np.zeros(len(seen) + 1, np.int64)
        again[order[1:][(seen[order[1:]] == seen[order[:-1]]) & (gap <= span)] + 1] = 1
        again = np.cumsum(again)
        reach = np.minimum(places + span, len(seen))
        near = np.zeros(len(places), np.int64)
        for kind in range(m):
            own = np.append(places[kinds == kind], len(seen))
            near += own[np.searchsorted(own, places)] < reach
        far = again[reach] - again[places] >= reach - places - most
        hopeful = far | (near >= least * m)
        places, follows = places[hopeful], follows[hopeful]
    codes, goal = seen.tolist(), set(wanted.tolist())
    # so many distinct trigrams that aren't wanted spoil a stretch, whatever follows
    best, spoilt = 0.0, m / least - m if least > 0 else float("inf")
    for start, stop in zip(places.tolist(), follows.tolist()):
        run: set[int] = set()
        shared = 0
        for at in range(start, stop):
            code = codes[at]
            if code in run:
                continue
            run.add(code)
            if code in goal:
                shared += 1
                value = shared / (m + len(run) - shared)
                if value > best:
                    best = value
                    spoilt = min(spoilt, m / best - m)
            elif len(run) - shared > spoilt + 1e-9:
                break
    return best if best >= least else 0.0


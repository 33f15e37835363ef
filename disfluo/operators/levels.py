"""The level specification: targets, mixes and injector rates of the four settings of the dial."""

from __future__ import annotations

from dataclasses import replace

from disfluo.functions import lexicon as L
from disfluo.operators.inject import Rates

LEVELS = (0, 1, 2, 3)
TOKENS = tuple(f"<d{k}>" for k in LEVELS)


def check(level: int) -> int:
    if level not in LEVELS:
        raise ValueError(f"a level is one of {', '.join(map(str, LEVELS))}, not {level!r}")
    return level


def _of(spec: dict, level: int) -> dict:
    return next(x for x in spec["levels"] if x["level"] == check(level))


def targets(spec: dict, level: int) -> dict[str, float]:
    """Events for each 100 clean words that a level asks for, by type and in total."""
    own = _of(spec, level)
    return {t: own[f"rate_{t}"] for t in L.TYPES} | {"total": own["total_rate"]}


def mix(spec: dict, level: int) -> dict[str, float]:
    return {t: _of(spec, level)[f"mix_{t}"] for t in L.TYPES}


def rates(spec: dict, level: int, **overrides: float) -> Rates:
    """The injector's rates at a level, as the specification measured them; single ones can be overridden."""
    own = targets(spec, level)
    return replace(Rates(**{t: own[t] for t in L.TYPES}), **overrides)


def dial(spec: dict) -> dict[int, Rates]:
    return {k: rates(spec, k) for k in LEVELS if k}


def describe(spec: dict) -> str:
    """One line for each level: its rate, and one event in so many words."""
    lines = []
    for k in LEVELS:
        total = targets(spec, k)["total"]
        lines.append(f"{TOKENS[k]}  " + (f"{total:.2f} events per 100 words, one in {100 / total:.0f} words" if total else "none"))
    return "\n".join(lines)

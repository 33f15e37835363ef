"""Every registered query of the disfluency engine and its SQL oracle."""

from __future__ import annotations

from disfluo.plans import evaluation, models, rates, sources, systems, texts

QUERIES: dict = {**rates.QUERIES, **texts.QUERIES, **evaluation.QUERIES, **systems.QUERIES, **sources.QUERIES, **models.QUERIES}
ORACLES: dict = {**rates.ORACLES, **texts.ORACLES, **evaluation.ORACLES, **systems.ORACLES, **sources.ORACLES, **models.ORACLES}

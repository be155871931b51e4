"""News to flat feature columns through an external scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rotativa.operators.features import (
    Scorer,
    backfill_metadata,
    parse_features,
    score,
    score_missing,
    validate_features,
    with_prompt,
)


def checked_features(answered: DataFrame) -> DataFrame:
    """Parsed, checked and completed answers: adds ``features``, ``violations`` and ``corrupt``."""
    return backfill_metadata(validate_features(parse_features(answered)))


def extract_features(
    news: DataFrame, load_scorer: Callable[[], Scorer], answers_path: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Ask about every article and return its features; ``answers_path`` keeps answers between runs."""
    prompts = with_prompt(news)
    if answers_path is None:
        return checked_features(score(prompts, load_scorer, tasks=tasks))
    return checked_features(score_missing(prompts, load_scorer, answers_path, tasks))

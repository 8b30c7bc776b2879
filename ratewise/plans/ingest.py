"""Interaction logs to ratings, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..contracts import INTERACTION_COLUMNS, require_columns
from ..operators.filters import active_users, filter_behaviour, highest_rating, implicit_ratings, sample_users


def ratings_from_interactions(
    interactions: DataFrame,
    mode: str = "play_only",
    transform: str = "log1p",
    min_interactions: int = 1,
    n_users: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``user_id, item_id, rating``: filter, rate, keep the highest per pair; on demand active users only, and a sample of users."""
    rows = require_columns(interactions, INTERACTION_COLUMNS, "interactions")
    rated = highest_rating(implicit_ratings(filter_behaviour(rows, mode), transform))
    return sample_users(active_users(rated, min_interactions), n_users, seed)

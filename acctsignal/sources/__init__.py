"""Readers with declared schemas, and writers."""

from acctsignal.sources.readers import (
    read_accounts,
    read_featurized,
    read_followers,
    read_posts,
    read_timelines,
    read_training_accounts,
    read_training_posts,
)
from acctsignal.sources.writers import append_records, write_features, write_graph

__all__ = [
    "append_records", "read_accounts", "read_featurized", "read_followers", "read_posts",
    "read_timelines", "read_training_accounts", "read_training_posts", "write_features",
    "write_graph",
]

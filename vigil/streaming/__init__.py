"""Structured Streaming: the user-day rollup over an event stream."""

from vigil.streaming.rollup import (  # noqa: F401
    partial_rollup,
    start_partial_stream,
    user_day_from_partials,
)

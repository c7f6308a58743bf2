"""geotide: urban-mobility analytics as lazy Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (or a few DataFrames in,
one out) built from Spark's own primitives: joins, aggregations, windows,
unions and Structured Streaming.  Time-relative operators take an explicit
``as_of`` timestamp instead of reading the wall clock.
"""

from geotide.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

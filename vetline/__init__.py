"""vetline: a Spark-native engine for screening posted listings.

Every operator takes DataFrames plus plain arguments (``today``, ``force``)
and returns DataFrames.  Nothing loops over rows on the driver.
"""

from vetline.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]

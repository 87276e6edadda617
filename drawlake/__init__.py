"""Spark-native analytics over corpora of engineering drawings.

Everything is keyed by ``case_id`` (one drawing).  The package is organised by what a Spark user
reaches for: ``functions`` build Columns, ``operators`` turn DataFrames into DataFrames, ``sources``
read and write files, ``streaming`` holds the Structured Streaming forms and ``plans`` binds them to
the registered queries.
"""

from drawlake.session import checkpoint, ensure_checkpoint_dir, local_session

__all__ = ["checkpoint", "ensure_checkpoint_dir", "local_session"]

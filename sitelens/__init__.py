"""sitelens: a Spark-native web-page audit pipeline.

Columns in, columns out (``sitelens.functions``); DataFrames in, DataFrames
out (``sitelens.operators``); table readers and sinks (``sitelens.sources``);
end-to-end jobs and the query registry (``sitelens.plans``); Structured
Streaming versions of the stateful parts (``sitelens.streaming``).
"""

from sitelens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

"""telemill: telemetry analytics (spans, logs, metric points) as Spark DataFrame plans."""

from telemill.session import build_session, prepare_session, shared_dir

__all__ = ["build_session", "prepare_session", "shared_dir"]

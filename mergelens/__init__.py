"""Pull-request analytics as Spark DataFrame operators."""

from mergelens.session import configure, local_session

__all__ = ["configure", "local_session"]

"""Security-log analytics and anomaly detection as Spark DataFrame operators."""

from logwarden.session import configure, local_session

__all__ = ["configure", "local_session"]

"""Emberline: analytics over satellite thermal-anomaly detections, as plain Spark DataFrame operators."""

from emberline.session import build_session

__all__ = ["build_session"]

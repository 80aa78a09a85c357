"""Entity-by-time feature assembly on Spark."""

from .api import assemble

__all__ = ["assemble"]

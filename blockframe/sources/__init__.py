"""Tables to assemble from."""

from .tables import load

__all__ = ["load"]

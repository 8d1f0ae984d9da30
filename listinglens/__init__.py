"""listinglens: property-listing analytics as composable PySpark DataFrame functions."""

from listinglens.settings import Settings

__all__ = ["Settings"]

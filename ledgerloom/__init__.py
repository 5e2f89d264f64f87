"""Credit-panel monitoring on Spark: preparation, reports, quality, commentary."""

from ledgerloom.spec import PanelSpec

__all__ = ["PanelSpec"]

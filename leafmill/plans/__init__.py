"""Plan helpers: lineage cuts in the shared checkpoint folder."""

from leafmill.plans.lineage import cut

__all__ = ["cut"]

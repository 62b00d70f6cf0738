"""Fleet knowledge-sharing analytics as PySpark DataFrame and streaming operators."""
from fleetweave.params import Params
from fleetweave.session import configure, cut_lineage

__all__ = ["Params", "configure", "cut_lineage"]

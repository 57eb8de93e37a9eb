"""brasswing: a relational engine on Spark DataFrames.

``Engine`` runs the small SQL dialect, its data-definition statements and its
dot commands; the sub-packages hold the same operations as plain functions on
DataFrames.
"""

from brasswing.engine import Engine
from brasswing.session import configure, local_session

__all__ = ["Engine", "configure", "local_session"]

"""The registered queries. Importing this package registers them all."""

from . import aggregates, bound, filters, joins, pipelines, ranking, scalars, sets, streams, studies, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregates", "bound", "filters", "joins", "pipelines", "ranking", "scalars", "sets", "streams", "studies", "windows"]

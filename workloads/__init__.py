from workloads import annotation, counting, discovery, extension, gates, modelling, ranking, recovery
from workloads.base import QUERIES, oracle

__all__ = ["QUERIES", "annotation", "counting", "discovery", "extension", "gates", "modelling", "oracle", "ranking", "recovery"]

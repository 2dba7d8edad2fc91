"""Clustering estimators."""

from blockframe.cluster.daura import Daura
from blockframe.cluster.dbscan import DBSCAN
from blockframe.cluster.kmeans import KMeans
from blockframe.cluster.mixture import GaussianMixture

__all__ = ["DBSCAN", "Daura", "GaussianMixture", "KMeans"]

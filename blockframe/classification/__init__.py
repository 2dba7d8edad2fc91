"""Classification estimators."""

from blockframe.classification.knn import KNeighborsClassifier
from blockframe.classification.svm import CascadeSVM

__all__ = ["CascadeSVM", "KNeighborsClassifier"]

"""Persistent homology and related operators on Spark DataFrames.

The names that most programs need can be taken from here; the modules have the rest.
"""

from skeinlab.functions.fields import Prime, Reals
from skeinlab.operators.homology import barcode_at, bars, by_dimension, diagram_at, distributed_pairs, persistent_homology
from skeinlab.operators.rips import gabriel, vietoris_rips
from skeinlab.operators.spanning import components_at, fundamental_cycles, kruskal, spanning_forest
from skeinlab.sources.cells import ExplicitBuilder
from skeinlab.sources.metric import euclidean, explicit, hypercube, sparse

__all__ = [
    "ExplicitBuilder", "Prime", "Reals", "barcode_at", "bars", "by_dimension", "components_at", "diagram_at", "distributed_pairs",
    "euclidean", "explicit", "fundamental_cycles", "gabriel", "hypercube", "kruskal", "persistent_homology", "spanning_forest", "sparse", "vietoris_rips",
]

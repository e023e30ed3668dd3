"""Connected components of an edge table by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.graph import min_label_components


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``: the smallest node that links reach, for every node with a link.

    Loops and repeated edges are harmless; an empty edge table gives an empty result.  Every round is written to
    the shared folder, and nothing but two sums comes to the driver.
    """
    return min_label_components(edges, "a", "b")

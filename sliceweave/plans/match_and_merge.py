"""Match neurons across sections, choose chains, assemble the merged object."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sliceweave.operators.assemble import assemble_matrix
from sliceweave.operators.chains import chains, choose_links, threads
from sliceweave.operators.matching import match_sections
from sliceweave.operators.matrix import Matrix
from sliceweave.session import materialize


def match_and_merge(cells: DataFrame, m: Matrix, neuron_types: list[str], radius: float = 30.0, tps_thresh: float = 50.0,
                    dist_filter: float = 20.0, min_neurons: int = 100, smoothing: float = 0.1, max_sections: int = 3):
    """``(merged matrix, edges, chains)`` of one side; ``cells`` carries the stored positions of the matrix rows."""
    _, edges = match_sections(cells, neuron_types, radius, tps_thresh, dist_filter, min_neurons, smoothing)
    edges = materialize(edges)
    chain_table = materialize(chains(choose_links(threads(edges), radius, max_sections)))
    return assemble_matrix(m, cells, chain_table, neuron_types), edges, chain_table

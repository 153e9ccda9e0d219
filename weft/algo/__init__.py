"""Graph algorithms, called as procedures."""

from weft.algo.communities import betweenness, label_propagation, louvain
from weft.algo.components import scc, wcc
from weft.algo.measures import degree, fast_rp, pagerank, shortest_path, triangle_count

PROCEDURES = {
    "algo.wcc": wcc, "algo.scc": scc, "algo.pagerank": pagerank, "algo.degree": degree, "algo.triangle_count": triangle_count,
    "algo.label_propagation": label_propagation, "algo.louvain": louvain, "algo.betweenness": betweenness,
    "algo.shortest_path": shortest_path, "algo.fastrp": fast_rp,
}

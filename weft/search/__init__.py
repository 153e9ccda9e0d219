"""Searches, called as procedures."""

from weft.search.hybrid import search_hybrid
from weft.search.text import search_bm25
from weft.search.vector import query_nodes, search_vector

PROCEDURES = {"search.vector": search_vector, "search.bm25": search_bm25, "search.hybrid": search_hybrid, "db.index.vector.querynodes": query_nodes}

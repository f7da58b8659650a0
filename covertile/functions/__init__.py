"""Column expressions shared by the operators."""

from .expressions import (
    canonical,
    escape,
    hash_priority,
    mex,
    precedes,
    tie_distance,
    tuple_id,
)

__all__ = [
    "canonical",
    "escape",
    "hash_priority",
    "mex",
    "precedes",
    "tie_distance",
    "tuple_id",
]

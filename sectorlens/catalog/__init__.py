"""All registered queries; importing this package registers them."""

from sectorlens.catalog import (  # noqa: F401
    entities,
    legal,
    lemmas,
    levels,
    names,
    official,
    records,
    sectors,
    subwords,
    text,
    vectors,
)
from sectorlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

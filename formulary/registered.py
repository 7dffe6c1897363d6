"""Every registered query of the library and its SQL."""

from formulary import text_queries  # noqa: F401  its queries register themselves beside the others
from formulary.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

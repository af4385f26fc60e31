"""Connected components of links, as the rest of the library has them."""

from leadkin.operators.components import components, least_by

__all__ = ["components", "least_by"]

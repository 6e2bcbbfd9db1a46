"""Connected components, as the library's core has them."""

from ..components import connected_components

__all__ = ["connected_components"]

"""Connected components, as the library has them."""

from quadrille.operators.graph import components  # noqa: F401

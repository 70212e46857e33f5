"""Query registry (``catalog``) and the plans that register themselves in it."""
from . import catalog  # noqa: F401

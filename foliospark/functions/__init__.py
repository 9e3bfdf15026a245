"""Scalar functions: native column expressions, and Arrow-batched ones where exact URL semantics need Python."""

from .columns import *  # noqa: F403
from .paths import *  # noqa: F403

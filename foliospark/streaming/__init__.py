"""A folder of arriving publications, converted batch by batch."""

from .arrivals import convert_arrivals

__all__ = ["convert_arrivals"]

"""Sources: publication archives and what is packed in them."""

from .archives import expand_inputs, read_books, zip_entries, zip_members

__all__ = ["expand_inputs", "read_books", "zip_entries", "zip_members"]

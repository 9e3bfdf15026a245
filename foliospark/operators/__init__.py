"""Operators over publications: archive checks, packages, document trees, assets, assembly, validation and reports."""

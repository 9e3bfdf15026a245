"""Two-phase publishing and image output."""

"""See README.md for the layout of this package."""

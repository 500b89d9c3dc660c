"""See README.md for the list of operators in this package."""

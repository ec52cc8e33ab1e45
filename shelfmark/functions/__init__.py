"""See the README for the layout."""

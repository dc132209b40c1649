"""See the package docstring of auditloom for the layout."""

"""Sources (scans and parsers) and the fixture bindings."""

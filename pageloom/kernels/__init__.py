"""Arrow-batched Python kernels: what Catalyst can't express (HTML trees, nested JSON-LD, erfc)."""

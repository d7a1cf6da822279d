"""End-to-end plans: pages to scores, and the registered queries."""

"""Find, check, mask, gate and audit regulated identifiers with Spark."""

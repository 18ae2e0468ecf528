"""Terms and expressions as columns."""

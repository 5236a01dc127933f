"""Physical strategies that Catalyst does not choose by itself."""

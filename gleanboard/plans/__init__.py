"""User-facing jobs composed of the operators."""

"""Training-data operators. Nothing outside this package imports it; see ``registry`` for the queries."""

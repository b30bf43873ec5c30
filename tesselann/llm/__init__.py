"""Training-data operators: one module for each of the ten, and the queries built from them."""

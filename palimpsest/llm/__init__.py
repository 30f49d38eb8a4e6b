"""Training-data operators: one module per operator, shared kernels beside them."""

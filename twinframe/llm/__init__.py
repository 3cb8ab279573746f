"""Training-data operators. Nothing outside this folder imports it; `queries` and `oracles` list what it offers."""

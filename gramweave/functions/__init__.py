"""Column helpers and the kernels behind them."""

"""Column functions; built-in expressions wherever Catalyst can express them."""

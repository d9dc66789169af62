"""Column functions with the semantics of declared data: none is a value, order is total, logic has two values."""

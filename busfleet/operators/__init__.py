"""operators of the bus-capture library."""

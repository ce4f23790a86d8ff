"""streaming of the bus-capture library."""

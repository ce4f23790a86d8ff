"""sources of the bus-capture library."""

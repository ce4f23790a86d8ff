"""functions of the bus-capture library."""

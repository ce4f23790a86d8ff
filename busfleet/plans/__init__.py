"""plans of the bus-capture library."""

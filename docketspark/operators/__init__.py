"""DataFrame operators. Each takes frames and an explicit as_of time; none reads the clock."""

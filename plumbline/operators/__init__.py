"""DataFrame operators: diagnosis first, then the fixes."""

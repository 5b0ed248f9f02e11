"""Column functions over windows held as arrays of doubles."""

"""Stream forms of the operators that keep state; each has a batch twin in ``operators``."""

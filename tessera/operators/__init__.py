"""DataFrame operators over tables and atoms."""

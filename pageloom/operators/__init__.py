"""DataFrame operators over tables of stored pages."""

"""Plans put together from the operators."""

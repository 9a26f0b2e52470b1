"""Pages that keep arriving: the batch operators, applied per micro-batch."""

"""Named queries composed from operators, with their SQL twins."""

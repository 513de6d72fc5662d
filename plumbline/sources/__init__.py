"""Table readers and result stores."""

"""Reading tables in, writing results out."""

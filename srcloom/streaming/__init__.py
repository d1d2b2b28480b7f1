"""Tables kept up to date from streams of ingested rows."""

"""Search-visibility analytics and text-corpus operators as lazy Spark plans."""

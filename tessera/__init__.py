"""Tessera: chunked numerical, bookkeeping and text operators as Spark plans."""

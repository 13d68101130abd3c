"""Analytics over libraries of scanned and imported documents, as Spark plans."""

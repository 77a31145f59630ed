"""Spark operators for second-hand bookshop catalogues, all shops at once."""

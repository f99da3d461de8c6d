"""gridloom: office-style grids, documents and decks as Spark DataFrames."""

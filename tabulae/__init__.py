"""tabulae: analytics over document collections and the tables found in them, as Spark plans."""

"""Analytics of recorded behavioural sessions, written as Spark DataFrame plans."""

"""Analytics over sampled language-model trajectories, written as Spark DataFrame plans."""

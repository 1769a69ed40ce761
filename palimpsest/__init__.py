"""A versioned property graph on Spark: traversals compile to DataFrame plans with validity ranges along every path."""

"""galley: recipe, ingredient, food-composition and process-event analytics as lazy Spark plans."""
